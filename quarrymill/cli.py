"""``python -m quarrymill.cli VERB TABLES``: run a query and print or write its rows; ``score-text MODEL TEXT ...``: one JSON
line a text, scored by a stored model."""

from __future__ import annotations

import argparse
import json
import sys

#: The verbs of the command line, each a query.
VERBS = {"audit": "b17_audit", "chunk": "b10_passages", "split": "j6_split_dataset", "match": "g17_greedy_matches", "build": "j10_hybrid", "train": "h4_logistic_regression", "evaluate": "f7_slices", "score": "e9_score_summary", "verify": "j17_dataset_checks"}


def main(args: list[str] | None = None) -> None:
    given = sys.argv[1:] if args is None else args
    if given[:1] == ["score-text"]:
        return score_text(given[1:])
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("verb", help=f"one of {', '.join(VERBS)}, or the name of a query")
    parser.add_argument("tables", help="folder of the input tables")
    parser.add_argument("--output", help="folder for JSON lines; without it the first rows are shown")
    chosen = parser.parse_args(given)
    from pyspark.sql import SparkSession

    from quarrymill.plans import registry
    from quarrymill.sources.jsonl import write_jsonl

    spark = SparkSession.builder.getOrCreate()
    rows = registry.queries()[VERBS.get(chosen.verb, chosen.verb)](spark, chosen.tables)
    if chosen.output:
        write_jsonl(rows, chosen.output)
    else:
        rows.show(20, truncate=80)


def score_text(args: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="score-text")
    parser.add_argument("model", help="folder of a stored model")
    parser.add_argument("text", nargs="+")
    chosen = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from quarrymill.operators import models

    spark = SparkSession.builder.getOrCreate()
    dimension = int(models.load(spark, chosen.model).facts.get("dimension", 64))
    for r in models.score_texts(spark, chosen.model, chosen.text, models.hashed_encoder(dimension)).collect():
        print(json.dumps(r.asDict(), ensure_ascii=False))


if __name__ == "__main__":
    main()
