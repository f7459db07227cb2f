"""Datasets put together from several sources without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators.pairing import quota
from quarrymill.runtime import stage


def combined(sources: list[tuple[str, DataFrame]], quotas: dict[str, Column]) -> DataFrame:
    """source, pair_id, document_id, split of what each source may add, source by source.

    A source's pairs (pair_id, document_id, split) are left out if an earlier source has taken the document,
    or has it in another split; then the first of each split in hash order count, up to the quota. Each step
    is staged, as the next depends on it.
    """
    taken = None
    for name, rows in sources:
        free = rows.select("pair_id", "document_id", "split")
        if taken is not None:
            free = free.join(taken.select("document_id").distinct(), "document_id", "left_anti")
        chosen = quota(free, ["split"], T.rank_key(f"combined-{name}", "pair_id"), quotas[name]).select(F.lit(name).alias("source"), "pair_id", "document_id", "split")
        taken = stage(chosen if taken is None else taken.unionByName(chosen), "combined")
    return taken


def hybrid(passages: DataFrame, topic: DataFrame, easy: DataFrame) -> DataFrame:
    """example_id, split, negative_id, kind: every passage with its topic negative, if any, else an easy one.

    ``passages``: example_id, split; ``topic``: example_id, negative_id; ``easy``: negative_id, split. The i-th
    passage without a topic negative takes the i-th easy negative of its split in hash order; without any left
    it is dropped.
    """
    from quarrymill.operators.pairing import zipped

    named = passages.join(topic, "example_id").withColumn("kind", F.lit("topic"))
    rest = passages.join(topic, "example_id", "left_anti")
    fallback = zipped(rest, easy, ["split"], F.col("example_id"), T.rank_key("easy", "negative_id")).withColumn("kind", F.lit("easy"))
    columns = ["example_id", "split", "negative_id", "kind"]
    return named.select(columns).unionByName(fallback.select(columns))
