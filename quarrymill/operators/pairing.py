"""Pairs of rows: by key, by rank, best of several runs, and their scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.ordering import positions


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in the given (total) order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def complete_pairs(rows: DataFrame, key: str = "candidate_id", order: str = "ord", strict: bool = False) -> DataFrame:
    """key, positive and negative example_id of the keys that have both; the last row of a (key, label) counts.

    With ``strict`` a key that lacks one of them raises; the error names a few.
    """
    last = rows.groupBy(key, "label").agg(F.max_by("example_id", order).alias("example_id"))
    wide = last.groupBy(key).agg(F.max(F.when(F.col("label") == 1, F.col("example_id"))).alias("positive"), F.max(F.when(F.col("label") == 0, F.col("example_id"))).alias("negative"))
    lacking = F.col("positive").isNull() | F.col("negative").isNull()
    if strict and (found := wide.where(lacking).orderBy(key).limit(5).collect()):
        raise ValueError(f"incomplete pairs, among them {', '.join(str(r[key]) for r in found)}")
    return wide.where(~lacking)


def zipped(left: DataFrame, right: DataFrame, by: list[str], left_order: Column, right_order: Column) -> DataFrame:
    """The i-th row of ``left`` with the i-th of ``right`` in each group; what has no counterpart is left out.

    Places are counted by ranges (see ``operators.ordering``), so no group meets in one task.
    """
    return positions(left, by, [left_order], "rn").join(positions(right, by, [right_order], "rn"), [*by, "rn"]).drop("rn")


def quota(rows: DataFrame, by: list[str], order: Column, quotas: Column) -> DataFrame:
    """The first rows of each group up to its quota."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= quotas).drop("_n")


def nearest_lengths(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Greedy match without replacement: (stratum, target_id, pool_id, gap).

    ``targets`` and ``pool``: stratum, id, words, ord. Targets come in order; each takes the unused pool row
    of the nearest length, of equal ones the first in order. Targets left when the pool is empty get null.
    Sequential in each stratum, on thin rows; strata run in parallel. A length's rows wait in one queue, so a
    target costs the distance to the next length that has any.
    """

    def walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queues: dict[int, list[tuple[str, str]]] = {}
        for words, order, i in sorted(zip(right["words"], right["ord"], right["id"]), reverse=True):
            queues.setdefault(int(words), []).append((order, i))
        out = []
        longest = max(queues, default=0)
        for order, i, words in sorted(zip(left["ord"], left["id"], left["words"])):
            found = None
            for gap in range(max(longest, int(words)) + 1) if queues else ():
                near = [(queues[w][-1], w) for w in {words - gap, words + gap} if w in queues]
                if near:
                    _, w = min(near)
                    found = queues[w].pop()[1], gap
                    if not queues[w]:
                        del queues[w]
                    break
            out.append((key[0], i, *(found or (None, None))))
        return pd.DataFrame(out, columns=["stratum", "target_id", "pool_id", "gap"]).astype({"gap": "Int64"})

    return targets.groupBy("stratum").cogroup(pool.groupBy("stratum")).applyInPandas(walk, "stratum string, target_id string, pool_id string, gap long")


def score_summary(rows: DataFrame, tie: float = 1e-9) -> DataFrame:
    """n, wins, losses, ties, win_rate, mean and median margin of (positive_score, negative_score) rows."""
    margin = F.col("positive_score") - F.col("negative_score")
    m = rows.select("positive_score", "negative_score", margin.alias("margin"))
    return m.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("margin") > tie).alias("wins"),
        F.count_if(F.col("margin") < -tie).alias("losses"),
        F.count_if(F.abs("margin") <= tie).alias("ties"),
        F.avg((F.col("margin") > tie).cast("double")).alias("win_rate"),
        F.avg("positive_score").alias("mean_positive"),
        F.avg("negative_score").alias("mean_negative"),
        F.avg("margin").alias("mean_margin"),
        F.expr("percentile(margin, 0.5)").alias("median_margin"),
    )
