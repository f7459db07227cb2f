"""Classifier metrics over (label, score) rows, overall or by groups.

Rows are first summed up by distinct score, with map-side combination, so the running sums below work on one
row a distinct score, by ranges of scores; ``digits`` rounds scores. Undefined values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.ordering import positions
from quarrymill.runtime import stage

SPLITS = ("train", "validation", "test")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """n, tn, fp, fn, tp with ``score >= threshold`` as the positive answer."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(yes & pos).alias("tp"))


def point_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 added to the four counts; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": _ratio(tp + tn, F.col("n")), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def by_score(rows: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Positives p and negatives n at each distinct score."""
    score = F.col("score") if digits is None else F.round("score", digits)
    return rows.withColumn("score", score).groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))


def cuts(rows: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Distinct scores with p and n, tp and fp (positives and negatives of this score or more) and all_p and all_n.

    The sums run over ranges of scores (see ``operators.ordering``), so neither a group nor the whole meets in a task.
    """
    scores = stage(by_score(rows, by, digits), "scores")
    summed = positions(scores, list(by), [F.desc("score")], "place", {"tp": "p", "fp": "n"})
    summed = summed.withColumns({"tp": F.col("tp") + F.col("p"), "fp": F.col("fp") + F.col("n")}).drop("place")
    totals = scores.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return summed.join(totals, list(by)) if by else summed.crossJoin(F.broadcast(totals))


def ranking_metrics(rows: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """roc_auc (ties count half), average_precision (ties as one step); null if a class is missing."""
    ranked = cuts(rows, by, digits).withColumn("below", F.col("all_n") - F.col("fp"))
    p, n = F.sum("p"), F.sum("n")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n").cast("double") / F.lit(2.0)))
    steps = F.sum(F.col("p") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double"))
    both = (p > 0) & (n > 0)
    return ranked.groupBy(*by).agg(F.when(both, wins / (p.cast("double") * n.cast("double"))).alias("roc_auc"), F.when(p > 0, steps / p.cast("double")).alias("average_precision"))


def brier(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared distance of score and label."""
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier_score"))


def select_threshold(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """threshold and f1: the lowest of the scores at which f1 of ``score >= threshold`` is greatest; 0.5 without rows."""
    least = lambda c: F.greatest(c.cast("double"), F.lit(1e-12))
    precision, recall = F.col("tp") / least(F.col("tp") + F.col("fp")), F.col("tp") / least(F.col("all_p"))
    found = cuts(rows, by).select(*by, "score", (2.0 * precision * recall / least(precision + recall)).alias("f1"))
    best = found.groupBy(*by).agg(F.max_by(F.struct(F.col("score").alias("threshold"), "f1"), F.struct(F.round("f1", 12), -F.col("score"))).alias("b"))
    return best.select(*by, F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col("b.f1").alias("f1"))


def sliced(rows: DataFrame) -> DataFrame:
    """Each row once in ``overall``, positives once more in every slice, negatives in that of their type."""
    kinds = rows.where("negative_type is not null").agg(F.sort_array(F.collect_set("negative_type")).alias("kinds"))  # the kinds are few by nature
    own = F.when(F.col("label") == 1, F.col("kinds")).otherwise(F.filter(F.array("negative_type"), lambda k: k.isNotNull()))
    every = rows.crossJoin(F.broadcast(kinds)).withColumn("slice", F.explode(F.concat(F.array(F.lit("overall")), own)))
    return every.drop("kinds")


def evaluated(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics of each group."""
    joined = point_metrics(confusion(rows, threshold, by))
    for other in (ranking_metrics(rows, by), brier(rows, by)):
        joined = joined.join(other, list(by)) if by else joined.crossJoin(other)
    return joined
