"""Whole documents dealt to train, validation and test."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T

RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def stratum(label: str = "label", kind: str = "negative_type", positive: str = "0_positive", other: str = "other") -> Column:
    """Positives are one stratum, negatives one for each type (an empty type counts as missing)."""
    return F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit(other)))


def balanced(sizes: DataFrame, ratios: Mapping[str, float] = RATIOS) -> DataFrame:
    """stratum, document_id, split from (stratum, document_id, size).

    In each stratum documents come by size, largest first, ties in hash order; each goes to the split with
    the least (10 * overflow + fill, count, name). That is a sequence by nature: one task a stratum takes thin rows
    (id and size), sorted by Spark, as they stream by; it keeps three counts. Strata run in parallel.
    """
    names = sorted(ratios)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, targets, floor = object(), {}, {}, {}
        for b in batches:
            chosen = []
            for stratum, size, total in zip(*(b.column(c).to_pylist() for c in ("stratum", "size", "total"))):
                if stratum != now:
                    now, counts = stratum, dict.fromkeys(names, 0)
                    targets = {s: total * ratios[s] for s in names}
                    floor = {s: max(targets[s], 1.0) for s in names}
                best = min(names, key=lambda s: (max(0.0, counts[s] + size - targets[s]) / floor[s] * 10.0 + (counts[s] + size) / floor[s], counts[s], s))
                counts[best] += size
                chosen.append(best)
            yield pa.RecordBatch.from_arrays([b.column("stratum"), b.column("document_id"), pa.array(chosen, pa.string())], names=["stratum", "document_id", "split"])

    totals = sizes.groupBy("stratum").agg(F.sum("size").alias("total"))
    ranked = sizes.select("stratum", F.col("document_id").cast("string").alias("document_id"), "size", T.rank_key("split", "document_id").alias("rank")).join(totals, "stratum")
    dealt = ranked.repartition("stratum").sortWithinPartitions("stratum", F.desc("size"), "rank")
    return dealt.mapInArrow(walk, "stratum string, document_id string, split string")


def group_splits(rows: DataFrame, ratios: Mapping[str, float] = RATIOS, strata: Column | None = None) -> DataFrame:
    """document_id, split. A document of several strata takes the split of the last one by name."""
    sizes = rows.groupBy((stratum() if strata is None else strata).alias("stratum"), "document_id").agg(F.count("*").alias("size"))
    return balanced(sizes, ratios).groupBy("document_id").agg(F.max_by("split", "stratum").alias("split"))


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with the split of their document; rows without one are left out (see ``unsplit``)."""
    return rows.join(splits, "document_id")


def unsplit(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows whose document has no split: must be none."""
    return rows.join(splits, "document_id", "left_anti")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of each split; all three appear."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in RATIOS], "split string")
    counted = rows.groupBy("split").agg(F.count("*").alias("passages"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return counted.join(F.broadcast(names), "split", "right").na.fill(0)


def violations(rows: DataFrame) -> DataFrame:
    """check, violations: duplicate ids, duplicate texts, unknown splits, documents in several splits."""
    spark = rows.sparkSession
    extra = lambda c: (F.count(c) - F.count_distinct(c))
    whole = rows.agg(extra("example_id").alias("duplicate_ids"), extra(F.md5("text")).alias("duplicate_texts"), F.count_if(F.coalesce(~F.col("split").isin(*RATIOS), F.lit(True))).alias("invalid_split"))
    leaks = rows.groupBy("document_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaking_documents"))
    return whole.crossJoin(leaks).unpivot([], ["duplicate_ids", "duplicate_texts", "invalid_split", "leaking_documents"], "check", "violations")
