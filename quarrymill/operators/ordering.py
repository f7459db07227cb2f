"""Positions and prefix sums within groups of any size: rows are dealt by ranges, so no group meets in one task."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.runtime import partitions, stage


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... within each group in the given order, and ``sums`` (new column -> old column):
    what the old column adds up to in the group before the row. ``order`` should tell rows apart, for where rows tie
    it is left open which comes first. Null group values are a group.

    Rows are sorted by ranges of (group, order) and staged. Each range counts on its own; what a group had in earlier
    ranges is added, which concerns one group a range boundary at most.
    """
    sums = sums or {}
    taken = {*df.columns, name, *sums}
    part, at, piece, total = (next(x for x in (c, f"{c}_", f"{c}__", f"{c}___") if x not in taken) for c in ("part", "at", "piece", "total"))
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    marked = stage(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ordered")
    here = Window.partitionBy(part, *group).orderBy(at)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = marked.withColumns({name: (F.row_number().over(here) - 1).cast("long")} | {new: zero(F.sum(old).over(before)) for new, old in sums.items()})
    pieces = marked.groupBy(part, *group).agg(F.count("*").alias(piece), *[F.sum(old).alias(f"{piece}_{k}") for k, old in enumerate(sums.values())])
    # a row a range and group; only groups that an earlier range holds too go on: as many rows as there are ranges at most
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(part, *group, F.sum(piece).over(earlier).alias(total), *[F.sum(f"{piece}_{k}").over(earlier).alias(f"{total}_{k}") for k in range(len(sums))]).where(F.col(total).isNotNull())
    there = carried.withColumnsRenamed({c: f"{total}_{c}" for c in (part, *group)})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"{total}_{c}")) for c in (part, *group)])
    joined = local.join(F.broadcast(there), same, "left")
    shown = {name: F.col(name) + zero(F.col(total))} | {new: F.col(new) + zero(F.col(f"{total}_{k}")) for k, new in enumerate(sums)}
    return joined.select(*df.columns, *[v.alias(k) for k, v in shown.items()])
