"""Connected components of an undirected graph, as a loop over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import stage


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: two numbers, whatever the size."""
    row = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("v", "m"), 8).cast("decimal(38,0)"))).first()
    return tuple(row)


#: Rows of a key beyond which it counts as a hub.
HUB = 50_000


def _lows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its least value and how many it has."""
    return rows.groupBy(key).agg(F.min(value).alias("low"), F.count("*").alias("held"))


def _with_lows(rows: DataFrame, lows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``low`` of their key, hubs apart: there are few (a row of ``lows`` for each ``HUB`` rows at most),
    so they are broadcast, and their rows stay where they are."""
    hubs = lows.where(F.col("held") > HUB).select(key, "low")
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(lows.where(F.col("held") <= HUB).select(key, "low"), key)
    return rows.join(F.broadcast(hubs), key).unionByName(rest)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node that an edge names; the component is its smallest node.

    Alternating large-star and small-star rounds: each node passes the smallest node it knows to its larger,
    then to its smaller neighbours, until nothing changes. A hub costs no more than its edges, and they never meet in
    one task: minima are combined before the shuffle, and hubs' minima go to their edges. Each round is staged,
    so the plan stays short and a lost executor costs one round at most. Self-loops name isolated nodes;
    null ends are dropped.
    """
    a, b = F.col(src), F.col(dst)
    now = stage(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), "edges")
    nodes = now.select(F.col("v").alias("id")).union(now.select("m")).distinct()
    links = now.where("v <> m")
    state = _state(links)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).union(links.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = _lows(both, "u", "w").withColumn("low", F.least("u", "low"))
        large = stage(_with_lows(both.where("w > u"), least, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct(), "large")
        lower = _lows(large, "v", "m")
        small = _with_lows(large, lower, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).union(lower.select("v", F.col("low").alias("m"))).where("v <> m").distinct()
        links = stage(small, "components")
        new = _state(links)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return nodes.join(links.groupBy("v").agg(F.min("m").alias("low")), F.col("id") == F.col("v"), "left").select("id", F.coalesce("low", "id").alias("component"))
