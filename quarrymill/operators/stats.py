"""Tests and intervals over paired margins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.ordering import positions
from quarrymill.runtime import stage


#: Margins up to which each task of the bootstrap holds all (8 bytes each); beyond, draws meet them by a join.
HELD = 2_000_000


def bootstrap_interval(margins: DataFrame, resamples: int = 10_000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low and high of the mean of ``margin`` over resamples drawn by hash: row i of resample b is value
    hash(b, i) mod n. ``margins`` has rn = 0 ... n - 1 and margin.

    The resamples are dealt to tasks; each makes its draws and adds them up where it is, so that a row a resample is
    all that is shuffled.
    """
    margins = stage(margins.select("rn", F.col("margin").cast("double").alias("margin")), "margins")
    n = margins.count()
    if n > HELD:
        means = _joined_means(margins, resamples)
    else:
        spark = margins.sparkSession
        held = margins.toArrow()  # few by the bound
        values = np.zeros(n)
        values[held.column("rn").to_numpy()] = held.column("margin").to_numpy()
        shared = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = shared.value
            words = _row_words(len(values))
            for b in batches:
                found = [_resampled(values, int(k), words) for k in b.column("id").to_pylist()] if len(values) else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], names=["mean"])

        parts = min(resamples, 25 * spark.sparkContext.defaultParallelism)
        means = spark.range(0, resamples, 1, parts).mapInArrow(run, "mean double")
    return means.agg(F.expr(f"percentile(mean, {low})").alias("low"), F.expr(f"percentile(mean, {high})").alias("high"))


def _joined_means(margins: DataFrame, resamples: int) -> DataFrame:
    """The means of resamples of any number of margins; they meet each draw by an equi-join."""
    n = margins.agg(F.count("*").alias("n"))
    draws = margins.select("rn", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", "b", "rn")), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = draws.crossJoin(F.broadcast(n)).select("b", at.alias("rn"))
    return drawn.join(margins, "rn").groupBy("b").agg(F.avg("margin").alias("mean"))


_TURNS = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
_SINES = [int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_SLICE = 1 << 13  # rows at a time, so that all arrays stay in the cache


def _row_words(n: int) -> list[np.ndarray]:
    """The decimal digits of 0 ... n - 1 as bytes, an array (rows, digits) for each number of digits."""
    out, first = [], 0
    while first < n:
        digits = len(str(first))
        end = min(n, 10**digits)
        k = np.arange(first, end)
        out.append(np.stack([(k // 10 ** (digits - 1 - j) % 10 + 48).astype(np.uint8) for j in range(digits)], 1))
        first = end
    return out


def _md5_heads(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of ``prefix`` followed by each row of ``digits``, as the first 8 hex digits tell them."""
    n, more = digits.shape
    length = len(prefix) + more
    block = np.zeros((n, -(-(length + 1) // 4) * 4), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    block[:, len(prefix) : length] = digits
    block[:, length] = 0x80
    words: list = list(np.ascontiguousarray(block.view("<u4").T))
    words += [np.uint32(0)] * (14 - len(words)) + [np.uint32(8 * length), np.uint32(0)]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, x = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = k
        elif k < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * k + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * k % 16
        f += a
        f += np.uint32(_SINES[k])
        if isinstance(words[g], np.ndarray) or words[g]:
            f += words[g]
        turn = _TURNS[k]
        np.left_shift(f, np.uint32(turn), out=x)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        x |= f
        x += b
        a, d, c, b, x = d, c, b, x, a
    return (a + start[0]).byteswap()


def _resampled(values: np.ndarray, resample: int, rows: list[np.ndarray]) -> float:
    """The mean of one resample."""
    total, n = 0.0, len(values)
    for digits in rows:
        for k in range(0, len(digits), _SLICE):
            total += values[_md5_heads(b"%d-" % resample, digits[k : k + _SLICE]) % np.uint32(n)].sum()
    return total / n


def sign_test(margins: DataFrame, tie: float = 1e-9) -> DataFrame:
    """wins, losses, and the exact one-sided p of as many wins by chance; ties are dropped."""
    counts = margins.agg(F.count_if(F.col("margin") > tie).alias("wins"), F.count_if(F.col("margin") < -tie).alias("losses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, l = b.column("wins").to_pylist(), b.column("losses").to_pylist()
            p = [sum(math.exp(math.lgamma(x + y + 1) - math.lgamma(k + 1) - math.lgamma(x + y - k + 1) - (x + y) * math.log(2)) for k in range(x, x + y + 1)) for x, y in zip(w, l)]
            yield pa.RecordBatch.from_arrays([b.column("wins"), b.column("losses"), pa.array(p, pa.float64())], names=["wins", "losses", "p"])

    return counts.mapInArrow(run, "wins long, losses long, p double")


def exact_tail(w: float, n: int) -> float:
    """P(W >= w) of the signed-rank sum of n untied differences, by counting the sets of ranks of each sum."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [(ways[k] if k < len(ways) else 0) + (ways[k - rank] if k >= rank else 0) for k in range(len(ways) + rank)]
    return sum(ways[max(0, math.ceil(w)) :]) / 2.0**n


def signed_rank(margins: DataFrame, exact: int = 50) -> DataFrame:
    """n, w_plus, the tie-corrected z and the one-sided p (greater) of Wilcoxon's test; zero margins are dropped.

    p is exact for up to ``exact`` differences without ties and zeros, and normal otherwise.
    """
    sizes = margins.where("margin <> 0").select(F.abs("margin").alias("size"), (F.col("margin") > 0).cast("long").alias("up"))
    tied = sizes.groupBy("size").agg(F.count("*").alias("t"), F.sum("up").alias("up"))  # one row a distinct size
    ranked = positions(tied, [], [F.col("size")], "place", {"before": "t"}).withColumn("rank", F.col("before") + (F.col("t") + 1).cast("double") / F.lit(2.0))
    n = F.sum("t").cast("double")
    w = F.sum(F.col("rank") * F.col("up"))
    ties = F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t"))
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - ties / F.lit(2.0)) / F.lit(24.0))
    counted = ranked.agg(F.sum("t").alias("n"), w.alias("w_plus"), ((w - n * (n + 1) / F.lit(4.0)) / spread).alias("z"), (F.max("t") > 1).alias("tied"))
    zeros = margins.agg(F.count_if(F.col("margin") == 0).alias("zeros"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for count, w_plus, z, tie, zero in zip(*(b.column(c).to_pylist() for c in ("n", "w_plus", "z", "tied", "zeros"))):
                p.append(None if not count else exact_tail(w_plus, count) if count <= exact and not tie and not zero else 0.5 * math.erfc(z / math.sqrt(2)))
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("w_plus"), b.column("z"), pa.array(p, pa.float64())], names=["n", "w_plus", "z", "p"])

    return counted.crossJoin(zeros).mapInArrow(run, "n long, w_plus double, z double, p double")  # two single rows


def quantiles(rows: DataFrame, column: str) -> DataFrame:
    """min, p10, p25, median, p75, p90, max, mean, with linear interpolation."""
    pick = lambda q: F.expr(f"percentile({column}, {q})")
    names: list[Column] = [pick(q).alias(k) for k, q in (("min", 0.0), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", 1.0))]
    return rows.agg(*names, F.avg(column).alias("mean"))
