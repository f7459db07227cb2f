"""Near duplicates by character shingles, sentence windows, and the greedy choice of matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.functions import text as T
from quarrymill.runtime import stage


#: Characters of a side up to which its shingles are an index that each task holds (a few dozen bytes a character).
INDEXED = 2_000_000


def near_duplicates(left: DataFrame, right: DataFrame, least: float = 0.5, n: int = 8) -> DataFrame:
    """left_id, right_id, similarity of all pairs (id, text) with Jaccard of shingles >= ``least`` (over 0).

    If the texts of a side are few, their shingles are an index that goes to all tasks, and each row of the other side
    is held against it where it is: nothing of that side is shuffled, and what grows with it is the time alone. If
    both sides are large, shingles are joined (see ``_joined_shingles``).
    """
    if _characters(left) <= INDEXED:
        return _against_index(left, right, ("left_id", "right_id"), least, n)
    right = stage(right.select("id", "text"), "right")
    if _characters(right) <= INDEXED:
        return _against_index(right, left, ("right_id", "left_id"), least, n).select("left_id", "right_id", "similarity")
    return _joined_shingles(left, right, least, n)


def _key() -> Column:
    return T.normalise_key(F.coalesce("text", F.lit("")))


def _characters(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("text"))).first()[0] or 0


def _shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all ``texts`` (none empty), one text after the other, repeated ones too, and how
    many each has; a shorter text is its own only one. Fixed odd multipliers, one a place, and one for the length."""
    factors = np.random.default_rng(8).integers(0, 1 << 63, n + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    codes = np.concatenate([codes, np.zeros(n, codes.dtype)]).astype(np.uint64)
    sums = np.full(len(codes) - n, factors[n] * np.uint64(n), np.uint64)
    for k in range(n):
        sums += codes[k : k + len(sums)] * factors[k]
    counts = np.maximum(sizes - n + 1, 1)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    out = sums[at]
    for row in np.flatnonzero(sizes < n):
        m = int(sizes[row])
        out[counts[:row].sum()] = (codes[begins[row] : begins[row] + m] * factors[:m]).sum() + factors[n] * np.uint64(m)
    return out, counts


def _index(texts: list[str], n: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingles of all texts, where the list of texts of each begins, these lists, the texts' sizes, and
    a table of the shingles' upper bits."""
    hashes, counts = _shingles(texts, n)
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[once], rows[once]
    grams, begins = np.unique(hashes, return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[grams >> np.uint64(42)] = True
    return grams, np.append(begins, len(hashes)), rows, np.bincount(rows, minlength=len(texts)), seen


def _against_index(few: DataFrame, many: DataFrame, names: tuple[str, str], least: float, n: int) -> DataFrame:
    """The pairs, with the ids named by ``names``, from an index of the texts of ``few``; equal ones are in it once."""
    members = few.select(F.col("id").alias(names[0]), _key().alias("t")).where("t <> ''").withColumn("set", F.md5("t"))
    held = members.groupBy("set").agg(F.first("t").alias("t")).collect()  # few by the bound
    kind = many.schema["id"].dataType
    out = StructType().add(names[1], kind).add("set", "string").add("similarity", "double")
    if not held:
        return members.select(names[0], "set").join(many.sparkSession.createDataFrame([], out), "set").drop("set")
    sets = [r["set"] for r in held]
    shared = many.sparkSession.sparkContext.broadcast(_index([r["t"] for r in held], n))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, begins, lists, sizes, seen = shared.value
        fewest = least * sizes.min() - 1e-9
        for b in batches:
            if not b.num_rows:
                continue
            hashes, counts = _shingles(b.column("t").to_pylist(), n)
            ends = np.cumsum(counts)
            hit = np.flatnonzero(seen[hashes >> np.uint64(42)])
            at = np.minimum(np.searchsorted(grams, hashes[hit]), len(grams) - 1)
            there = grams[at] == hashes[hit]
            # the distinct shingles of each row that the index has
            met = np.unique(np.searchsorted(ends, hit[there], "right") * len(grams) + at[there])
            row = met // len(grams)
            common = np.bincount(row, minlength=b.num_rows)
            first = np.cumsum(common) - common
            found: list[tuple[int, int, float]] = []
            # a pair that similar has so many of either side in common
            for r in np.flatnonzero(common >= fewest):
                size = len(np.unique(hashes[ends[r] - counts[r] : ends[r]]))
                if common[r] < least * size - 1e-9:
                    continue
                mine = met[first[r] : first[r] + common[r]] - r * len(grams)
                lengths = begins[mine + 1] - begins[mine]
                place = np.arange(lengths.sum()) + np.repeat(begins[mine] - (np.cumsum(lengths) - lengths), lengths)
                both = np.bincount(lists[place], minlength=len(sizes))
                similar = both / (sizes + size - both)
                found += [(r, k, similar[k]) for k in np.flatnonzero(similar >= least)]
            if found:
                rows, k, similar = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array([sets[x] for x in k], pa.string()), pa.array(similar, pa.float64())], names=out.names)

    found = many.select("id", _key().alias("t")).where("t <> ''").mapInArrow(meet, out)
    return found.join(members.select(names[0], "set"), "set").select(*names, "similarity")


def _joined_shingles(left: DataFrame, right: DataFrame, least: float, n: int) -> DataFrame:
    """The pairs of two large sides.

    Equal texts are one set, so copies are joined back at the end and never meet each other's shingles. Shingles are
    64-bit hashes, ordered by rarity over both sides; a pair that similar shares one among the first
    size - ceil(least * size) + 1 of each side. Only those are joined, where the sizes allow it; the place of the first
    common one bounds what a pair can share. What is left is verified on the whole sets.
    """
    key = _key()
    rows = left.select(F.lit(0).alias("side"), "id", F.md5(key).alias("set"), key.alias("t")).union(right.select(F.lit(1), "id", F.md5(key), key)).where("t <> ''")
    members = stage(rows, "texts")
    hashed = F.array_distinct(F.transform(T.char_grams("t", n), lambda g: F.xxhash64(g)))
    sets = members.groupBy("set").agg(F.first("t").alias("t"), F.min("side").alias("lowest"), F.max("side").alias("highest")).withColumn("s", hashed)
    sets = stage(sets.select("set", "s", F.size("s").alias("n"), "lowest", "highest"), "shingles")
    each = sets.select("set", "lowest", "highest", F.explode("s").alias("s"))
    # what one side alone holds joins nothing
    df = each.groupBy("s").agg(F.count("*").alias("df"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")).where("lowest = 0 and highest = 1 and df > 1").select("s", "df")
    # a set's shingles in one row, rare ones first; those of one side alone are rarest and only take up places
    shared = each.select("set", "s").join(df, "s").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    most = F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1 - alone
    prefix = sets.select("set", "n", "lowest", "highest").join(shared, "set").withColumns({"alone": alone, "most": most}).where("most > 0")
    prefix = prefix.select("set", "n", "alone", "lowest", "highest", F.posexplode(F.slice("shared", 1, F.col("most"))).alias("place", "x"))
    prefix = stage(prefix.select("set", "n", "lowest", "highest", (F.col("place") + F.col("alone")).alias("place"), F.col("x.s").alias("s")), "prefix")
    a = prefix.where("lowest = 0").select("s", F.col("set").alias("a"), F.col("n").alias("n0"), F.col("place").alias("p0"))
    b = prefix.where("highest = 1").select("s", F.col("set").alias("b"), F.col("n").alias("n1"), F.col("place").alias("p1"))
    fits = F.least("n0", "n1").cast("double") >= F.greatest("n0", "n1") * F.lit(least)
    met = a.join(b, "s").where(fits).groupBy("a", "b", "n0", "n1").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    # up to the first common shingle none is common, so no more than the shorter rest can be
    needed = F.lit(least / (1 + least)) * (F.col("n0") + F.col("n1")) - 1e-9
    pairs = met.where(F.least(F.col("n0") - F.col("p0"), F.col("n1") - F.col("p1")) >= needed)
    whole = lambda name: sets.select(F.col("set").alias(name), F.col("s").alias(f"{name}_s"))
    found = pairs.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", T.jaccard("a_s", "b_s").alias("similarity")).where(F.col("similarity") >= least)
    # a text of both sides is its own pair; it shares every shingle, so the join has found it if any are held twice
    own = sets.where("lowest < highest").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
    found = found.where("a <> b").unionByName(own)
    of = lambda side, name, by: members.where(F.col("side") == side).select(F.col("id").alias(name), F.col("set").alias(by))
    return found.join(of(0, "left_id", "a"), "a").join(of(1, "right_id", "b"), "b").select("left_id", "right_id", "similarity")


def sentence_windows(pages: DataFrame, target: int, least: int = 15, relative: float = 0.1, texts: bool = False) -> DataFrame:
    """page_id, first, last, words (and the text, if ``texts``): runs of whole sentences whose words lie within the tolerance of ``target``.

    ``pages``: page_id, opening (normalised). All runs of a page are found in its row: from each first sentence
    the running totals decide.
    """
    tolerance = max(least, round(target * relative))
    low, high = target - tolerance, target + tolerance
    rows = pages.select("page_id", T.sentences("opening").alias("s")).withColumn("w", F.transform("s", T.word_count)).where(F.size("w") > 0)
    ends = F.aggregate("w", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("p", ends)
    runs = rows.select("page_id", "s", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("first"))
    runs = runs.select("page_id", "first", "s", "p", F.explode(F.filter(F.sequence(F.col("first") + 1, F.size("p") - 1), lambda e: (F.get("p", e) - F.get("p", F.col("first"))).between(low, high))).alias("last"))
    text = [F.array_join(F.slice("s", F.col("first") + 1, F.col("last") - F.col("first")), " ").alias("text")] if texts else []
    return runs.select("page_id", "first", "last", (F.get("p", F.col("last")) - F.get("p", F.col("first"))).alias("words"), *text)


def candidate_copies(candidates: DataFrame, passages: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """``candidates`` (passage_id, page_id, ...) with ``copy``: the page is a near duplicate of its passage, and ``copies``:
    the other candidate pages that are near duplicates of it. ``passages`` and ``pages``: id, text."""
    pool = stage(pages.join(candidates.select(F.col("page_id").alias("id")).distinct(), "id", "left_semi").select("id", "text"), "pool")
    asked = passages.join(candidates.select(F.col("passage_id").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    own = near_duplicates(asked, pool, least).select(F.col("left_id").alias("passage_id"), F.col("right_id").alias("page_id"), F.lit(True).alias("copy"))
    others = near_duplicates(pool, pool, least).where("left_id <> right_id").groupBy(F.col("left_id").alias("page_id")).agg(F.collect_set("right_id").alias("copies"))
    return candidates.join(own, ["passage_id", "page_id"], "left").join(others, "page_id", "left").na.fill(False, ["copy"])


def greedy_matches(candidates: DataFrame, floor: float) -> DataFrame:
    """passage_id, page_id, score, reason: passages in order take their best unused page of ``semantic`` >= floor.

    ``candidates``: passage_id, ord, page_id, semantic, score (page_id null for a passage without any), and copy
    and copies (see ``candidate_copies``) where near duplicates of the passage or of accepted pages are to be
    dropped. The choice is sequential by nature: one task takes the scored rows, sorted by Spark, as they stream by,
    and keeps the pages that are used; all scoring is done before.
    """
    texts = "copies" in candidates.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[str] = set()
        now, found, free = None, None, 0
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((now[1], *(found or (None, None)), "matched" if found else "below_floor" if free else "no_candidates"))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string()))], names=["passage_id", "page_id", "score", "reason"])

        for b in batches:
            copied = b.column("copy").to_pylist() if texts else [False] * b.num_rows
            near = b.column("copies").to_pylist() if texts else [None] * b.num_rows
            for order, passage, page, semantic, score, copy, copies in zip(*(b.column(c).to_pylist() for c in ("ord", "passage_id", "page_id", "semantic", "score")), copied, near):
                if (order, passage) != now:
                    close()
                    now, found, free = (order, passage), None, 0
                if page is None or copy or (page in used and (found is None or page != found[0])):
                    continue
                free += 1
                if found is None and semantic is not None and semantic >= floor:
                    found = page, float(score)
                    used.add(page)
                    used.update(copies or ())
            if len(out) > 5000:
                yield batch()
        close()
        yield batch()

    columns = ["ord", "passage_id", "page_id", "semantic", "score", *(["copy", "copies"] if texts else [])]
    ordered = candidates.select(columns).repartition(1).sortWithinPartitions("ord", "passage_id", F.desc("score"), "page_id")
    return ordered.mapInArrow(walk, "passage_id string, page_id string, score double, reason string")
