"""MinHash near-dedup with tensored banding.

A document's set holds its distinct word shingles (ASCII upper case lowered, words ``[^\\x20\\x09-\\x0D]+``).
Two collections of ``BANDS`` short keys are made from ``ROWS`` minhashes each; a table key joins one key of the
first collection with one of the second, so ``BANDS**2`` tables cost ``2 * BANDS * ROWS`` minhashes. A pair of
similarity s meets in no table with a chance below ``2 * (1 - s**ROWS)**BANDS``: 7e-5 at s = 0.8.

1. Every text is read: set size, set digest and signature. Equal sets form one class.
2. Table keys of the classes are dealt as packed arrays; a bucket links each member to its smallest one.
3. Candidates are verified on full sets (centres with many partners are salted), and linked sets form
   components.
4. Buckets that still hold several components are gone through again: each class outside the bucket's main
   component is set against all members of other components. Shingles that no other set of such buckets holds
   bound exactly what two sets can share; pairs within that bound are verified in the bucket, on what their sets
   share. So no pair that shares a bucket is left out, unless its two sides are one component already.

Null and empty texts and texts of only whitespace have an empty set: they are linked with nothing, not even
with each other. A null doc_id counts as smaller than all others (see rows). Rows that repeat a doc_id are documents of
their own, with equal texts copies like any other. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import kernels as K
from quarrymill.llm.dealing import Dealer, by_part, released, to_owners
from quarrymill.llm.rows import identified, real_id, rows_named, text_key
from quarrymill.llm.windows import compact
from quarrymill.operators.graph import connected_components
from quarrymill.runtime import partitions, prepare, stage, table

BANDS = 10
ROWS = 2
SHINGLE = 4
#: Least similarity of a link, in hundredths.
LEAST = 80
#: Partners that one task verifies against a centre.
SALT = 2000
#: Minhashes of the tables.
TABLE = 2 * BANDS * ROWS
_RNG = np.random.default_rng(20240117)
_A = _RNG.integers(0, 1 << 63, TABLE, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TABLE, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_rows(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, and the n + 1 offsets of the rows among them."""
    raw = _LOWER[raw]
    s, e, rows = K.words(raw, offsets)
    values = K.word_hashes(raw, s, e)
    counts = np.diff(rows)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    grams = K.gram_hashes(values, k)
    hashes = np.zeros(out[-1], np.uint64)
    inside = np.flatnonzero(counts >= k)
    first = np.repeat(rows[inside] - out[inside], sizes[inside])
    place = np.repeat(counts >= k, sizes)
    hashes[place] = grams[np.flatnonzero(place) + first]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        hashes[out[r]] = K.mix(K.gram_hashes(values[rows[r] : rows[r + 1]], int(counts[r])) + np.uint64(counts[r]))[0]
    return hashes, out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minhashes of the (non-empty) rows, a row each."""
    out = np.empty((len(offsets) - 1, TABLE), np.uint64)
    for j in range(TABLE):
        out[:, j] = np.minimum.reduceat((hashes ^ _B[j]) * _A[j], offsets[:-1])
    return out


def table_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS * BANDS table keys for each signature row."""
    halves = signature.reshape(len(signature), 2, BANDS, ROWS)
    keys = K.gram_hashes(np.ascontiguousarray(halves).reshape(-1), ROWS)[::ROWS].reshape(len(signature), 2, BANDS)
    number = np.arange(BANDS * BANDS, dtype=np.uint64)
    both = keys[:, 0, :, None] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1, None, :]
    return K.mix(both.reshape(len(signature), -1) + number)


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """Staged: doc_id, text_key, n (set size), two halves of the set's digest, and the signature (once a set and task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            ids, texts = b.column("doc_id"), b.column("text_key")
            for i, j in K.chunks(offsets):
                hashes, rows = shingle_rows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sets = [np.unique(hashes[a:e]) for a, e in zip(rows[:-1], rows[1:])]
                sizes = np.array([len(x) for x in sets])
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                new = [r for r, d in enumerate(digests) if sizes[r] and not (d in seen or seen.add(d))]
                signature: list[bytes | None] = [None] * len(sets)
                if new:
                    flat = np.concatenate([sets[r] for r in new])
                    for r, x in zip(new, signatures(flat, np.concatenate([[0], np.cumsum(sizes[new])]))):
                        signature[r] = x.tobytes()
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids[i:j], texts[i:j], pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(signature, pa.binary())], names=["doc_id", "text_key", "n", "h1", "h2", "signature"])

    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    return stage(keyed.mapInArrow(compact(run), "doc_id long, text_key long, n long, h1 long, h2 long, signature binary"), "signatures")


def buckets(sets: DataFrame) -> DataFrame:
    """Staged rows of two kinds: candidate pairs (key null) and the members (a) of buckets of three or more."""
    parts = partitions(sets.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts, ["keys", "ids"])
        for b in batches:
            ids = b.column("id").to_numpy()
            keys = table_keys(np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint64).reshape(len(ids), -1)).ravel()
            if dealer.add(keys, np.repeat(ids, BANDS * BANDS)):
                yield dealer.packed(dealer.gathered())
        yield from dealer.rest()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in by_part(batches, {"keys": np.uint64, "ids": np.int64}):
            by = np.lexsort([ids, keys])
            keys, ids = keys[by], ids[by]
            head = np.append(True, keys[1:] != keys[:-1])
            number = np.cumsum(head) - 1
            size = np.bincount(number)[number]
            centre = ids[np.flatnonzero(head)][number]
            pairs = np.unique(np.stack([centre, ids], 1)[ids != centre], axis=0)
            big = size > 2
            for i in range(0, len(pairs), 20_000):
                p = pairs[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["key", "a", "b"])
            k, m = keys[big].view(np.int64), ids[big]
            for i in range(0, len(k), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 20_000]), pa.array(m[i : i + 20_000]), pa.nulls(len(m[i : i + 20_000]), pa.int64())], names=["key", "a", "b"])

    dealt = to_owners(sets.mapInArrow(released(deal), "part int, keys binary, ids binary"))
    return stage(dealt.mapInArrow(released(meet), "key long, a long, b long"), "buckets")


def full_sets(docs: DataFrame, sets: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Staged: id, n and the whole set (sorted uint64, packed) of the sets named in ``ids``, read anew from a text of each."""
    # the named sets grow with the table, so they are never broadcast
    wanted = sets.select("id", F.col("rep").alias("doc_id"), "text_key").join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).join(wanted.hint("merge"), ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            for i, j in K.chunks(offsets):
                hashes, rows = shingle_rows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sets = [np.unique(hashes[x:y]) for x, y in zip(rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([b.column("id")[i:j], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n", "data"])

    return stage(rows.select("id", "text").mapInArrow(compact(run), "id long, n long, data binary").dropDuplicates(["id"]), "fullsets")


def verified(sets: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Staged: the pairs (centre a, partner b) with 100 * intersection >= least * union, on full sets."""
    spark = sets.sparkSession
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    partner = pairs.join(counted, "a").select(F.col("b").alias("id"), F.col("a").alias("centre"), F.pmod(F.hash("b"), "salts").alias("salt"), F.lit(True).alias("partner"))
    centre = counted.select(F.col("a").alias("id"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("partner"))
    rows = sets.select("id", "data").join(partner.union(centre).hint("merge"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for b in batches:
            found = []
            for c, partner, doc_id, data in zip(*(b.column(x).to_pylist() for x in ("centre", "partner", "id", "data"))):
                other = np.frombuffer(data, np.uint64)
                if not partner:
                    centre, own = c, other
                    continue
                if c != centre:
                    continue
                small, large = sorted((len(own), len(other)))
                if 100 * small < least * large:
                    continue
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= least * (small + large - common):
                    found.append((c, doc_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["src", "dst"])

    dealt = rows.select("centre", "salt", "partner", "id", "data").repartition(partitions(spark), "centre", "salt").sortWithinPartitions("centre", "salt", "partner")
    return stage(dealt.mapInArrow(released(compare), "src long, dst long"), "links")


def lonely(sets: DataFrame) -> DataFrame:
    """id and own: how many of its shingles no other set of ``sets`` (id, data) holds; ids without any are left out."""
    parts = partitions(sets.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts, ["keys", "ids"])
        for b in batches:
            ids = b.column("id").to_numpy()
            lists = [np.frombuffer(x, np.uint64) for x in b.column("data").to_pylist()]
            for i in range(0, len(lists), 200):
                group = lists[i : i + 200]
                if dealer.add(np.concatenate(group), np.repeat(ids[i : i + 200], [len(x) for x in group])):
                    yield dealer.packed(dealer.gathered())
        yield from dealer.rest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, ids in by_part(batches, {"keys": np.uint64, "ids": np.int64}):
            _, where, times = np.unique(values, return_index=True, return_counts=True)
            doc, n = np.unique(ids[where[times == 1]], return_counts=True)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n)], names=["id", "own"])

    dealt = to_owners(sets.select("id", "data").mapInArrow(released(deal), "part int, keys binary, ids binary"))
    return dealt.mapInArrow(compact(count), "id long, own long").groupBy("id").agg(F.sum("own").alias("own"))


def stray_links(mixed: DataFrame, least: int) -> DataFrame:
    """Staged: links (src, dst) of different components that share a bucket, enough to join all that are similar.

    ``mixed``: key, id, component, main (the bucket's largest component), signature, data (the whole set), n and
    own (see ``lonely``). Only pairs with a side outside the main component count. A pair is looked at in the first
    table in which it meets. What two sets can share is bounded by min(n - own); pairs within that are counted
    exactly: the bucket's shingles get numbers, and a set's numbers are marked for all its partners. Components
    that a link of the bucket has joined are one from then on. A bucket's sets are in memory at once.
    """

    def links_of(key: int, ids: list, comps: list, mains: list, signature: list, data: list, n: list, own: list) -> Iterator[pa.RecordBatch]:
        keys = table_keys(np.frombuffer(b"".join(signature), np.uint64).reshape(len(ids), -1)).view(np.int64)
        number = int(np.flatnonzero(keys[0] == key)[0])
        ids, n = np.array(ids), np.array(n)
        _, comps = np.unique(np.array([*comps, mains[0]]), return_inverse=True)
        comps, main = comps[:-1].copy(), comps[-1]
        shared = n - np.array(own)
        values, flat = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
        flat = flat.astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in data])])
        marks = np.zeros(len(values), bool)
        stray = comps != main
        src, dst = [], []
        for a in np.flatnonzero(stray):
            both = np.minimum(shared[a], shared)
            wanted = (comps != comps[a]) & (~stray | (ids[a] < ids)) & (100 * both >= least * (n[a] + n - both))
            found = np.flatnonzero(wanted)
            found = found[(keys[found] == keys[a]).argmax(1) == number]
            if not len(found):
                continue
            marks[flat[offsets[a] : offsets[a + 1]]] = True
            for b in found:
                if comps[b] != comps[a]:
                    common = int(np.count_nonzero(marks[flat[offsets[b] : offsets[b + 1]]]))
                    if 100 * common >= least * (n[a] + n[b] - common):
                        src.append(ids[a])
                        dst.append(ids[b])
                        comps[comps == comps[b]] = comps[a]
            marks[flat[offsets[a] : offsets[a + 1]]] = False
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "id", "component", "main", "signature", "data", "n", "own"))):
                if held and held[0][0] != row[0]:
                    yield from links_of(held[0][0], *zip(*[r[1:] for r in held]))
                    held = []
                held.append(row)
        if held:
            yield from links_of(held[0][0], *zip(*[r[1:] for r in held]))

    dealt = mixed.repartition(partitions(mixed.sparkSession), "key").sortWithinPartitions("key")
    return stage(dealt.mapInArrow(compact(run), "src long, dst long"), "strays")


def components(docs: DataFrame, shingle: int, least: int) -> DataFrame:
    """doc_id, text_key, n of every row, the number of its component (null for empty sets) and the component's smallest id.

    ``docs`` is what ``identified`` returns. Sets have numbers of their own, so rows that share an id and differ in
    text are documents of their own.
    """
    rows = summaries(docs, shingle)
    first = F.min(F.struct("doc_id", "text_key"))
    sets = rows.where("n > 0").groupBy("h1", "h2", "n").agg(first.alias("first"), F.max("signature").alias("signature"))
    sets = stage(sets.select("h1", "h2", "n", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "signature", F.monotonically_increasing_id().alias("id")), "sets")
    met = buckets(sets.select("id", "signature"))
    pairs = stage(met.where("key is null").select("a", "b").distinct(), "pairs")
    involved = full_sets(docs, sets, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), shingle)
    links = verified(involved, pairs, least)
    labels = connected_components(links)
    members = met.where("key is not null").select("key", F.col("a").alias("id"))
    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    shares = named.groupBy("key", "component").agg(F.count("*").alias("share"))
    mains = shares.groupBy("key").agg(F.max_by("component", F.struct("share", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    mixed = stage(named.join(mains, "key"), "mixed")
    if not mixed.isEmpty():
        seen = mixed.select("id").distinct()
        alone = lonely(involved.join(seen.hint("merge"), "id", "left_semi"))
        facts = seen.join(involved.select("id", "data").hint("merge"), "id").join(sets.select("id", "n", "signature").hint("merge"), "id").join(alone.hint("merge"), "id", "left").na.fill(0, ["own"])
        more = stray_links(mixed.join(facts.hint("merge"), "id").select("key", "id", "component", "main", "signature", "data", "n", "own"), least)
        if not more.isEmpty():
            labels = connected_components(links.union(more))
    labels = stage(labels.join(sets.select("id", "rep"), "id"), "labels")  # linked sets only
    lowest = labels.groupBy("component").agg(F.min("rep").alias("lowest"))
    told = sets.join(labels.join(lowest, "component").select("id", "component", "lowest"), "id", "left")
    told = told.select("h1", "h2", "n", F.coalesce("component", "id").alias("component"), F.coalesce("lowest", "rep").alias("component_id"))
    return rows.select("doc_id", "text_key", "h1", "h2", "n").join(told, ["h1", "h2", "n"], "left").select("doc_id", "text_key", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 5, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    prepare(docs.sparkSession)
    rows = components(identified(docs), shingle, least)
    return rows.select(real_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_shingles, component_id, kept; shingles of four words."""
    return near_dedup(table(spark, sf_dir, "documents"), SHINGLE)


def stage_function(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of near duplicates stays (five-word shingles), one of its smallest id."""
    prepare(spark)
    rows = components(identified(docs), 5, LEAST).where("doc_id = component_id")
    linked = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("row.doc_id", "row.text_key")
    names = linked.union(rows.where("component is null").select("doc_id", "text_key"))
    return rows_named(docs, names.select(real_id("doc_id").alias("doc_id"), "text_key"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
