"""Windows that repeat across a corpus, found exactly: the data flow that substring and suffix-array dedup share.

1. ``classes``: equal texts fall into one class (thin shuffle of digests); only a row of the smallest id goes on.
   Classes have numbers of their own, so rows that share a doc_id and differ in text are documents of their own.
2. ``repeated_segments``: every text is cut into segments (see kernels); anchors seen twice or more are
   candidates. A map task settles anchors that it has seen twice itself and sends one entry of each to the
   anchor's partition, so a passage in every third document costs that partition one entry a map task. What is
   settled goes on to the partitions of the texts' keys, in packed arrays too.
3. ``candidates``: one shuffle of the texts brings each document its candidate segments; the contents of
   these are collapsed within a map task. Documents without candidates have their result here.
4. An index over the distinct contents of each anchor partition (FM-index or Burrows-Wheeler expansion; the
   caller's) tells which windows count, and the members of each content are joined with that. Anchors of many
   contents are cut finer and dealt anew before.
5. ``finish``: spans go back to the texts; rows take over the result of their class by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import kernels as K
from quarrymill.llm.dealing import Dealer, begin, by_part, release, released, to_owners
from quarrymill.runtime import partitions, stage

#: Contents of an anchor (and one more a partition, as each map task sends its own) beyond which it is hot.
HOT = 1000
#: Bytes of distinct contents that a map task gathers before it sends them off.
CONTENTS = 16_000_000


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``words`` or ``bytes``; its width, the width of its grams, and that of the finer grams
    that part hot anchors."""

    words: bool
    width: int
    gram: int
    fine: int


def cut(raw: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Segments of the rows: row, anchor, first unit in its row, may it repeat within, the content's first byte and end."""
    if unit.words:
        s, e, rows = K.words(raw, offsets)
        values = K.word_hashes(raw, s, e)
        grams = K.gram_hashes(values, unit.gram)
        row, first, last, anchor = K.segments(grams, rows, unit.width, unit.gram)
        return row, anchor, first - rows[row], np.zeros(len(row), bool), s[first], e[last + unit.width - 1]
    out: list[tuple[np.ndarray, ...]] = []
    n = len(offsets) - 1
    if n == 1 and len(raw) > 2 * K.PIECE:  # a very long row: pieces that overlap by all but one unit of a window
        for at in range(0, len(raw) - unit.width + 1, K.PIECE):
            part = raw[at : at + K.PIECE + unit.width - 1]
            row, anchor, first, loop, a, b = cut(part, np.array([0, len(part)]), unit)
            out.append((row, anchor, first + at, loop, a + at, b + at))
        return tuple(map(np.concatenate, zip(*out)))
    grams = K.byte_gram_hashes(raw, unit.gram)
    row, first, last, anchor = K.segments(grams, offsets, unit.width, unit.gram)
    loop = K.loops(grams, first, unit.width, unit.gram) if len(row) else np.zeros(0, bool)
    return row, anchor, first - offsets[row], loop, first, last + unit.width


def numbered(row: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal values."""
    if not len(row):
        return row
    at = np.arange(len(row))
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    return at - np.maximum.accumulate(np.where(head, at, 0))


def packed_runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, its values as bytes) for keys that come sorted."""
    if len(keys):
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
            yield int(keys[a]), values[a:b].tobytes()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: doc_id, digest and key (64-bit hash) of every row's text, and digest, key, class (a number of its own),
    rep_id (smallest id) and class_size of every distinct text. ``docs`` is what ``identified`` returns."""
    thin = stage(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("key")), "digests")
    groups = thin.groupBy("digest", "key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("class_size"))
    return thin, stage(groups.withColumn("class", F.monotonically_increasing_id()), "classes")


def repeated_segments(docs: DataFrame, unit: Unit) -> DataFrame:
    """key (hash of a text) and the numbers (uint32, packed) of its segments whose anchors occur elsewhere too.

    Of equal texts within a map task only the first is cut. Texts whose keys collide share their candidates, of
    which the index takes no harm.
    """
    parts = partitions(docs.sparkSession)
    names = ["anchors", "keys", "numbers"]

    def to_keys(key: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        """Entries that are settled, by the owners of their keys."""
        return Dealer(parts, ["keys", "numbers"]).packed([key.view(np.uint64), number])

    def send(dealer: Dealer) -> Iterator[pa.RecordBatch]:
        anchor, key, number, loop = dealer.gathered()
        by = np.argsort(anchor)
        anchor, key, number, loop = anchor[by], key[by], number[by], loop[by]
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = anchor[1:] == anchor[:-1]
        here = same[:-1] | same[1:] | loop  # settled by this task
        sent = ~same[:-1]  # one entry of each anchor
        yield dealer.packed([anchor[sent], key[sent], number[sent]])
        if here.any():
            b = to_keys(key[here], number[here])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.binary()), b.column(1), b.column(2)], names=["part", *names])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        dealer = Dealer(parts, names)
        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            view = memoryview(np.ascontiguousarray(raw))
            digests = [xxhash.xxh3_128_digest(view[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
            new = np.array([not (d in seen or seen.add(d)) for d in digests], bool)
            keys = b.column("key").to_numpy()
            for i, j in K.chunks(offsets):
                row, anchor, _, loop, *_ = cut(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                keep = new[i + row]
                if dealer.add(anchor[keep], keys[i + row[keep]], numbered(row)[keep].astype(np.uint32), loop[keep]):
                    yield from send(dealer)
        if dealer.size:
            yield from send(dealer)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealer(parts, ["keys", "numbers"])

        def entries() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for known, keys, numbers in zip(b.column("anchors").is_valid().to_pylist(), b.column("keys"), b.column("numbers")):
                    if not known:  # settled before
                        out.add(np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(numbers.as_py(), np.uint32))
                yield b.filter(b.column("anchors").is_valid())
                if out.size > out.most:
                    ready.append(out.packed(out.gathered()))

        ready: list[pa.RecordBatch] = []
        for anchor, key, number in by_part(entries(), {"anchors": np.uint64, "keys": np.uint64, "numbers": np.uint32}):
            by = np.argsort(anchor)
            ordered = anchor[by]
            same = np.zeros(len(anchor) + 1, bool)
            same[1:-1] = ordered[1:] == ordered[:-1]
            here = by[same[:-1] | same[1:]]
            if out.add(key[here], number[here]):
                ready.append(out.packed(out.gathered()))
            yield from ready
            ready.clear()
        yield from ready
        yield from out.rest()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, number in by_part(batches, {"keys": np.int64, "numbers": np.uint32}):
            by = np.argsort(key)
            rows = list(packed_runs(key[by], number[by]))
            for i in range(0, len(rows), 5000):
                keys, numbers = zip(*rows[i : i + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.binary())], names=["key", "numbers"])

    sent = docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(released(anchors), "part int, anchors binary, keys binary, numbers binary")
    met = to_owners(sent).mapInArrow(released(settle), "part int, keys binary, numbers binary")
    return to_owners(met).mapInArrow(released(gather), "key long, numbers binary")


def candidates(docs: DataFrame, groups: DataFrame, unit: Unit, whole: Callable[[bytes, int], tuple]) -> DataFrame:
    """Staged rows of three kinds: contents (S), their members (M), and texts (T) or finished results (R).

    ``whole(text, class_size)``: (n units, n removed, n spans, sha256 of what stays) of a text without
    candidates, or None if its copies alone decide nothing.
    """
    reps = groups.join(repeated_segments(docs, unit), "key", "left").select("digest", "class", "class_size", "rep_id", "numbers")
    keyed = docs.select(F.col("doc_id").alias("rep_id"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    # rows that repeat id and text meet here twice; a second time changes nothing
    texts = keyed.join(reps, ["rep_id", "digest"]).select("class", F.col("rep_id").alias("doc_id"), "text", "class_size", "numbers")
    schema = "kind string, anchor long, content long, segment binary, class long, doc_id long, start long, weight long, text string, n_units long, n_removed long, n_spans long, sha string"
    fields = [("kind", pa.string()), ("anchor", pa.int64()), ("content", pa.int64()), ("segment", pa.binary()), ("class", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("weight", pa.int64()), ("text", pa.string()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string())]

    def rows_out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in fields], names=[k for k, _ in fields])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: dict[tuple[int, int], list] = {}
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            items = list(contents.items())
            contents.clear()
            for i in range(0, len(items), 2000):
                part = items[i : i + 2000]
                yield rows_out(len(part), kind=["S"] * len(part), anchor=[k[0] for k, _ in part], content=[k[1] for k, _ in part], segment=[v[0] for _, v in part], doc_id=[v[1] for _, v in part], weight=[v[2] for _, v in part])

        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            ids, numbers_of, sizes, lists = (b.column(c).to_pylist() for c in ("doc_id", "class", "class_size", "numbers"))
            texts: list[int] = []
            results: list[tuple] = []
            for r, (doc_id, number, size, numbers) in enumerate(zip(ids, numbers_of, sizes, lists)):
                text = raw[offsets[r] : offsets[r + 1]]
                result = whole(text.tobytes(), size) if not numbers or (size > 1 and not unit.words) else None
                if result is not None:
                    results.append((number, *result))
                else:
                    texts.append(r)
                if not numbers:
                    continue
                pick = np.unique(np.frombuffer(numbers, np.uint32))
                _, anchor, first, _, a, e = cut(text, np.array([0, len(text)]), unit)
                pick = pick[pick < len(anchor)]
                anchor, first, a, e = anchor[pick].view(np.int64), first[pick], a[pick], e[pick]
                data = text.tobytes()
                hashes = []
                for x, i, j in zip(anchor.tolist(), a.tolist(), e.tolist()):
                    piece = data[i:j]
                    h = xxhash.xxh3_64_intdigest(piece) - (1 << 63)
                    hashes.append(h)
                    if (old := contents.get((x, h))) is None:
                        contents[x, h] = [piece, doc_id, size]
                        held += len(piece) + 500  # with what Python needs to hold it
                    else:
                        old[1], old[2] = min(old[1], doc_id), old[2] + size
                if hashes:
                    yield rows_out(len(hashes), **{"kind": ["M"] * len(hashes), "anchor": anchor, "content": np.array(hashes, np.int64), "class": np.full(len(hashes), number), "start": first})
                if held > CONTENTS:
                    yield from emit()
                    held = 0
            if results:
                c, n, m, k, sha = zip(*results)
                yield rows_out(len(results), **{"kind": ["R"] * len(results), "class": c, "n_units": n, "n_removed": m, "n_spans": k, "sha": sha})
            if texts:
                yield rows_out(len(texts), **{"kind": ["T"] * len(texts), "class": [numbers_of[r] for r in texts], "doc_id": [ids[r] for r in texts], "text": b.column("text").take(pa.array(texts))})
        yield from emit()

    return stage(texts.mapInArrow(compact(extract), schema), "segments")


def compact(function: Callable) -> Callable:
    """``function`` with its small output batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        held, n, size = [], 0, 0
        for b in function(batches):
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n >= 5000 or size > 8_000_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n, size = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        held = []
        release()

    return run


def recut(raw: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Segments cut anew by two more minima over finer grams: row, key, first unit, and the content's first byte and end.

    Equal windows agree in all minima, so they keep meeting under one key.
    """
    if unit.words:
        s, e, rows = K.words(raw, offsets)
        grams = K.gram_hashes(K.word_hashes(raw, s, e), unit.fine)
    else:
        rows = offsets
        grams = K.byte_gram_hashes(raw, unit.fine)
    key = np.zeros(max(0, len(grams) - unit.width + unit.fine), np.uint64)
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        key *= K._Q
        key += K.sliding_min(K.mix(grams ^ np.uint64(seed)), unit.width - unit.fine + 1)
    row, first, last, key = K.stretches(K.mix(key), rows, unit.width)
    key = key ^ anchors[row]
    if unit.words:
        return row, key, first - rows[row], s[first], e[last + unit.width - 1]
    return row, key, first - rows[row], first, last + unit.width


def parted(staged: DataFrame, unit: Unit, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Contents (anchor, content, segment, doc_id, weight) with those of hot anchors cut finer, and their members:
    of_anchor, of_content, start, anchor, content (None if no anchor is hot).

    An anchor of more than ``hot`` contents is a passage that is too short to be a window or lies in ever new
    surroundings. Its windows differ in their surroundings, and two more minima over finer grams part them by these.
    """
    rows = staged.where("kind = 'S'").select("anchor", "content", "segment", "doc_id", "weight")
    heavy = stage(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "heavy")
    if heavy.isEmpty():
        return rows, None
    schema = "of_anchor long, of_content long, start long, anchor long, content long, segment binary, doc_id long, weight long"
    fields = [("of_anchor", pa.int64()), ("of_content", pa.int64()), ("start", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("weight", pa.int64())]

    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in fields], names=[k for k, _ in fields])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: dict[tuple[int, int], list] = {}
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            items = list(contents.items())
            contents.clear()
            for i in range(0, len(items), 2000):
                part = items[i : i + 2000]
                yield out(len(part), anchor=[k[0] for k, _ in part], content=[k[1] for k, _ in part], segment=[v[0] for _, v in part], doc_id=[v[1] for _, v in part], weight=[v[2] for _, v in part])

        for b in batches:
            raw, offsets = K.utf8(b.column("segment"))
            anchors, of, ids, weights = (b.column(c).to_numpy() for c in ("anchor", "content", "doc_id", "weight"))
            for i, j in K.chunks(offsets):
                low = offsets[i]
                data = raw[low : offsets[j]].tobytes()
                row, key, first, a, e = recut(raw[low : offsets[j]], offsets[i : j + 1] - low, anchors[i:j].view(np.uint64), unit)
                row = row + i
                hashes = []
                for k, r, x, y in zip(key.view(np.int64).tolist(), row.tolist(), a.tolist(), e.tolist()):
                    piece = data[x:y]
                    h = xxhash.xxh3_64_intdigest(piece) - (1 << 63)
                    hashes.append(h)
                    if (old := contents.get((k, h))) is None:
                        contents[k, h] = [piece, int(ids[r]), int(weights[r])]
                        held += len(piece) + 500
                    else:
                        old[1], old[2] = min(old[1], int(ids[r])), old[2] + int(weights[r])
                if hashes:
                    yield out(len(hashes), of_anchor=anchors[row], of_content=of[row], start=first, anchor=key.view(np.int64), content=np.array(hashes, np.int64))
                if held > CONTENTS:
                    yield from emit()
                    held = 0
        yield from emit()

    found = stage(rows.join(heavy, "anchor", "left_semi").mapInArrow(compact(finer), schema), "finer")
    cold = rows.join(heavy, "anchor", "left_anti")
    return cold.unionByName(found.where("of_anchor is null").select(*rows.columns)), found.where("of_anchor is not null").select("of_anchor", "of_content", "start", "anchor", "content")


def indexed(staged: DataFrame, search: Callable[[list[bytes], np.ndarray, np.ndarray], list[bytes | None]], most: int, unit: Unit, hot: int = HOT) -> DataFrame:
    """(anchor, content, spans): what ``search(contents, smallest ids, weights)`` says of each distinct content.

    Contents are dealt by anchor, those of hot anchors by finer keys (see ``parted``), and indexed some ``most`` bytes
    at a time. Spans are rows of int64 that begin with a first and a last window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, last = 0, None

        def answer() -> Iterator[pa.RecordBatch]:
            if held:
                spans = search([v[0] for v in held.values()], np.array([v[1] for v in held.values()], np.int64), np.array([v[2] for v in held.values()], np.int64))
                keys = [(k, x) for k, x in zip(held, spans) if x]
                held.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in keys], pa.int64()), pa.array([k[1] for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.binary())], names=["anchor", "content", "spans"])

        for b in batches:
            for anchor, content, segment, doc_id, weight in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "segment", "doc_id", "weight"))):
                if anchor != last:
                    if size > most:
                        yield from answer()
                        size = 0
                    last = anchor
                if (old := held.get((anchor, content))) is None:
                    held[anchor, content] = [segment, doc_id, weight]
                    size += len(segment)
                else:
                    old[1], old[2] = min(old[1], doc_id), old[2] + weight
        yield from answer()

    columns = 3 if unit.words else 2

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of finer contents, at their places in the contents that they were cut from."""
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                runs = []
                for p in parts:
                    r = np.frombuffer(p["spans"], np.int64).reshape(-1, columns).copy()
                    r[:, :2] += p["start"]
                    runs.append(r)
                out.append(np.concatenate(runs).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("content"), pa.array(out, pa.binary())], names=["anchor", "content", "spans"])

    n = partitions(staged.sparkSession)
    rows, finer = parted(staged, unit, hot + n)
    dealt = rows.repartition(n, "anchor").sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(released(run), "anchor long, content long, spans binary")
    if finer is None:
        return spans
    spans = stage(spans, "spans")
    back = finer.join(spans, ["anchor", "content"]).groupBy("of_anchor", "of_content").agg(F.collect_list(F.struct("start", "spans")).alias("parts"))
    back = back.select(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), "parts").mapInArrow(moved, "anchor long, content long, spans binary")
    return spans.unionByName(back)


def members(staged: DataFrame, spans: DataFrame) -> DataFrame:
    """class and the list of (start, spans) of its segments."""
    m = staged.where("kind = 'M'").select("anchor", "content", "class", "start")
    return m.join(spans, ["anchor", "content"]).groupBy("class").agg(F.collect_list(F.struct("start", "spans")).alias("found"))


def finish(staged: DataFrame, found: DataFrame, groups: DataFrame, apply: Callable[[bytes, int, list], tuple], texts: bool) -> DataFrame:
    """A row a distinct text: digest, rep_id, class_size, n_units, n_removed, n_spans, kept_sha256 and kept.

    ``apply(text, rep_id, [(start, spans)])`` gives (n units, n removed, n spans, what stays as bytes).
    ``kept`` holds what stays of a changed text (null for others, and throughout unless ``texts``).
    """
    schema = "class long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, doc_id, text, pairs in zip(*(b.column(c).to_pylist() for c in ("class", "doc_id", "text", "found"))):
                n, m, k, kept = apply(text.encode(), doc_id, [(p["start"], p["spans"]) for p in pairs or ()])
                rows.append((number, n, m, k, hashlib.sha256(kept).hexdigest(), kept if texts and m else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string(), pa.binary()))], names=["class", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"])

    left = staged.where("kind = 'T'").select("class", "doc_id", "text").join(found, "class", "left")
    done = staged.where("kind = 'R'").select("class", "n_units", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    results = left.mapInArrow(compact(run), schema).unionByName(done).dropDuplicates(["class"])  # rows that repeat
    return groups.select("digest", "class", "rep_id", "class_size").join(results, "class").drop("class")
