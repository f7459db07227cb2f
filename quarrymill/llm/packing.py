"""Best-fit packing: best-two-fit over token pieces.

Every document becomes its token ids and an end mark; only documents longer than a sequence are cut, into
full pieces and one last piece. Each bin is filled greedily with the longest piece that still fits; then its
smallest piece gives way to two unpacked pieces, if two exist that fit the gap and its room together more
tightly. Lengths available are bits of one integer, so a fit or a pair of fits is a few word operations.

Pieces are dealt at random, by hash, into groups of about ``GROUP``; each group is packed by one task in
bounded memory and wastes at most its last bins. Token ids do not travel with the lengths.

Null text counts as empty and gives one piece with the end mark alone. Rows that repeat a doc_id are packed
each on its own. A table without rows gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import dealing
from quarrymill.llm.kernels import runs
from quarrymill.llm.windows import compact
from quarrymill.runtime import prepare, stage, table

CAPACITY = 4096
END = 1
GROUP = 40_000
#: Words whose ids a Python worker keeps, and the longest of them.
CACHED, LONGEST = 700_000, 64
MARKS = b".,!?;:*%$#&|"
#: Words of small letters that neither normal forms nor lowering change.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: New words that the tokenizer takes at once.
TOGETHER = 5000
_state = dealing.kept


def default_path() -> str:
    """The vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts (uint32, little-endian), and the n + 1 places where those of each begin and end.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words. A batch's
    words are told apart by Arrow, so that each is looked up once.
    """
    cache = _state.get(path)
    if cache is None:
        _prepare(path)
        cache = _state[path]
    # the tokenizer lowers all but its special tokens; done here, more words are the same
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    parts = [b"" if w == b"" else cache.get(w) for w in words]
    new = [k for k, x in enumerate(parts) if x is None]
    for i in range(0, len(new), TOGETHER):
        if len(cache) > CACHED:
            cache.clear()
        some = new[i : i + TOGETHER]
        found = _learned({words[k] for k in some}, cache, path)
        for k in some:
            parts[k] = found[words[k]] if words[k] in found else cache[words[k]]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    each = sizes[codes]
    ids = np.frombuffer(b"".join(parts), "<u4")[runs(starts[codes], each)]
    return ids, np.concatenate([[0], np.cumsum(each)])[lists.offsets.to_numpy()]


def _prepare(path: str) -> None:
    """What a worker keeps for a vocabulary: the words' ids, the tokenizer, the same without what small letters don't
    need, and a flag for each token that ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    _state[path, "tokenizer"] = Tokenizer.from_file(path)
    plain = _state[path, "plain"] = Tokenizer.from_file(path)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokens = plain.get_vocab()
    last = _state[path, "last"] = np.zeros(max(tokens.values()) + 1, bool)
    last[[k for token, k in tokens.items() if token.endswith("</w>")]] = True
    _state[path] = {}


def _learned(missing: set[bytes], cache: dict[bytes, bytes], path: str) -> dict[bytes, bytes]:
    """The ids of words that are not in the cache, which takes them."""
    # marks behind a letter are tokens of their own, so a word and its marks can be looked up apart
    split = {w: (core, w[len(core) :]) for w in missing if w[-1] in MARKS and (core := w.rstrip(MARKS)) and chr(core[-1]).isalpha() and core[-1] < 128}
    fresh = (missing.difference(split) | {x for pair in split.values() for x in pair}).difference(cache)
    found: dict[bytes, bytes] = {}
    plain, other = [], []
    for w in fresh:
        (plain if LETTERS.fullmatch(text := w.decode()) else other).append((w, text))
    if plain:
        # nothing changes such words, and a run of letters stays whole; so they go as one text, of which the tokens that
        # end a word tell them apart
        ids = np.array(_state[path, "plain"].encode_batch_fast([" ".join([x for _, x in plain])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(_state[path, "last"][ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the vocabulary does not end every word with a token that ends in </w>")
        data, at = ids.tobytes(), 0
        for (w, _), end in zip(plain, (4 * ends).tolist()):
            found[w] = data[at:end]
            at = end
    if other:
        encoded = _state[path, "tokenizer"].encode_batch_fast([x for _, x in other], add_special_tokens=False)
        found |= {w: array("I", e.ids).tobytes() for (w, _), e in zip(other, encoded)}
    for w, (core, marks) in split.items():
        found[w] = (found[core] if core in found else cache[core]) + (found[marks] if marks in found else cache[marks])
    cache.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
    return found


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian uint32, binary) of every piece."""
    prepare(docs.sparkSession)
    path = path or default_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            found, places = text_ids(b.column("text"), path)
            data = memoryview(found.tobytes())
            for doc_id, first, last in zip(b.column("doc_id").to_pylist(), (4 * places[:-1]).tolist(), (4 * places[1:]).tolist()):
                ids = bytes(data[first:last]) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
                size += len(ids)
                if size > 8_000_000:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each length (1 to ``capacity``)."""
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    waiting = [order[bounds[k] : bounds[k + 1]].tolist() for k in range(capacity + 1)]
    free = mirror = 0  # bit k of free, bit capacity - k of mirror: a piece of length k is unpacked
    for k in range(1, capacity + 1):
        if waiting[k]:
            free |= 1 << k
            mirror |= 1 << (capacity - k)

    def take(k: int) -> int:
        nonlocal free, mirror
        item = waiting[k].pop()
        if not waiting[k]:
            free &= ~(1 << k)
            mirror &= ~(1 << (capacity - k))
        return item

    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    while free:
        held = []
        gap = capacity
        while fits := free & ((1 << (gap + 1)) - 1):
            k = fits.bit_length() - 1
            held.append((k, take(k)))
            gap -= k
        if gap and len(held) > 1 and free:
            small, item = held[-1]
            for total in range(gap + small, small + 1, -1):
                pairs = free & (mirror >> (capacity - total))
                if total % 2 == 0 and pairs >> (total // 2) & 1 and len(waiting[total // 2]) < 2:
                    pairs &= ~(1 << (total // 2))
                if pairs:
                    k = pairs.bit_length() - 1
                    held[-1:] = [(k, take(k)), (total - k, take(total - k))]
                    waiting[small].append(item)
                    free |= 1 << small
                    mirror |= 1 << (capacity - small)
                    break
        at = 0
        for k, item in held:
            bins[item], places[item] = number, at
            at += k
        number += 1
    return bins, places


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The staged rows of ``pieces`` (doc_id, piece, length and more, all small), with sequence_id and offset."""
    prepare(pieces.sparkSession)
    groups = max(1, -(-pieces.count() // group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bins, places = best_two_fit(part.column("length").to_numpy(), capacity)
        part = part.drop_columns(["group"])
        return part.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(places))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every piece of documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed_digests(table(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """All pieces with their places and the CRC-32 of their ids."""
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stage(pieces, "pieces"))


def stage_function(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences that hold all documents."""
    return packed_digests(docs)
