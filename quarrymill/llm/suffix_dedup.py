"""Suffix-array dedup: byte strings of ``WIDTH`` that start in two places are removed from both.

Candidates (see windows) are dealt by anchor; each partition builds the suffix order and the
Burrows-Wheeler transform of the distinct contents and finds by breadth-first backward extension, in
increasing order, all common prefixes below ``WIDTH``. What is still unknown then are the groups of suffixes
that share ``WIDTH`` bytes or more. A group counts if its contents stand for two occurrences or more.

Null text counts as empty; a null doc_id is one more document, see rows. Equal texts are one class, whatever their
ids: of two or more copies every byte goes if the text has ``WIDTH`` bytes at least, and nothing else. So rows that
repeat id and text lose their text, and rows that repeat an id with other texts are documents of their own. Shorter
texts are kept. Matches never cross documents. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import indexes, windows
from quarrymill.llm.rows import identified, real_id
from quarrymill.runtime import prepare, table

WIDTH = 200
UNIT = windows.Unit(words=False, width=WIDTH, gram=100, fine=50)
#: Bytes of contents that are indexed together.
INDEX = 400_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def repeated(contents: list[bytes], ids: np.ndarray, weights: np.ndarray) -> list[bytes | None]:
    """For each content the runs (first window, last window) of windows that occur twice, packed as int64."""
    lengths = np.array([len(c) for c in contents])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    number = np.zeros(256, np.uint8)
    present = np.unique(data)
    number[present] = np.arange(1, len(present) + 1)
    symbols = number[data]
    symbols[starts[1:] - 1] = 0
    order, fresh = indexes.common_prefix_groups(symbols, WIDTH)
    of = np.repeat(np.arange(len(contents)), lengths + 1)
    room = (starts[of + 1] - 1 - np.arange(len(symbols))) >= WIDTH
    fits = room[order]
    group = np.cumsum(fresh)[fits]
    start = order[fits]
    total = np.bincount(group, np.minimum(weights, 2)[of[start]])
    twice = np.zeros(len(symbols) + 1, bool)
    twice[start[total[group] >= 2]] = True
    head = np.flatnonzero(twice[:-1] & ~np.append(False, twice[:-2]))
    tail = np.flatnonzero(twice[:-1] & ~twice[1:])
    seg = of[head]
    runs = np.stack([head - starts[seg], tail - starts[seg]], 1)
    out: list[bytes | None] = [None] * len(contents)
    for k, packed in windows.packed_runs(seg, runs):
        out[k] = packed
    return out


def _whole(text: bytes, class_size: int) -> tuple:
    n = len(text)
    if class_size > 1 and n >= WIDTH:
        return n, n, 1, _EMPTY
    return n, 0, 0, hashlib.sha256(text).hexdigest()


def _apply(text: bytes, doc_id: int, pairs: list) -> tuple:
    edge = np.zeros(len(text) + 1, np.int32)
    for start, spans in pairs:
        runs = np.frombuffer(spans, np.int64).reshape(-1, 2)
        np.add.at(edge, start + runs[:, 0], 1)
        np.add.at(edge, start + runs[:, 1] + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def texts_left(docs: DataFrame, texts: bool = True, hot: int = windows.HOT) -> tuple[DataFrame, DataFrame]:
    """doc_id and digest of every row; digest, n_bytes, n_removed, n_spans, kept_sha256 and kept of every distinct text."""
    prepare(docs.sparkSession)
    docs = identified(docs)
    rows, groups = windows.classes(docs)
    staged = windows.candidates(docs, groups, UNIT, _whole)
    found = windows.members(staged, windows.indexed(staged, repeated, INDEX, UNIT, hot))
    done = windows.finish(staged, found, groups, _apply, texts)
    kept = F.when((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_units")), F.lit(b"")).otherwise(F.col("kept"))
    return rows, done.select("digest", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", kept.alias("kept"))


def suffix_dedup(docs: DataFrame, texts: bool = True, hot: int = windows.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes left of a changed text."""
    rows, done = texts_left(docs, texts, hot)
    return rows.join(done, "digest").select(real_id("doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def stage_function(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without their repeated bytes.

    What is left depends on the text alone, so rows find it by their text's digest, whatever their ids. A character
    that loses some of its bytes goes as a whole; n_chars follows the text where it is a column.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())], names=["changed", "left_text"])

    changed = texts_left(docs.select("doc_id", "text"))[1].where("n_removed > 0").select("digest", "kept").mapInArrow(decode, "changed binary, left_text string")
    joined = docs.join(changed, F.unhex(F.sha2(docs["text"], 256)) == changed["changed"], "left")
    shown = {"text": F.coalesce(changed["left_text"], docs["text"]), "n_chars": F.coalesce(F.length(changed["left_text"]), docs["n_chars"]) if "n_chars" in docs.columns else None}
    return joined.select(*[shown[c].cast(docs.schema[c].dataType).alias(c) if c in shown else docs[c] for c in docs.columns])
