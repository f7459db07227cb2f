"""Substring dedup: word windows that an earlier document has too are removed.

A window is ``WIDTH`` consecutive words of one document. The stretches of documents that may repeat (see windows) are
dealt by anchor, so all copies of a window are in one shard. Each shard keeps a compressed FM-index over word numbers:
the Burrows-Wheeler transform in a wavelet matrix of packed bits, and the document of every row in the fewest bytes.
The documents' stretches stream past it, and backward search gives the matching statistics of each place, up to the
threshold: how many words that end there occur twice. Intervals at the threshold report the smallest document
among their rows.

Null and empty texts have no words; they come back with nothing removed. A null doc_id counts as smaller
than all others (see rows). Texts shorter than a window are
kept, whatever repeats. Equal texts are one class: all but the rows of the smallest id lose every window. Rows that
repeat an id are not smaller than each other: with equal texts they get the same result, with other texts each
is a document of its own. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import indexes, windows
from quarrymill.llm.rows import identified, real_id
from quarrymill.runtime import prepare, table

WIDTH = 13
UNIT = windows.Unit(words=True, width=WIDTH, gram=7, fine=3)
#: Bytes of contents that are indexed together.
INDEX = 4_000_000
#: Windows that are searched together.
STREAM = 1 << 17
_EMPTY = hashlib.sha256(b"").hexdigest()


def earliest(contents: list[bytes], ids: np.ndarray, weights: np.ndarray) -> list[bytes | None]:
    """For each content the runs (first window, last window, smallest id that has them), packed as int64."""
    by = np.argsort(ids, kind="stable")  # the smallest number of a content is then the smallest id
    found = _earliest([contents[k] for k in by], ids[by], weights[by])
    out: list[bytes | None] = [None] * len(contents)
    for k, x in zip(by, found):
        out[k] = x
    return out


def _earliest(contents: list[bytes], ids: np.ndarray, weights: np.ndarray) -> list[bytes | None]:
    lists = [c.split() for c in contents]
    lengths = np.array([len(x) for x in lists])
    flat = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    numbers = flat.indices.to_numpy().astype(np.int32) + 1
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    of = np.repeat(np.arange(len(contents)), lengths + 1)
    symbols = np.zeros(starts[-1], np.int32)
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(contents)), lengths)] = numbers
    index = indexes.FmIndex(symbols, of, WIDTH, len(flat.dictionary))
    at = np.flatnonzero(starts[of + 1] - 1 - np.arange(len(symbols)) >= WIDTH)
    smallest = ids[of[at]]
    for i in range(0, len(at), STREAM):  # the contents stream past their shard's index
        some = at[i : i + STREAM]
        reach, lo, hi = index.statistics(symbols, some + WIDTH - 1, WIDTH)
        smallest[i + np.flatnonzero(reach >= WIDTH)] = ids[index.least(lo, hi)]
    seg = of[at]
    new = np.ones(len(at), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (smallest[1:] != smallest[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    runs = np.stack([at[head] - starts[seg[head]], at[tail] - starts[seg[tail]], smallest[head]], 1)
    useful = (weights[seg[head]] > 1) | (smallest[head] != ids[seg[head]])
    out: list[bytes | None] = [None] * len(contents)
    for k, data in windows.packed_runs(seg[head][useful], runs[useful]):
        out[k] = data
    return out


def _whole(text: bytes, class_size: int) -> tuple:
    words = text.split()
    return len(words), 0, 0, hashlib.sha256(b" ".join(words)).hexdigest()


def _apply(text: bytes, doc_id: int, pairs: list) -> tuple:
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int32)
    for start, spans in pairs:
        runs = np.frombuffer(spans, np.int64).reshape(-1, 3)
        runs = runs[runs[:, 2] < doc_id]
        np.add.at(edge, start + runs[:, 0], 1)
        np.add.at(edge, start + runs[:, 1] + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(words), int(gone.sum()), spans, b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def substring_dedup(docs: DataFrame, texts: bool = True, hot: int = windows.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, and kept: the words left of a changed text (binary)."""
    prepare(docs.sparkSession)
    docs = identified(docs)
    rows, groups = windows.classes(docs)
    staged = windows.candidates(docs, groups, UNIT, _whole)
    found = windows.members(staged, windows.indexed(staged, earliest, INDEX, UNIT, hot))
    joined = rows.join(windows.finish(staged, found, groups, _apply, texts), "digest")
    copy = (F.col("doc_id") != F.col("rep_id")) & (F.col("n_units") >= WIDTH)
    return joined.select(
        real_id("doc_id").alias("doc_id"),
        F.col("n_units").alias("n_words"),
        F.when(copy, F.col("n_units")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (s) WHERE least < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: gone IS NULL OR NOT list_contains(gone, p)), lambda p: w[p]), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
