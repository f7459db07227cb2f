"""Exact dedup: Patricia-trie owners.

Texts count as equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one space.

1. A map task puts its normalised texts, as full byte strings, into a compressed radix trie and keeps one
   representative of each, so a text that a third of all rows share costs one row a task. When the trie
   reaches its budget the representatives are sent off and a new trie begins. The rows are staged.
2. Representatives are dealt by length and content hash. The owner of each partition inserts them into its
   trie, whose terminal nodes hold the smallest identifier and the count of the group; over its budget the
   trie spills its largest subtree to a file of the task and finishes that subtree on its own later.
3. Every row joins its representative; no key of that join has more rows than one map task.

Null text counts as empty, and empty texts equal each other. A null doc_id is larger than any other and never
becomes keep_id unless the whole group has none. If rows repeat a doc_id with equal texts, exactly one of them
is kept. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.dealing import released
from quarrymill.llm.rows import rows_named, text_key
from quarrymill.llm.windows import compact
from quarrymill.runtime import partitions, prepare, stage, table

#: Bytes of text that a trie holds before it is sent off (map side) or spills a subtree (owner).
MAP_BYTES = 32_000_000
OWNER_BYTES = 64_000_000
_NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text that is compared: each run of ASCII whitespace is one space, null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def first_difference(a: bytes, b: bytes) -> int:
    """The first place where two strings differ (their common length if one begins with the other), -1 if equal."""
    if a == b:
        return -1
    most = min(len(a), len(b))
    at, step = 0, 32
    while at < most and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= most:
        return most
    while step > 1:
        step = (step + 1) // 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, most)


class _Inner:
    __slots__ = ("pos", "kids")

    def __init__(self, pos: int, kids: dict):
        self.pos, self.kids = pos, kids


class _Leaf:
    __slots__ = ("key", "value")

    def __init__(self, key: bytes, value):
        self.key, self.value = key, value


class _Spilled:
    """A subtree on disk: all keys that agree with ``key`` up to and with place ``depth``."""

    __slots__ = ("key", "depth", "file")

    def __init__(self, key: bytes, depth: int, file):
        self.key, self.depth, self.file = key, depth, file


class PatriciaTrie:
    """Byte strings in a compressed radix trie; equal strings share a terminal node.

    Inner nodes hold the place at which their strings differ first, terminal nodes the full string and a
    value that ``merge(old, new)`` combines. With ``folder`` the trie spills its largest subtree there
    whenever it holds more than ``budget`` bytes.
    """

    def __init__(self, merge: Callable, budget: int = 0, folder: str | None = None):
        self.merge, self.budget, self.folder = merge, budget, folder
        self.root = None
        self.size = 0

    @staticmethod
    def _branch(key: bytes, pos: int) -> int:
        return key[pos] if pos < len(key) else -1

    def insert(self, key: bytes, value) -> _Leaf | None:
        """The terminal node of ``key``, or None if its subtree is on disk."""
        node = self.root
        if node is None:
            self.root = leaf = _Leaf(key, value)
            self.size += len(key) + 200
            return leaf
        n = len(key)
        while type(node) is _Inner:
            pos = node.pos
            kid = node.kids.get(key[pos] if pos < n else -1)
            node = next(iter(node.kids.values())) if kid is None else kid
        at = first_difference(key, node.key)
        if type(node) is _Spilled:
            if at < 0 or at > node.depth:
                pickle.dump((key, value), node.file)
                return None
        elif at < 0:
            node.value = self.merge(node.value, value)
            return node
        sample = node.key
        above, node = None, self.root
        while type(node) is _Inner and node.pos < at:
            above, node = node, node.kids[self._branch(key, node.pos)]
        leaf = _Leaf(key, value)
        if type(node) is _Inner and node.pos == at:
            node.kids[self._branch(key, at)] = leaf
        else:
            inner = _Inner(at, {self._branch(sample, at): node, self._branch(key, at): leaf})
            if above is None:
                self.root = inner
            else:
                above.kids[self._branch(key, above.pos)] = inner
        self.size += len(key) + 200
        if self.folder is not None and self.size > self.budget:
            self._spill()
        return leaf

    @staticmethod
    def _under(node) -> Iterator:
        stack = [node]
        while stack:
            node = stack.pop()
            if type(node) is _Inner:
                stack.extend(node.kids.values())
            else:
                yield node

    def _spill(self) -> None:
        """Write the largest subtree below the root to a file."""
        if type(self.root) is not _Inner:
            return
        sizes = {b: sum(len(x.key) + 200 for x in self._under(kid) if type(x) is _Leaf) for b, kid in self.root.kids.items()}
        branch = max(sizes, key=sizes.get)
        if not sizes[branch]:
            return
        kid = self.root.kids[branch]
        spilled = None
        fd, name = tempfile.mkstemp(dir=self.folder)
        file = os.fdopen(fd, "w+b")
        os.unlink(name)  # gone with the task, however it ends
        for x in self._under(kid):
            spilled = spilled or x.key
            if type(x) is _Leaf:
                pickle.dump((x.key, x.value), file)
            else:
                x.file.seek(0)
                while part := x.file.read(1 << 20):
                    file.write(part)
                x.file.close()
        self.root.kids[branch] = _Spilled(spilled, self.root.pos, file)
        self.size -= sizes[branch]

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings with their values; spilled subtrees come last, one at a time."""
        later = []
        if self.root is not None:
            for x in self._under(self.root):
                if type(x) is _Leaf:
                    yield x.key, x.value
                else:
                    later.append(x.file)
        self.root = None
        for file in later:
            file.seek(0)
            sub = PatriciaTrie(self.merge, self.budget, self.folder)
            while True:
                try:
                    key, value = pickle.load(file)
                except EOFError:
                    break
                sub.insert(key, value)
            file.close()
            yield from sub.items()


def representatives(docs: DataFrame, budget: int = MAP_BYTES) -> DataFrame:
    """Staged rows: one M row a document (with its representative), one T row a representative (with its text)."""
    schema = "kind string, doc_id long, text_key long, rep long, digest string, first boolean, size int, hash long, least long, members long, text string"
    fields = [("kind", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("rep", pa.int64()), ("digest", pa.string()), ("first", pa.bool_()), ("size", pa.int32()), ("hash", pa.int64()), ("least", pa.int64()), ("members", pa.int64()), ("text", pa.string())]

    def out(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in fields], names=[k for k, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        trie = PatriciaTrie(lambda old, new: old)
        groups: list[list] = []  # representative, least id, members, size, hash, text, row of the least id
        rows: list[tuple[int | None, int, str, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield out(len(part), kind=["M"] * len(part), doc_id=[r[0] for r in part], text_key=[r[3] for r in part], rep=[groups[r[1]][0] for r in part], digest=[r[2] for r in part], first=[groups[r[1]][6] == i + j for j, r in enumerate(part)])
            for i in range(0, len(groups), 500):
                part = groups[i : i + 500]
                yield out(len(part), kind=["T"] * len(part), rep=[g[0] for g in part], least=[g[1] for g in part], members=[g[2] for g in part], size=[g[3] for g in part], hash=[g[4] for g in part], text=[g[5].decode() for g in part])

        for b in batches:
            for doc_id, text, digest, size, hashed, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "digest", "size", "hash", "text_key"))):
                key = text.encode()
                leaf = trie.insert(key, len(groups))
                least = _NO_ID if doc_id is None else doc_id
                if leaf.value == len(groups):
                    groups.append([number, least, 1, size, hashed, key, len(rows)])
                    number += 1
                else:
                    g = groups[leaf.value]
                    g[2] += 1
                    if least < g[1]:
                        g[1], g[6] = least, len(rows)
                rows.append((doc_id, leaf.value, digest, own))
            if trie.size > budget:
                yield from flush()
                trie = PatriciaTrie(lambda old, new: old)
                groups.clear()
                rows.clear()
        yield from flush()

    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"), text_key().alias("text_key"))
    keyed = texts.select("doc_id", "text", "text_key", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    return stage(keyed.mapInArrow(compact(run), schema), "representatives")


def owners(staged: DataFrame, budget: int = OWNER_BYTES) -> DataFrame:
    """rep, keep_id, group_size, and the representative that holds the kept row."""

    def merge(old: tuple, new: tuple) -> tuple:
        least, holder = min((old[0], old[1]), (new[0], new[1]))
        return least, holder, old[2] + new[2], old[3] + new[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = PatriciaTrie(merge, budget, folder)
            for b in batches:
                for rep, text, least, members in zip(*(b.column(c).to_pylist() for c in ("rep", "text", "least", "members"))):
                    trie.insert(text.encode(), (least, rep, members, (rep,)))
            rows: list[tuple] = []
            for _, (least, holder, members, reps) in trie.items():
                rows += [(rep, None if least == _NO_ID else least, members, rep == holder) for rep in reps]
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["rep", "keep_id", "group_size", "holder"])

    reps = staged.where("kind = 'T'").select("rep", "size", "hash", "least", "members", "text")
    return reps.repartition(partitions(staged.sparkSession), "size", "hash").mapInArrow(released(run), "rep long, keep_id long, group_size long, holder boolean")


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256 of every row; of each group exactly one row is kept."""
    prepare(docs.sparkSession)
    staged = representatives(docs)
    rows = staged.where("kind = 'M'").select("doc_id", "text_key", "rep", "digest", "first")
    return rows.join(owners(staged), "rep").select("doc_id", "text_key", "keep_id", "group_size", (F.col("first") & F.col("holder")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return decided(docs).drop("text_key")


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""


def stage_function(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, one of the smallest id. Ids may repeat: rows are told apart by id
    and text."""
    kept = decided(docs.select("doc_id", "text")).where("kept")
    return rows_named(docs, kept.select("doc_id", "text_key"))
