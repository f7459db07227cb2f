"""Exact top-k search: BM25 over an inverted index with block-max WAND.

Terms are words ``[^\\x20\\x09-\\x0D]+`` with ASCII upper case lowered, as 64-bit hashes. Documents become term
vectors once (staged). Document frequencies, the count of documents and their mean length come from the whole
table; the frequencies go to the queries, so every shard scores with global statistics. A task has a group of the
documents and a block of the queries (``TOGETHER`` bytes at most, kept in memory): it gathers documents up to
``SHARD`` postings, indexes them, searches that shard for all its queries, and goes on to its next shard with the
thresholds reached.

A shard keeps the lists of common terms in blocks of ``BLOCK`` neighbouring documents, the same for all these lists,
which hold an impact for every document (0 where the term is missing), and the largest impact of each block. The other
lists are short. Queries are searched ``ASKED`` at a time. Each opens its short lists; what the common ones, still closed,
can add to the documents of a block is bounded by the block's maxima. Pivots are the documents that can reach the
threshold so, found for the whole shard at once instead of one cursor move after the other. All others are passed over.
A few pivots are finished from their own vectors; otherwise the closed lists are opened in the spans of documents in
which the query has a pivot, for all queries that need the span by one matrix product. The threshold is what the
query's ``top``-th best document of the shards before has reached. Documents that are alike are neighbours, which makes
the maxima tight.

Impacts, bounds and scores are double precision. A bound is a sum of at most as many terms as the query has, none
of whose partial sums exceeds the total ``t`` of the lists' largest contributions, so it is wrong by less than
``SLACK * t`` (there are at most some millions of terms); that and the rounding of scores is taken off the threshold.
So nothing is lost to rounding. The shards' best are merged.

Score: sum over the distinct terms of the query of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) /
(tf + K1 * (1 - B + B * words / mean words)), rounded to six places; ties go to the smaller doc_id. Only
documents that share a term with the query are found, so an empty, null or wordless query finds nothing.
A query finds itself and its copies. A null doc_id is no query in ``query``; such a row can be found, as the smallest.
Rows that repeat a doc_id are documents (or queries) of their own. Queries of the same terms are searched once. Columns
other than doc_id and text are not read. Every distinct query meets every shard, so that work grows with queries times
documents. What is sent is the queries once a group and the documents once a block of queries: groups are as many as
the cluster has use for, blocks grow with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm import kernels as K
from quarrymill.llm.dealing import Dealer, by_part, cuts, one_thread, to_owners
from quarrymill.llm.windows import compact
from quarrymill.runtime import partitions, prepare, stage, table

K1, B = 1.2, 0.75
TOP = 10
#: Postings of a shard; terms in one document of so many are common when documents are ordered.
SHARD, COMMON = 4_000_000, 24
#: Documents of a block, and of a span (whole blocks).
BLOCK, SPAN = 64, 512
#: Lists with one document of so many have blocks, as far as the blocks of all lists hold so many impacts at most.
FULL, IMPACTS = 16, 6_000_000
#: Queries searched together, and scores that they have at most.
ASKED, SCORES = 128, 2_000_000
#: Bytes of queries that a task keeps.
TOGETHER = 48_000_000
#: What a step in a document's vector costs in impacts of a span.
STEP = 250
#: Relative error of a bound, generously.
SLACK = 1e-9
_LOW = -(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vectors(docs: DataFrame) -> DataFrame:
    """Staged: doc_id, words, and the sorted distinct terms (uint64) with their counts (uint32), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            for i, j in K.chunks(offsets):
                part = _LOWER[raw[offsets[i] : offsets[j]]]
                s, e, rows = K.words(part, offsets[i : j + 1] - offsets[i])
                hashes = K.word_hashes(part, s, e)
                found = [np.unique(hashes[x:y], return_counts=True) for x, y in zip(rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(np.diff(rows), pa.int64()), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())], names=["doc_id", "words", "terms", "counts"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.mapInArrow(compact(run), "doc_id long, words long, terms binary, counts binary"), "vectors")


def weighted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """number, terms (uint64, sorted) and dfs (float64) of every query; ``asked``: number and terms.

    Terms are dealt to owners, which count them: a task sends each of its terms once a budget, with a count, and the
    terms of its queries with their numbers.
    """
    parts = partitions(rows.sparkSession)
    schema = "part int, terms binary, counts binary, asked binary, numbers binary"

    def padded(b: pa.RecordBatch, first: int) -> pa.RecordBatch:
        none = pa.array([b""] * b.num_rows, pa.binary())
        own = b.columns[1:]
        return pa.RecordBatch.from_arrays([b.column(0), *([*own, none, none] if first == 0 else [none, none, *own])], names=["part", "terms", "counts", "asked", "numbers"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts, ["terms", "counts"])

        def counted() -> pa.RecordBatch:
            term, n = np.unique(dealer.gathered()[0], return_counts=True)
            return padded(dealer.packed([term, n.astype(np.int64)]), 0)

        for b in batches:
            if any(dealer.add(np.frombuffer(t, np.uint64)) for t in b.column("terms").to_pylist()):
                yield counted()
        if dealer.size:
            yield counted()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(parts, ["asked", "numbers"])
        for b in batches:
            for number, terms in zip(b.column("number").to_pylist(), b.column("terms").to_pylist()):
                values = np.frombuffer(terms, np.uint64)
                if dealer.add(values, np.full(len(values), number)):
                    yield padded(dealer.packed(dealer.gathered()), 2)
        for b in dealer.rest():
            yield padded(b, 2)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, counts, wanted, numbers in by_part(batches, {"terms": np.uint64, "counts": np.int64, "asked": np.uint64, "numbers": np.int64}):
            if not len(wanted):
                continue
            known, at = np.unique(terms, return_inverse=True)
            df = np.bincount(at, counts)
            by = np.argsort(numbers, kind="stable")
            wanted, numbers = wanted[by], numbers[by]
            each = df[np.searchsorted(known, wanted)]
            first, end = cuts(numbers)
            for i in range(0, len(first), 5000):
                pairs = list(zip(first[i : i + 5000], end[i : i + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[first[i : i + 5000]]), pa.array([wanted[x:y].tobytes() for x, y in pairs], pa.binary()), pa.array([each[x:y].tobytes() for x, y in pairs], pa.binary())], names=["number", "terms", "dfs"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, parts in zip(b.column("number").to_pylist(), b.column("parts").to_pylist()):
                terms, dfs = (np.frombuffer(b"".join(p[c] for p in parts), t) for c, t in (("terms", np.uint64), ("dfs", np.float64)))
                by = np.argsort(terms)
                out.append((number, terms[by].tobytes(), dfs[by].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["number", "terms", "dfs"])

    sent = rows.select("terms").mapInArrow(count, schema).union(asked.select("number", "terms").mapInArrow(ask, schema))
    told = to_owners(sent).mapInArrow(answer, "number long, terms binary, dfs binary")
    whole = told.groupBy("number").agg(F.collect_list(F.struct("terms", "dfs")).alias("parts"))
    return stage(whole.mapInArrow(joined, "number long, terms binary, dfs binary"), "weighted")


def fewest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


class Shard:
    """Inverted index of some documents: posting lists in blocks, each with its documents' range and largest impact."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, mean: float):
        self.n = n = len(ids)
        by = np.argsort(terms)
        ordered = terms[by]
        head = np.append(True, ordered[1:] != ordered[:-1])
        self.terms = ordered[head]
        del ordered
        local = np.empty(len(terms), np.int32)
        local[by] = np.cumsum(head, dtype=np.int32) - 1
        del by, head
        self.df = df = np.bincount(local, minlength=len(self.terms))
        # neighbours: same most frequent term among the common ones, then length
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        heavy = np.flatnonzero((df * COMMON >= n)[local])
        lead = np.full(n, -1, np.int32)
        heavy = heavy[np.argsort(tf[heavy], kind="stable")]
        lead[owner[heavy]] = local[heavy]  # the last written, so the most frequent, stays
        order = np.lexsort([words, lead])
        self.ids = ids[order]
        self.norm = K1 * (1 - B + B * words[order] / mean)
        # every document's own vector, to finish a pivot
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.own_size = sizes[order]
        self.own_first = np.concatenate([[0], np.cumsum(self.own_size)])
        by = K.runs(first[order], self.own_size)
        self.own_term, self.own_tf = local[by], tf[by]
        del local, owner, heavy, by
        # the lists, and the blocks of the common ones
        by = np.argsort(self.own_term, kind="stable")
        doc = np.repeat(np.arange(n, dtype=np.int32), self.own_size)[by]
        impact = self.own_tf[by].astype(np.float64)
        impact *= (K1 + 1) / (impact + self.norm[doc])
        del by
        first = np.concatenate([[0], np.cumsum(df)])
        self.list_most = np.maximum.reduceat(impact, first[:-1])
        common = np.flatnonzero((df * FULL >= n) & (df >= BLOCK))
        common = common[np.argsort(df[common], kind="stable")][::-1][: IMPACTS // n]
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), n))
        for row, (i, j) in enumerate(zip(first[common], first[common + 1])):
            self.full[row, doc[i:j]] = impact[i:j]
        self.blocks = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.full, self.blocks, axis=1)
        self.size = np.where(self.row < 0, df, 0)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        short = np.repeat(self.row < 0, df)
        self.impact, doc = impact[short], doc[short]
        self.doc = doc.astype(np.uint16) if n <= 1 << 16 else doc
        self.weight = np.zeros(len(self.terms))

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the lists of some terms, -1 for those without a list."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def search(self, asked: list[tuple[np.ndarray, np.ndarray, float]], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and rounded scores of the best documents for each query, as far as they reach its threshold.

        A query: numbers of its lists (-1: none), their idf, and the threshold.
        """
        out = []
        n = max(1, min(ASKED, SCORES // self.n))
        for i in range(0, len(asked), n):
            out += self._together(asked[i : i + n], top)
        return out

    def _together(self, asked: list[tuple[np.ndarray, np.ndarray, float]], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [(self.ids[:0], np.zeros(0))] * len(asked)
        open_, floors = [], []
        weight, score = np.zeros((len(asked), len(self.full))), np.empty((len(asked), self.n))
        for k, (at, idf, least) in enumerate(asked):
            here = at >= 0
            at, idf = at[here], idf[here]
            most = float(idf @ self.list_most[at])
            floor = least - SLACK * most - 2e-6
            if not len(at) or most < floor:
                continue
            row = self.row[at]
            common = row >= 0
            weight[len(open_), row[common]] = idf[common]
            score[len(open_)] = self._opened(at[~common], idf[~common])
            open_.append((k, at, idf, least))
            floors.append(floor)
        if not open_:
            return found
        weight, score, floor = weight[: len(open_)], score[: len(open_)], np.array(floors)
        # what the closed lists can add to the documents of a block
        bound = weight @ self.most
        live = np.maximum.reduceat(score, self.blocks, axis=1) + bound > floor[:, None]
        spans = np.logical_or.reduceat(live, np.arange(0, len(self.blocks), SPAN // BLOCK), axis=1)
        for r, (k, at, idf, least) in enumerate(open_):
            if least <= 0 or live[r].all():
                continue
            alive = np.flatnonzero(live[r])
            docs = K.runs(self.blocks[alive], np.minimum(self.blocks[alive] + BLOCK, self.n) - self.blocks[alive])
            pivots = docs[score[r, docs] + bound[r, docs // BLOCK] > floor[r]]
            # a few pivots are finished from their own vectors, if that costs less than to open the closed lists
            if STEP * int(self.own_size[pivots].sum()) <= len(self.full) * SPAN * int(spans[r].sum()):
                found[k] = self._best(pivots, self._finished(pivots, at, idf), top, least)
                spans[r] = False
                open_[r] = None
        for s, needed in enumerate(spans.T):
            rows = np.flatnonzero(needed)
            if len(rows):
                here = slice(s * SPAN, (s + 1) * SPAN)
                if len(rows) == len(score):
                    score[:, here] += weight @ self.full[:, here]
                else:
                    score[rows, here] += weight[rows] @ self.full[:, here]
        for r, query in enumerate(open_):
            if query is not None:
                found[query[0]] = self._best(None, score[r], top, query[3])
        return found

    def _opened(self, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What whole short lists add to all documents: those of ``BLOCK`` and more one by one, the others together."""
        sizes = self.size[at]
        few = sizes < BLOCK
        where = K.runs(self.first[at[few]], sizes[few])
        long = at[~few]
        lists = [slice(a, b) for a, b in zip(self.first[long].tolist(), self.first[long + 1].tolist())]
        weight = np.repeat(np.concatenate([idf[few], idf[~few]]), np.concatenate([sizes[few], sizes[~few]]))
        weight *= np.concatenate([self.impact[where], *[self.impact[x] for x in lists]])
        return np.bincount(np.concatenate([self.doc[where], *[self.doc[x] for x in lists]]), weight, self.n)

    def _best(self, docs: np.ndarray | None, scores: np.ndarray, top: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        best = np.flatnonzero(scores >= least - 2e-6) if least > 0 else np.flatnonzero(scores > 0)
        if len(best) > top:
            reached = scores[best]
            best = best[reached >= np.partition(reached, len(best) - top)[len(best) - top] - 2e-6]
        exact = np.round(scores[best], 6)
        ids = self.ids[best if docs is None else docs[best]]
        pick = np.lexsort([ids, -exact])[:top]
        return ids[pick], exact[pick]

    def _finished(self, docs: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from their own vectors."""
        self.weight[at] = idf
        sizes = self.own_size[docs]
        where = K.runs(self.own_first[docs], sizes)
        tf = self.own_tf[where].astype(np.float64)
        each = self.weight[self.own_term[where]] * (tf * (K1 + 1) / (tf + np.repeat(self.norm[docs], sizes)))
        self.weight[at] = 0
        return np.bincount(np.repeat(np.arange(len(docs)), sizes), each, len(docs))


def top_documents(docs: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """query_id, rank, doc_id, score of the ``top`` documents for every row (query_id, text) of ``queries``."""
    spark = prepare(docs.sparkSession)
    rows = vectors(docs)
    n, total, postings = rows.agg(F.count("*"), F.sum("words"), F.sum(F.octet_length("terms") / 8)).first()
    mean = max(total or 0, 1) / max(n, 1)
    asked = vectors(queries.withColumnRenamed("query_id", "doc_id")).where("words > 0").select(F.col("doc_id").alias("query_id"), "terms")
    distinct = stage(asked.select("terms").distinct().withColumn("number", F.monotonically_increasing_id()), "queries")
    members = stage(asked.join(distinct.hint("merge"), "terms").select("query_id", "number"), "members")
    ready = weighted(rows, distinct)
    asked_bytes = ready.agg(F.sum(F.octet_length("terms") + F.octet_length("dfs") + 200)).first()[0] or 0
    groups = max(1, min(-(-int(postings or 0) // shard), 2 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked_bytes // TOGETHER))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        now = None
        waiting: dict[int, tuple] = {}  # number -> terms (their places in known, once there is one), idf
        known: list[np.ndarray] = []  # the terms of all queries
        best: dict[int, tuple] = {}  # number -> ids, scores
        parts: list[tuple] = []
        size = 0

        def answer() -> None:
            """Search what has been gathered for all queries; each goes on with the threshold it has reached."""
            nonlocal size
            if not parts or not waiting:
                return
            ids, words, terms, counts = zip(*parts)
            parts.clear()
            size = 0
            lengths = np.array([len(c) for c in counts])
            flat = np.concatenate(terms), np.concatenate(counts)
            del terms, counts
            made = Shard(np.array(ids), np.array(words, np.float64), lengths, *flat, mean)
            # every term of the queries is looked up once a shard
            numbers = list(waiting)
            if not known:
                flat = np.unique(np.concatenate([waiting[k][0] for k in numbers]))
                known.append(flat)
                for k in numbers:
                    waiting[k] = np.searchsorted(flat, waiting[k][0]).astype(np.int32), waiting[k][1]
            at = made.places(known[0])
            for i in range(0, len(numbers), 1000):
                some = numbers[i : i + 1000]
                asked = []
                for k in some:
                    b = best.get(k)
                    asked.append((at[waiting[k][0]], waiting[k][1], float(b[1][-1]) if b is not None and len(b[1]) == top else 0.0))
                for k, found in zip(some, made.search(asked, top)):
                    if k not in best:
                        best[k] = found
                    elif len(found[0]):
                        ids, scores = (np.concatenate(x) for x in zip(best[k], found))
                        pick = np.lexsort([ids, -scores])[:top]
                        best[k] = ids[pick], scores[pick]

        def result() -> Iterator[pa.RecordBatch]:
            answer()
            items = list(best.items())
            for i in range(0, len(items), 500):
                some = items[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in some], [len(x[0]) for _, x in some]), pa.int64()), pa.array(np.concatenate([x[0] for _, x in some]), pa.int64()), pa.array(np.concatenate([x[1] for _, x in some]), pa.float64())], names=["number", "doc_id", "score"])
            waiting.clear()
            known.clear()
            best.clear()
            parts.clear()

        for b in batches:
            for part, doc, i, words, terms, numbers in zip(*(b.column(c).to_pylist() for c in ("part", "doc", "id", "words", "terms", "numbers"))):
                if part != now:
                    yield from result()
                    now, size = part, 0
                if not doc:
                    df = np.frombuffer(numbers, np.float64)
                    waiting[i] = np.frombuffer(terms, np.uint64), np.log(1 + (n - df + 0.5) / (df + 0.5))
                    continue
                counts = fewest(np.frombuffer(numbers, np.uint32))
                if size + len(counts) > shard:
                    answer()
                parts.append((i, words, np.frombuffer(terms, np.uint64), counts))
                size += len(counts)
        yield from result()

    # a task has a group of documents and a block of queries, the queries first
    group = F.pmod(F.xxhash64("doc_id", "words"), F.lit(groups)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    documents = rows.where("words > 0").select(F.lit(True).alias("doc"), group.alias("group"), every(blocks).alias("block"), F.col("doc_id").alias("id"), "words", "terms", F.col("counts").alias("numbers"))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    spread = ready.select(F.lit(False).alias("doc"), every(groups).alias("group"), block.alias("block"), F.col("number").alias("id"), F.lit(0).cast("long").alias("words"), "terms", F.col("dfs").alias("numbers"))
    both = documents.unionByName(spread).withColumn("part", F.col("group") * blocks + F.col("block"))
    found = both.repartitionById(groups * blocks, "part").sortWithinPartitions("part", "doc").mapInArrow(index, "number long, doc_id long, score double")
    ranking = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
    return ranked.join(members, "number").select("query_id", "rank", F.nullif("doc_id", F.lit(_LOW)).alias("doc_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The best ten of all documents for each document whose id is divisible by 50, its whole text being the query."""
    docs = table(spark, sf_dir, "documents")
    return top_documents(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::DOUBLE AS words FROM tf GROUP BY doc_id),
stat AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(words) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
score AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN len ON len.doc_id = d.doc_id, stat
  WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10
"""
