"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 (poor), 1 (good but toxic), 2 (good). One weight vector over hashed text
features is shared by all grades; ordered thresholds t1 < t2 cut its score, P(grade > k) =
sigmoid(score - t_k). Selection asks for P(grade = 2) of at least ``KEEP``; the expected grade is reported
too.

Features, hashed into ``SIZE`` buckets: which words a text holds (ASCII upper case lowered, marks at the end cut
off), which beginnings of ``PREFIXES`` bytes its words have, and for each shape of a word (case pattern and last mark) the share of
words that have it, times ``SHAPES``. Word features get a weight only if ``SUPPORT`` fitted texts and
one in ``COMMON`` hold them and their grades differ from the average by ``SCREEN`` deviations, so a long text gains nothing from the
many words that say nothing.

The model is fitted by one task on at most ``SAMPLE`` labelled texts, those whose ids have the smallest hashes;
the bound is a parameter, and the model has a fixed size. Every text of the table is scored, whole.

Null and empty texts have no features and get the score 0 and the probabilities of the thresholds alone; they
are kept or rejected by that like any other. Null labels leave a row out of the fit; if a document has several
labels the lowest grade counts. Without any labelled text everything is kept (weights and thresholds are 0 and
minus infinity). Repeated rows are scored alike. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import kernels as K
from quarrymill.llm.dealing import released
from quarrymill.llm.windows import compact
from quarrymill.runtime import prepare, table

#: Buckets of words and of shapes: many, so that telling words share theirs with few others.
BUCKETS, SHAPE_BUCKETS = 1 << 22, 1 << 10
SIZE = BUCKETS + SHAPE_BUCKETS
SHAPES = 6.0
#: Bytes of a word's beginning that are features too.
PREFIXES = (4, 5)
SAMPLE = 20_000
#: Fitted texts that must hold a word: so many, and one in COMMON (groups of copies are smaller than that).
SUPPORT, COMMON = 8, 400
#: Standard deviations from chance.
SCREEN = 12.0
KEEP = 0.6
GRADES = 3
PASSES = 30
RATE = 1.0
DECAY = 1e-6
#: Features that the fit looks at together.
STEP = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Class of each byte: 0 lower case and bytes beyond ASCII, 1 upper case, 2 digit, 3 and up the marks themselves.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and value of every feature of the rows, and the n + 1 offsets of the rows."""
    s, e, rows = K.words(raw, offsets)
    n = len(offsets) - 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64)
    low = _LOWER[raw]
    # marks at the end of a word belong to its shape, not to the word
    end = e.copy()
    marks = _CLASS[low] == 3
    for _ in range(4):
        end -= marks[np.maximum(end - 1, s)] & (end - 1 > s)
    words = K.word_hashes(low, s, end)
    upper = np.concatenate([[0], np.cumsum(_CLASS[raw] == 1)])
    inner = np.concatenate([[0], np.cumsum(_CLASS[raw] >= 2)])
    count = upper[e] - upper[s]
    case = np.where(count == 0, 0, np.where((count == 1) & (_CLASS[raw[s]] == 1), 1, np.where(count * 2 > e - s, 3, 2)))
    last = np.where(end < e, raw[np.minimum(end, len(raw) - 1)], 0).astype(np.int64)
    shape = case + 4 * (np.minimum(e - end, 3)) + 16 * np.minimum(inner[end] - inner[s], 3) + 64 * last
    row = np.repeat(np.arange(n), np.diff(rows))
    total = np.diff(rows)
    parts = [words, *(K.word_hashes(low, s, np.minimum(s + k, end)) ^ np.uint64(k << 60) for k in PREFIXES)]
    shaped = (K.mix(shape.astype(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
    key = np.concatenate([*(row * SIZE + (h % np.uint64(BUCKETS)).astype(np.int64) for h in parts), row * SIZE + BUCKETS + shaped])
    key, times = np.unique(key, return_counts=True)
    row, bucket = key // SIZE, key % SIZE
    value = np.where(bucket < BUCKETS, 1.0, SHAPES * times / total[row])
    return bucket, value, np.searchsorted(row, np.arange(n + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def fit(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, grade: np.ndarray, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with a weight, their weights, and the thresholds, by adaptive gradient steps over mini-batches
    in which rare grades count for more."""
    n = len(grade)
    # all features of all texts are the most that the task holds, so they are gone through in steps, without copies
    steps = [slice(i, i + STEP) for i in range(0, len(bucket), STEP)]
    present = np.zeros(SIZE, bool)
    for part in steps:
        present[bucket[part]] = True
    seen = np.flatnonzero(present)  # only buckets that occur take part
    size = len(seen)
    weights = np.zeros(size)
    if n == 0:
        return seen, weights, np.full(GRADES - 1, -np.inf)
    place = np.cumsum(present, dtype=np.int32) - 1
    of = np.repeat(grade.astype(np.int8), np.diff(offsets))
    counts = np.zeros((GRADES, size), np.int64)
    for part in steps:
        for k in range(GRADES):
            counts[k] += np.bincount(place[bucket[part][of[part] == k]], minlength=size)
    held = counts.sum(0)
    # a word counts if texts that hold it differ from the others in a grade's share by more than chance
    differs = np.zeros(size, bool)
    for k, p in enumerate(np.bincount(grade, minlength=GRADES) / n):
        differs |= np.abs(counts[k] - held * p) > SCREEN * np.sqrt(np.maximum(held * p * (1 - p), 1e-9))
    usable = (held >= max(support, n / COMMON)) & (differs | (seen >= BUCKETS))
    # the others have no part in the steps
    present[seen] = usable
    keep = np.concatenate([np.zeros(0, bool), *(present[bucket[part]] for part in steps)])
    bucket, value = place[bucket[keep]], value[keep].astype(np.float64)
    offsets = np.concatenate([[0], np.cumsum([np.count_nonzero(keep[a:e]) for a, e in zip(offsets[:-1], offsets[1:])])])
    del of, counts, keep, present, place
    share = np.bincount(grade, minlength=GRADES) / n
    balance = np.where(share > 0, 1 / np.maximum(share, 1e-9) ** 0.5, 0.0)
    balance /= (balance * share).sum()
    above = np.array([(grade > k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = -np.log(above / (1 - above))
    gw, gt = np.full(size, 1e-8), np.full(GRADES - 1, 1e-8)
    lengths = np.diff(offsets)
    random = np.random.default_rng(7)
    for step in range(PASSES):
        rate = RATE / (1 + 0.1 * step)
        order = random.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            each = lengths[rows]
            at = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            b, v, r = bucket[at], value[at], np.repeat(np.arange(len(rows)), each)
            score = np.bincount(r, weights[b] * v, minlength=len(rows))
            # cumulative link: P(grade > k) = sigmoid(score - t_k); grade probabilities are differences
            tail = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - thresholds), np.zeros((len(rows), 1))], 1)
            g = grade[rows]
            me = np.arange(len(rows))
            p = np.maximum(tail[me, g] - tail[me, g + 1], 1e-9)
            slope = tail * (1 - tail)
            up, down = slope[me, g] / p, slope[me, g + 1] / p
            scale = balance[g]
            ds = -scale * (up - down)  # gradient of the loss by the score
            dt = np.zeros(GRADES - 1)
            for k in range(GRADES - 1):
                dt[k] = (scale * (np.where(g == k + 1, up, 0) - np.where(g == k, down, 0))).sum() / len(rows)
            touched, inverse = np.unique(b, return_inverse=True)
            dw = np.bincount(inverse, ds[r] * v) / len(rows) + DECAY * weights[touched]
            gw[touched] += dw * dw
            weights[touched] -= rate * dw / np.sqrt(gw[touched])
            gt += dt * dt
            thresholds = np.maximum.accumulate(thresholds - rate * dt / np.sqrt(gt))
            thresholds[1:] = np.maximum(thresholds[1:], thresholds[:-1] + 1e-3)
    set_ = np.flatnonzero(weights)
    return seen[set_], weights[set_], thresholds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with a weight, their weights, and the thresholds of the model, fitted by one task; its size does not depend on the input."""
    grades = labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2).alias("grade"))
    grades = grades.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` thin rows: safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = K.utf8(b.column("text"))
            for i, j in K.chunks(offsets):
                bucket, value, rows = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = [slice(x, y) for x, y in zip(rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j].cast(pa.int64()), b.column("grade")[i:j].cast(pa.int32()), pa.array([bucket[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([value[c].astype(np.float32).tobytes() for c in cut], pa.binary())], names=["doc_id", "grade", "buckets", "vals"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}
        for b in batches:
            for doc_id, grade, bucket, value in zip(*(b.column(c).to_pylist() for c in ("doc_id", "grade", "buckets", "vals"))):
                if len(rows) < sample:  # rows that repeat a document count once
                    rows.setdefault(doc_id, (grade, np.frombuffer(bucket, np.int32), np.frombuffer(value, np.float32)))
        order = sorted(rows)
        offsets = np.concatenate([[0], np.cumsum([len(rows[k][1]) for k in order])]).astype(np.int64)
        grade = np.array([rows[k][0] for k in order], np.int64)
        bucket = np.concatenate([np.zeros(0, np.int32), *(rows[k][1] for k in order)])
        value = np.concatenate([np.zeros(0, np.float32), *(rows[k][2] for k in order)])
        rows.clear()
        model = fit(bucket, value, offsets, grade)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    model = texts.mapInArrow(compact(hashed), "doc_id long, grade int, buckets binary, vals binary").repartition(1).mapInArrow(released(fitted), "model binary").collect()
    return pickle.loads(model[0]["model"])


def scorer(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """texts (Arrow column) -> score and P(grade > k) of each."""
    buckets, values, thresholds = model
    weights = np.zeros(SIZE, np.float32)
    weights[buckets] = values

    def score(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = K.utf8(column)
        scores = [np.zeros(0)]
        for i, j in K.chunks(offsets):
            bucket, value, rows = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sums = np.concatenate([[0.0], np.cumsum(weights[bucket].astype(np.float64) * value)])
            scores.append(sums[rows[1:]] - sums[rows[:-1]])
        score = np.concatenate(scores)
        return score, sigmoid(score[:, None] - thresholds)

    return score


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, expected_grade, p_good (P(grade = 2)) and kept of every document."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels, sample))  # SIZE weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model.value)
        for b in batches:
            score, tail = of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(tail.sum(1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= KEEP)], names=["doc_id", "score", "expected_grade", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, expected_grade double, p_good double, kept boolean")


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows whose P(grade = 2) is at least ``KEEP``, with all their columns; each row is judged where it lies."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model.value)
        for b in batches:
            yield b.filter(pa.array(of(b.column("text"))[1][:, -1] >= KEEP))

    return docs.mapInArrow(released(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, expected_grade, p_good, kept."""
    rows = graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), "kept")


def stage_function(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose P(grade = 2) is at least ``KEEP`` stay; rows that share an id are judged each."""
    return kept(docs, table(spark, sf_dir, "labels"))
