"""TF-IDF in long form, keyphrases, and search by terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.functions import text as T
from quarrymill.runtime import stage

#: Words that keyphrases leave out. Our own short list.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "which", "with", "you")


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def strip_accents(text: Column | str) -> Column:
    """Latin letters without their marks."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, *_accents())


def terms(text: Column | str, stop: tuple[str, ...] = (), accents: bool = False) -> Column:
    """Word 1- and 2-grams of two or more letters, digits or underscores a word; lower case, accents only if asked for."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    words = F.regexp_extract_all(low if accents else strip_accents(low), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))

    def both(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    return T.bound(words, both)


def _plain(text: Column) -> Column:
    """Lower case with one space for whatever stands between words (``terms`` says what a word is)."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def _one_row_a_document(docs: DataFrame, id_column: str) -> DataFrame:
    """id and ``plain`` of each document. Rows that repeat an id, or have none, are one document; a line break parts their
    texts. Only such rows are shuffled, and whether there are any is asked first."""
    rows = docs.select(id_column, _plain(F.col("text")).alias("plain"))
    repeated = docs.groupBy(id_column).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_column).alias("_again"))
    if repeated.isEmpty():
        return rows
    repeated = stage(repeated, "repeated")
    same = F.col(id_column).eqNullSafe(F.col("_again"))
    whole = rows.join(repeated, same, "left_semi").groupBy(id_column).agg(F.array_join(F.collect_list("plain"), "\n").alias("plain"))
    return rows.join(repeated, same, "left_anti").unionByName(whole)


def _words(plain: pa.Array, stop: tuple[str, ...], accents: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a batch of texts: each word's text and number, what the numbers mean, and whether the next word is in the same line."""
    words = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
    text = np.repeat(np.arange(len(plain)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    found = words.flatten().dictionary_encode()
    codes, names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    if not accents and not pc.all(pc.string_is_ascii(names)).as_py():
        table = str.maketrans(*_accents())
        names = pa.array([n.translate(table) for n in names.to_pylist()], pa.string())
        again = names.dictionary_encode()  # words that differed by marks alone are one
        codes, names = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], again.dictionary
    keep = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, pa.array(stop, pa.string()))))
    line = pc.equal(names, "\n").to_numpy(zero_copy_only=False)
    kept = keep.to_numpy(zero_copy_only=False)[codes]
    lines = np.cumsum(line[codes])[kept]
    codes, text = codes[kept], text[kept]
    follows = (text[1:] == text[:-1]) & (lines[1:] == lines[:-1])
    return text, codes, names, np.append(follows, False) if len(codes) else np.zeros(0, bool)


def _batch_counts(plain: pa.Array, stop: tuple[str, ...], accents: bool) -> pa.RecordBatch:
    """term, df and total within a batch of documents. A pair of words is told by one integer."""
    text, codes, names, follows = _words(plain, stop, accents)
    base = len(names) + 1
    at = np.flatnonzero(follows)
    keys = np.concatenate([codes * base, codes[at] * base + codes[at + 1] + 1])
    terms, total = np.unique(keys, return_counts=True)
    held = np.unique(np.concatenate([text, text[at]]) * (base * base) + keys)
    df = np.unique(held % (base * base), return_counts=True)[1]
    second = terms % base - 1
    one = names.take(pa.array(terms // base))
    two = pc.binary_join_element_wise(one, names.take(pa.array(np.maximum(second, 0))), " ") if len(names) else one
    return pa.RecordBatch.from_arrays([pc.if_else(pa.array(second < 0), one, two), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])


def vocabulary(docs: DataFrame, least_df: int = 2, most_df: float = 0.98, features: int = 50_000, stop: tuple[str, ...] = (), id_column: str = "doc_id", accents: bool = False) -> DataFrame:
    """term, df and n (documents): the ``features`` terms of most occurrences in the documents to fit on.

    Terms are counted in each batch of whole documents; a row a term of a batch is all that is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch_counts(b.column("plain"), stop, accents)

    counts = _one_row_a_document(docs, id_column).select("plain").mapInArrow(run, "term string, df long, total long")
    n = docs.agg(F.count("*").alias("n"))
    # dealt by term before anything is added up: a task would else hold most terms of its share of the texts
    found = counts.repartition("term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    found = found.crossJoin(F.broadcast(n)).where((F.col("df") >= least_df) & (F.col("df") <= F.col("n") * F.lit(most_df)))
    return found.orderBy(F.desc("total"), "term").limit(features).select("term", "df", "n")


class _Known:
    """A vocabulary as arrays: terms in order, the words in them, and the terms by their words' numbers."""

    def __init__(self, terms: list[str], df: list[int], n: int):
        order = sorted(range(len(terms)), key=terms.__getitem__)
        self.terms = pa.array([terms[k] for k in order], pa.string())
        self.idf = np.log((1.0 + n) / (1.0 + np.array(df, np.float64)[order])) + 1.0
        parts = [terms[k].split(" ") for k in order]
        names = sorted({w for p in parts for w in p})
        number = {w: k for k, w in enumerate(names)}
        self.words, self.base = pa.array(names, pa.string()), len(names) + 1
        keys = np.array([number[p[0]] * self.base + (number[p[1]] + 1 if len(p) > 1 else 0) for p in parts], np.int64)
        self.place = np.argsort(keys)
        self.keys = keys[self.place]

    def weights(self, plain: pa.Array, stop: tuple[str, ...], accents: bool, sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, place of the term, weight of a batch of texts, in the order of texts and terms; unit length a text."""
        text, codes, names, follows = _words(plain, stop, accents)
        if not len(self.keys) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        mine = pc.fill_null(pc.index_in(names, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        one = np.flatnonzero(mine >= 0)
        two = np.flatnonzero(follows & (mine >= 0) & (np.append(mine[1:], -1) >= 0))
        keys = np.concatenate([mine[one] * self.base, mine[two] * self.base + mine[two + 1] + 1 if len(two) else np.zeros(0, np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        found, tf = np.unique(np.concatenate([text[one], text[two]])[there] * len(self.keys) + self.place[at[there]], return_counts=True)
        text, term = found // len(self.keys), found % len(self.keys)
        weight = (1.0 + np.log(tf.astype(np.float64)) if sublinear else tf.astype(np.float64)) * self.idf[term]
        return text, term, weight / np.sqrt(np.bincount(text, weight * weight))[text]


#: Of a batch: text, place of the term, weight (sorted by the first two), and the terms; gives the texts and columns of its rows.
Reduction = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], tuple[np.ndarray, list]]


def weighed(docs: DataFrame, vocabulary: DataFrame, reduce: Reduction, columns: str, sublinear: bool = True, stop: tuple[str, ...] = (), id_column: str = "doc_id", accents: bool = False) -> DataFrame:
    """id and ``columns``: what ``reduce`` makes of the documents' weights by a fitted vocabulary (smooth idf, unit length).

    All terms of a document are in its row, so nothing is shuffled. The vocabulary has a fixed bound and goes to all tasks.
    """
    spark = docs.sparkSession
    rows = vocabulary.select("term", "df", "n").collect()  # bounded, see ``vocabulary``
    known = spark.sparkContext.broadcast(_Known([r["term"] for r in rows], [r["df"] for r in rows], rows[0]["n"] if rows else 0))
    schema = StructType([docs.schema[id_column], *StructType.fromDDL(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, out = reduce(*known.value.weights(b.column("plain"), stop, accents, sublinear), known.value.terms)
            if len(text):
                yield pa.RecordBatch.from_arrays([b.column(id_column).take(pa.array(text)), *out], names=schema.names)

    return _one_row_a_document(docs, id_column).mapInArrow(run, schema)


def _every(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
    return text, [terms.take(pa.array(term)), pa.array(weight)]


def weigh(docs: DataFrame, vocabulary: DataFrame, sublinear: bool = True, stop: tuple[str, ...] = (), id_column: str = "doc_id", accents: bool = False) -> DataFrame:
    """(id, term, weight) of any documents by a fitted vocabulary: smooth idf, unit length."""
    return weighed(docs, vocabulary, _every, "term string, weight double", sublinear, stop, id_column, accents)


def _sums(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
    texts, first, counts = np.unique(text, return_index=True, return_counts=True)
    if not len(texts):
        return texts, []
    return texts, [pa.array(counts), pa.array(np.add.reduceat(weight, first)), pa.array(np.maximum.reduceat(weight, first))]


def weight_sums(docs: DataFrame, vocabulary: DataFrame, **options) -> DataFrame:
    """id, terms (how many), total and largest weight of the documents that have any term."""
    return weighed(docs, vocabulary, _sums, "terms long, total double, largest double", **options)


def _ranked(text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Greatest weight (to nine digits) first in each text, then the smaller term."""
    return np.lexsort((term, -np.floor(weight * 1e9 + 0.5), text))


def keyphrases(docs: DataFrame, vocabulary: DataFrame, top: int = 3, **options) -> DataFrame:
    """id and ``phrases``: the ``top`` terms of most weight, none part of another."""

    def reduce(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
        texts, first, counts = np.unique(text, return_index=True, return_counts=True)
        term = term[_ranked(text, term, weight)]
        phrases = []
        for begin, end in zip(first, first + counts):
            kept: list[str] = []
            for at in range(begin, end):
                new = terms[term[at]].as_py()
                if not any(new in k or k in new for k in kept):
                    kept.append(new)
                    if len(kept) >= top:
                        break
            phrases.append(kept)
        return texts, [pa.array(phrases, pa.list_(pa.string()))]

    return weighed(docs, vocabulary, reduce, "phrases array<string>", **options)


def heaviest(docs: DataFrame, vocabulary: DataFrame, **options) -> DataFrame:
    """id, the term of most weight (of equal ones, to nine digits, the greatest) and the greatest weight."""

    def reduce(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
        texts, first = np.unique(text, return_index=True)
        if not len(texts):
            return texts, []
        last = np.append(first[1:], len(text)) - 1
        best = np.lexsort((term, np.floor(weight * 1e9 + 0.5), text))[last]
        return texts, [terms.take(pa.array(term[best])), pa.array(np.maximum.reduceat(weight, first))]

    return weighed(docs, vocabulary, reduce, "term string, weight double", **options)


def _listed(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
    texts, first = np.unique(text, return_index=True)
    offsets = pa.array(np.append(first, len(text)), pa.int32())
    return texts, [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term.astype(np.int32), weight)]


def listed(docs: DataFrame, vocabulary: DataFrame, **options) -> DataFrame:
    """id, ``places`` of the document's terms in the order of all terms, rising, and their ``weights``."""
    return weighed(docs, vocabulary, _listed, "places array<int>, weights array<double>", **options)


def scored(docs: DataFrame, vocabulary: DataFrame, coefficients: Mapping[str, float], **options) -> DataFrame:
    """id and ``sum`` of the weights times the ``coefficients`` of their terms."""
    by_place = np.array([v for _, v in sorted(coefficients.items())])

    def reduce(text: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, list]:
        texts, first = np.unique(text, return_index=True)
        return texts, [pa.array(np.add.reduceat(weight * by_place[term], first))] if len(texts) else []

    return weighed(docs, vocabulary, reduce, "sum double", **options)


def tfidf(docs: DataFrame, least_df: int = 2, most_df: float = 0.98, features: int = 50_000, sublinear: bool = True, stop: tuple[str, ...] = (), id_column: str = "doc_id", accents: bool = False) -> DataFrame:
    """(id, term, weight) of the documents that the vocabulary is fitted on."""
    fitted = vocabulary(docs, least_df, most_df, features, stop, id_column, accents)
    return weigh(docs, fitted, sublinear, stop, id_column, accents)


def search(queries: DataFrame, pages: DataFrame, top: int = 10) -> DataFrame:
    """query_id, page_id, hits, place: pages by the number of distinct query tokens that they hold.

    ``queries``: query_id, query; ``pages``: page_id, extract. Tokens are an inverted index; a join on them
    meets only pages that share one.
    """
    asked = queries.select("query_id", F.explode(T.token_set("query")).alias("token"))
    index = pages.select("page_id", F.explode(T.token_set("extract")).alias("token"))
    hits = asked.join(index, "token").groupBy("query_id", "page_id").agg(F.count("*").alias("hits"))
    place = Window.partitionBy("query_id").orderBy(F.desc("hits"), "page_id")
    return hits.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)


def pool(queries: DataFrame, pages: DataFrame, enough: int = 15, top: int = 10) -> DataFrame:
    """query_id, page_id, variant (1, 2 ...): pages that the variants find, each with the first variant that does.

    ``queries``: query_id, variants. A variant is asked only if those before have found fewer than ``enough`` pages.
    """
    asked = queries.select("query_id", F.posexplode("variants").alias("variant", "query")).select(F.struct("query_id", (F.col("variant") + 1).alias("variant")).alias("query_id"), "query")
    found = search(asked, pages, top).groupBy(F.col("query_id.query_id").alias("query_id"), "page_id").agg(F.min("query_id.variant").alias("variant"))
    before = Window.partitionBy("query_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, -1)  # a row a variant
    seen = found.groupBy("query_id", "variant").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return found.join(seen.where(F.col("before") < enough).select("query_id", "variant"), ["query_id", "variant"]).select("query_id", "page_id", "variant")
