"""Column functions over text: normal forms, words, sentences, passages, shingles and scores.

All of them are built-in expressions; no row leaves the JVM. White space means ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends at . ! or ? before white space and a capital, digit, quote or bracket; quotes and brackets
#: that close the sentence are dropped with the white space. Fixed pattern.
SENTENCE_BREAK = "(?<=[.!?])(?:[\"'’”)]*)\\s+(?=[A-Z0-9\"'‘“(])"
#: What marks a page that only lists other pages.
LIST_PREFIXES = ("list of", "index of")
LIST_SUFFIX = "(disambiguation)"
LIST_MARKERS = ("may refer to:", "may also refer to:", "refers to:")
LIST_HEAD = 400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def normalise(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def normalise_key(text: Column | str) -> Column:
    """The lower-cased form that leakage checks compare."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"\s+", " "))


def word_count(normal: Column | str) -> Column:
    """Words of a normalised text."""
    normal = _col(normal)
    return F.when(normal == "", 0).otherwise(F.size(F.split(normal, " ")))


def sentences(normal: Column | str) -> Column:
    """Sentences of a normalised text."""
    return F.filter(F.split(_col(normal), SENTENCE_BREAK, -1), lambda s: s != "")


def spaced(text: Column) -> Column:
    """Words of a normalised text that is not empty, by its spaces: no array is made."""
    return F.length(text) - F.length(F.translate(text, " ", "")) + 1


def units(sents: Column | str, most: int) -> Column:
    """Sentences, those of more than ``most`` words cut into slices of ``most``."""

    def slices(sentence: Column) -> Column:
        return bound(F.split(sentence, " "), lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / most).cast("int")), lambda k: F.array_join(F.slice(words, k * most + 1, F.lit(most)), " ")))

    sents = _col(sents)
    whole = lambda x: spaced(x) <= most
    return F.when(F.forall(sents, whole), sents).otherwise(F.flatten(F.transform(sents, lambda x: F.when(whole(x), F.array(x)).otherwise(slices(x)))))


def starts(counts: Column, most: int) -> Column:
    """Places at which greedily filled chunks of at most ``most`` words begin, from the units' word counts."""
    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["at"] == 0) | (acc["n"] + n > most)
        return F.struct(F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"), F.when(full, n).otherwise(acc["n"] + n).alias("n"), (acc["at"] + 1).alias("at"))

    return F.aggregate(counts, empty, step, lambda acc: acc["starts"])


def _cut(parts: Column, begins: Column) -> Column:
    """The units from each start to the next."""
    return F.transform(begins, lambda b, i: F.slice(parts, b + 1, F.coalesce(F.get(begins, i + 1), F.size(parts)) - b))


def packed(parts: Column | str, most: int) -> Column:
    """Units put together greedily into chunks of at most ``most`` words: an array of arrays of units."""
    return bound(_col(parts), lambda p: bound(starts(F.transform(p, spaced), most), lambda b: _cut(p, b)))


def balanced_starts(begins: Column, sums: Column, least: int, most: int) -> Column:
    """``begins`` after the last chunk, if under ``least`` words, has joined the one before or taken its last units.

    ``sums``: words before each unit, and in all. Units move as ``rebalanced`` says.
    """
    n = F.size(begins)
    last, before = F.get(begins, n - 1), F.get(begins, n - 2)
    words = lambda a, b: F.get(sums, b) - F.get(sums, a)
    ends = F.struct(last.alias("last"), before.alias("before"), words(last, F.size(sums) - 1).alias("tail"), words(before, last).alias("head"))

    def mend(e: Column) -> Column:
        taken = lambda k: e["tail"] + words(e["last"] - k, e["last"])
        room = e["last"] - e["before"]
        tries = F.when(room > 1, F.sequence(F.lit(1), room - 1)).otherwise(F.array().cast("array<int>"))
        moves = F.size(F.filter(tries, lambda k: (taken(k - 1) < least) & (taken(k) <= most)))
        start = F.slice(begins, 1, n - 1)
        return F.when(e["tail"] >= least, begins).when(e["head"] + e["tail"] <= most, start).otherwise(F.concat(start, F.array(e["last"] - moves)))

    return F.when(n < 2, begins).otherwise(bound(ends, mend))


def _words_of(chunk: Column) -> Column:
    return F.aggregate(chunk, F.lit(0), lambda n, unit: n + F.size(F.split(unit, " ")))


def rebalanced(chunks: Column | str, least: int, most: int) -> Column:
    """A last chunk under ``least`` words joins the one before, if both fit, or takes its last units.

    Units move while the chunk before keeps one, the last is under ``least``, and it stays within ``most``.
    """

    def balance(c: Column) -> Column:
        n = F.size(c)
        ends = F.struct(F.get(c, n - 1).alias("last"), F.get(c, n - 2).alias("before"), _words_of(F.get(c, n - 1)).alias("tail"), _words_of(F.get(c, n - 2)).alias("head"))
        return F.when(n < 2, c).otherwise(bound(ends, lambda e: F.when(e["tail"] >= least, c).otherwise(mend(c, e))))

    def mend(c: Column, e: Column) -> Column:
        last, before, tail = e["last"], e["before"], e["tail"]
        start = F.slice(c, 1, F.size(c) - 2)
        return F.when(e["head"] + tail <= most, F.concat(start, F.array(F.concat(before, last)))).otherwise(bound(moves(before, tail), lambda k: F.concat(start, F.array(F.slice(before, 1, F.size(before) - k)), F.array(F.concat(F.slice(before, F.size(before) - k + 1, k), last)))))

    def moves(before: Column, tail: Column) -> Column:
        taken = lambda k: tail + _words_of(F.slice(before, F.size(before) - k + 1, k))
        tries = F.when(F.size(before) > 1, F.sequence(F.lit(1), F.size(before) - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(tries, lambda k: (taken(k - 1) < least) & (taken(k) <= most)))

    return bound(_col(chunks), balance)


def chunk_text(text: Column | str, least: int = 50, most: int = 200) -> Column:
    """Passages of a text: an array of strings. Bounds must satisfy 0 < least <= most."""
    return chunk_normalised(normalise(text), least, most)


def chunk_normalised(normal: Column, least: int = 50, most: int = 200) -> Column:
    """The same for a text that is normalised already.

    Words are counted once a unit; chunks are found on counts and their sums, and strings are joined last.
    """
    if not 0 < least <= most:
        raise ValueError("bounds must satisfy 0 < least <= most")

    def chunks(parts: Column, counts: Column) -> Column:
        sums = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        ends = F.struct(starts(counts, most).alias("b"), sums.alias("p"))
        return bound(ends, lambda e: bound(balanced_starts(e["b"], e["p"], least, most), lambda b: F.transform(_cut(parts, b), lambda c: F.array_join(c, " "))))

    return bound(units(sentences(normal), most), lambda parts: bound(F.transform(parts, spaced), lambda counts: chunks(parts, counts)))


def within_bounds(chunks: Column | str, least: int, most: int) -> Column:
    """Do all chunks have ``least`` to ``most`` words?"""
    return F.forall(_col(chunks), lambda c: word_count(c).between(least, most))


def first_words(text: Column | str, n: int) -> Column:
    """The first ``n`` words of the normalised text."""
    return F.array_join(F.slice(F.split(normalise(text), " "), 1, n), " ")


def stable_id(*parts: Column | str) -> Column:
    """20 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[_col(p).cast("string") for p in parts]), 256), 1, 20)


def rank_key(namespace: str, *parts: Column | str, seed: int = 42) -> Column:
    """The deterministic order of samples: SHA-256 of seed, namespace and key, joined by NUL."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.lit(namespace), *[_col(p).cast("string") for p in parts]), 256)


def hash_unit(text: Column | str) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(_col(text).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tokens(text: Column | str) -> Column:
    """ASCII letters and digits in runs, lower case."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def char_grams(normal: Column | str, n: int = 8) -> Column:
    """Character n-grams of a normalised text, repeated ones too; a shorter text is its own only one."""
    t = _col(normal)
    grams = F.regexp_extract_all(t, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(grams)


def char_shingles(text: Column | str, n: int = 8) -> Column:
    """Distinct character n-grams of the normalised lower-case text; a shorter text is its own only one."""
    return F.array_distinct(char_grams(normalise_key(text), n))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Similarity of two arrays of distinct values, 0 if either is empty."""
    a, b = _col(a), _col(b)
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def length_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - |a - b| / max(a, b); 0 unless both are positive."""
    a, b = _col(a), _col(b)
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(1.0 - F.abs(a - b).cast("double") / F.greatest(a, b).cast("double"))


def match_score(semantic: Column | str, keyword: Column | str, length: Column | str) -> Column:
    """0.7 * semantic + 0.2 * keyword + 0.1 * length similarity."""
    return 0.7 * _col(semantic) + 0.2 * _col(keyword) + 0.1 * _col(length)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def word_tolerance(words: Column | str, least: int = 15, relative: float = 0.1) -> Column:
    """The greater of ``least`` and ``relative`` of the words, halves rounded to even."""
    return F.greatest(F.lit(least), F.bround(_col(words) * F.lit(relative)).cast("int"))


def is_list_page(title: Column | str, extract: Column | str) -> Column:
    """Does the page only list or disambiguate others?"""
    t = F.lower(F.coalesce(_col(title), F.lit("")))
    head = F.lower(F.substring(F.coalesce(_col(extract), F.lit("")), 1, LIST_HEAD))
    out = F.endswith(t, F.lit(LIST_SUFFIX))
    for p in LIST_PREFIXES:
        out = out | F.startswith(t, F.lit(p))
    for m in LIST_MARKERS:
        out = out | F.contains(head, F.lit(m))
    return out


def query_variants(terms: Column | str, title: Column | str, most: int = 4) -> Column:
    """Search strings: three terms, two terms, each term, the title; distinct, the first ``most``."""
    t = _col(terms)
    joined = lambda n: F.when(F.size(t) >= n, F.array_join(F.slice(t, 1, n), " "))
    every = F.concat(F.array(joined(3), joined(2)), F.slice(t, 1, 3), F.array(_col(title)))
    return F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))), 1, most)


def distinct_terms(ordered: Column | str, top: int = 3) -> Column:
    """The first ``top`` terms of an ordered array of which none contains or is part of an earlier one."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, term: Column) -> Column:
        clash = F.exists(kept, lambda k: F.contains(k, term) | F.contains(term, k))
        return F.when((F.size(kept) >= top) | clash, kept).otherwise(F.concat(kept, F.array(term)))

    return F.aggregate(_col(ordered), empty, step)
