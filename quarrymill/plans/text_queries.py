"""Queries over single texts: normal forms, passages, ids, tokens, similarity of pairs of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import passages as P
from quarrymill.plans import fixtures as X
from quarrymill.plans.registry import register
from quarrymill.runtime import table

#: Title words of the stratum ``hit`` (our pages are invented prose, so plain words of it).
TITLE = r"(?i)(?:^|[^a-z])(?:the|that|anha|der|die|les)(?:[^a-z]|$)"
BODY = r"(?i)(?:^|[^a-z])(?:is|of|und|que)(?:[^a-z]|$)"


@register("b1_normalise", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents")
def normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise("text").alias("norm"))


@register("b2_normalise_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents")
def normalise_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_key("text").alias("norm"))


@register("b3_word_count", r"WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INTEGER AS words FROM n")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(T.normalise("text")).alias("words"))


@register("b4_sentences", r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])["''’”)]*\s+([A-Z0-9"''‘“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM n)
SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INTEGER AS place FROM s""")
def sentences(spark, d):
    return X.source_documents(spark, d).select("doc_id", F.posexplode(T.sentences(T.normalise("text"))).alias("place", "sentence"))


@register("b5_units", f"WITH {X.PASSAGES_SQL.split('pack AS')[0].rstrip().rstrip(',')} SELECT doc_id, len(units)::INTEGER AS units, list_max(list_transform(units, lambda x: len(string_split(x, ' '))))::INTEGER AS longest FROM unit")
def units(spark, d):
    rows = X.source_documents(spark, d).withColumn("t", T.normalise(F.coalesce("text", F.lit("")))).where("t <> ''")
    rows = rows.withColumn("u", T.units(T.sentences("t"), 200))
    return rows.select("doc_id", F.size("u").alias("units"), F.array_max(F.transform("u", T.word_count)).alias("longest"))


@register("b6_packed", f"WITH {X.PASSAGES_SQL.split('mv AS')[0].rstrip().rstrip(',')} SELECT doc_id, len(c)::INTEGER AS chunks, tn::INTEGER AS last_words FROM two")
def packed(spark, d):
    rows = X.source_documents(spark, d).withColumn("t", T.normalise(F.coalesce("text", F.lit("")))).where("t <> ''")
    rows = rows.withColumn("c", T.packed(T.units(T.sentences("t"), 200), 200))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.aggregate(F.get("c", F.size("c") - 1), F.lit(0), lambda n, u: n + T.word_count(u)).alias("last_words"))


@register("b7_rebalanced", f"WITH {X.PASSAGES_SQL.split('flat AS')[0].rstrip().rstrip(',')} SELECT doc_id, list_transform(chunks, lambda x: len(string_split(array_to_string(x, ' '), ' ')))::VARCHAR AS words FROM chunked")
def rebalanced(spark, d):
    rows = X.source_documents(spark, d).where("trim(coalesce(text, '')) <> ''")
    counts = F.transform(T.chunk_text("text"), lambda c: T.word_count(c).cast("string"))
    return rows.select("doc_id", F.concat(F.lit("["), F.array_join(counts, ", "), F.lit("]")).alias("words"))


@register("b8_chunks_in_bounds", f"WITH {X.PASSAGES_SQL.split('flat AS')[0].rstrip().rstrip(',')} SELECT doc_id, len(list_filter(chunks, lambda x: len(string_split(array_to_string(x, ' '), ' ')) NOT BETWEEN 50 AND 200)) = 0 AS valid FROM chunked")
def in_bounds(spark, d):
    rows = X.source_documents(spark, d).where("trim(coalesce(text, '')) <> ''")
    return rows.select("doc_id", T.within_bounds(T.chunk_text("text"), 50, 200).alias("valid"))


@register("b10_passages", f"WITH {X.PASSAGES_SQL} SELECT DISTINCT example_id, document_id, chunk_index, label, negative_type, source_group, word_count, md5(text) AS text_md5 FROM passages")
def passages(spark, d):
    return X.passages(spark, d).withColumn("text_md5", F.md5("text")).drop("text")


_PAGE_CHUNKS = X.PASSAGES_SQL.replace("norm AS (SELECT doc_id, lang, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)", "norm AS (SELECT page_id AS doc_id, title AS lang, url AS source, extract AS t FROM pg)")


@register("b11_page_passages", f"WITH {X.PAGES_SQL}, {_PAGE_CHUNKS} SELECT example_id, document_id AS page_id, chunk_index, word_count, md5(text) AS text_md5 FROM passages")
def page_passages(spark, d):
    pages = X.pages(spark, d).repartition(spark.sparkContext.defaultParallelism)
    rows = P.chunk_documents(pages.withColumnRenamed("extract", "text"), 50, 200, "page_id")
    return rows.select("example_id", "page_id", "chunk_index", "word_count", F.md5("text").alias("text_md5"))


@register("b12_page_strata", f"""WITH {X.PAGES_SQL}, {_PAGE_CHUNKS},
c AS (SELECT CASE WHEN regexp_matches(p.title, '{TITLE}') THEN 'hit' ELSE 'general' END AS stratum, x.document_id AS page_id, count(*) AS n FROM passages x JOIN pg p ON p.page_id = x.document_id GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY sha256('42' || chr(0) || 'pool' || chr(0) || page_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT stratum, count(*) AS pages, sum(n)::BIGINT AS passages FROM b WHERE before < 60 GROUP BY stratum""")
def page_strata(spark, d):
    pages = X.pages(spark, d).repartition(spark.sparkContext.defaultParallelism)
    rows = P.stratified_pages(pages, TITLE, 60)
    return rows.groupBy("stratum").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("passages"))


@register("b13_term_patterns", f"WITH {X.PAGES_SQL} SELECT page_id, regexp_matches(title, '{TITLE}') AS in_title, regexp_matches(extract, '{BODY}') AS in_body FROM pg")
def term_patterns(spark, d):
    return X.pages(spark, d).select("page_id", F.col("title").rlike(TITLE).alias("in_title"), F.col("extract").rlike(BODY).alias("in_body"))


@register("b14_list_pages", f"""WITH {X.PAGES_SQL} SELECT page_id, lower(title) LIKE 'list of%' OR lower(title) LIKE 'index of%' OR suffix(lower(title), '(disambiguation)')
  OR contains(lower(substr(extract, 1, 400)), 'may refer to:') OR contains(lower(substr(extract, 1, 400)), 'may also refer to:') OR contains(lower(substr(extract, 1, 400)), 'refers to:') AS is_list FROM pg""")
def list_pages(spark, d):
    return X.pages(spark, d).select("page_id", T.is_list_page("title", "extract").alias("is_list"))


@register("b15_quality_pairs", f"WITH {X.PAIRS_SQL} SELECT candidate_id, doc_id FROM pairs WHERE passed AND doc_id IS NOT NULL")
def quality_pairs(spark, d):
    return X.pairs(spark, d).where("passed and doc_id is not null").select("candidate_id", "doc_id")


@register("b17_audit", r"""WITH n AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t <> '' AS usable, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM n)
SELECT count(*) AS records, count(*) - count(doc_id) AS missing_id, count(*) FILTER (NOT usable) AS missing_text, count(doc_id) - count(DISTINCT doc_id) AS duplicate_ids,
  min(n) FILTER (usable)::BIGINT AS min_words, quantile_cont(n, 0.5) FILTER (usable)::DOUBLE AS median_words, max(n) FILTER (usable)::BIGINT AS max_words, sum(n) FILTER (usable)::BIGINT AS total_words,
  sum(greatest(1, ceil(n / 200.0::DOUBLE))) FILTER (usable AND n >= 50)::BIGINT AS passage_bound FROM w""")
def audit(spark, d):
    return P.audit(table(spark, d, "documents"))


@register("b18_first_words", r"SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:400], ' ') AS opening FROM documents")
def first_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_words("text", 400).alias("opening"))


@register("c1_stable_id", "SELECT doc_id, substr(sha256(doc_id || chr(0) || '0' || chr(0) || text), 1, 20) AS id FROM documents")
def stable_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id("doc_id", F.lit(0), "text").alias("id"))


@register("c2_variadic_id", f"WITH {X.PAGES_SQL} SELECT page_id, substr(sha256('page-' || page_id || chr(0) || extract), 1, 20) AS id FROM pg")
def variadic_id(spark, d):
    return X.pages(spark, d).select("page_id", T.stable_id(F.concat(F.lit("page-"), "page_id"), "extract").alias("id"))


@register("c3_rank_key", "SELECT doc_id, sha256('42' || chr(0) || 'sample' || chr(0) || doc_id) AS rank_key FROM documents")
def rank_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.rank_key("sample", "doc_id").alias("rank_key"))


@register("g1_tokens", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM documents")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens("text"), " ").alias("tokens"))


@register("g2_token_set", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INTEGER AS distinct_tokens FROM documents")
def token_set(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.token_set("text")).alias("distinct_tokens"))


@register("g3_char_shingles", f"WITH {X.PASSAGES_SQL}, n AS (SELECT example_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM passages) SELECT example_id, len(list_distinct(list_transform(range(1, greatest(2, len(t) - 6)), lambda i: substr(t, i, 8))))::INTEGER AS shingles FROM n")
def char_shingles(spark, d):
    return X.passages(spark, d).select("example_id", F.size(T.char_shingles("text")).alias("shingles"))


_PAIR_TOKENS = f"WITH {X.PAIRS_SQL}, s AS (SELECT candidate_id, list_distinct(regexp_extract_all(lower(target_answer), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(dispreferred_answer), '[a-z0-9]+')) AS b, target_answer AS x, dispreferred_answer AS y FROM pairs)"


@register("g6_keyword_overlap", f"{_PAIR_TOKENS} SELECT candidate_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 9) END AS overlap FROM s")
def keyword_overlap(spark, d):
    return X.pairs(spark, d).select("candidate_id", F.round(T.jaccard(T.token_set("target_answer"), T.token_set("dispreferred_answer")), 9).alias("overlap"))


_WORDS = "CASE WHEN trim({0}) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END"


@register("g7_length_similarity", f"WITH {X.PAIRS_SQL}, w AS (SELECT candidate_id, {_WORDS.format('target_answer')} AS a, {_WORDS.format('dispreferred_answer')} AS b FROM pairs) SELECT candidate_id, CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE round(1 - abs(a - b)::DOUBLE / greatest(a, b)::DOUBLE, 9) END AS similarity FROM w")
def length_similarity(spark, d):
    n = lambda c: T.word_count(T.normalise(c))
    return X.pairs(spark, d).select("candidate_id", F.round(T.length_similarity(n("target_answer"), n("dispreferred_answer")), 9).alias("similarity"))


@register("g8_match_score", f"""{_PAIR_TOKENS}, k AS (SELECT candidate_id, {X.HASH_SQL.format("candidate_id")} AS sem, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS kw,
  {_WORDS.format('x')} AS m, {_WORDS.format('y')} AS n FROM s)
SELECT candidate_id, round(0.7::DOUBLE * sem + 0.2::DOUBLE * kw + 0.1::DOUBLE * CASE WHEN m <= 0 OR n <= 0 THEN 0 ELSE 1 - abs(m - n)::DOUBLE / greatest(m, n)::DOUBLE END, 8) AS score FROM k""")
def match_score(spark, d):
    n = lambda c: T.word_count(T.normalise(c))
    overlap = T.jaccard(T.token_set("target_answer"), T.token_set("dispreferred_answer"))
    length = T.length_similarity(n("target_answer"), n("dispreferred_answer"))
    return X.pairs(spark, d).select("candidate_id", F.round(T.match_score(T.hash_unit("candidate_id"), overlap, length), 8).alias("score"))


@register("g9_dot_product", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_product(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(other, F.col("vec_id") == F.col("a")).select("a", "b", F.round(T.dot("embedding", "other"), 6).alias("similarity"))


@register("g14_word_tolerance", "SELECT DISTINCT n_chars, greatest(15, round_even(n_chars * 0.1::DOUBLE, 0))::INTEGER AS tolerance FROM documents")
def word_tolerance(spark, d):
    return table(spark, d, "documents").select("n_chars", T.word_tolerance("n_chars").alias("tolerance")).distinct()
