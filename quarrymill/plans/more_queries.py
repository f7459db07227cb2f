"""Further queries: split joins, resumes, pools, windows as candidates, and combined sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import matching as G
from quarrymill.operators import pairing as R
from quarrymill.operators import splits as S
from quarrymill.plans import dataset_queries as Q
from quarrymill.plans import fixtures as X
from quarrymill.plans import match_queries as MQ
from quarrymill.plans.registry import register
from quarrymill.runtime import new_path, stage, table
from quarrymill.sources import jsonl


@register("b16_split_filter", f"{Q.SPLIT_PASSAGES_SQL} SELECT example_id, label FROM sp WHERE split = 'test'")
def split_filter(spark, d):
    return Q.split_passages(spark, d, texts=False).where("split = 'test'").select("example_id", "label")


@register("d1_unsplit_rows", f"{Q.SPLIT_PASSAGES_SQL} SELECT (SELECT count(*) FROM sp) AS joined, (SELECT count(*) FROM passages p WHERE p.document_id NOT IN (SELECT document_id FROM split)) AS missing")
def unsplit_rows(spark, d):
    rows = stage(X.passages(spark, d), "passages")
    splits = S.group_splits(rows)
    joined = S.with_splits(rows, splits).agg(F.count("*").alias("joined"))
    return joined.crossJoin(F.broadcast(S.unsplit(rows, splits).agg(F.count("*").alias("missing"))))  # two single rows


@register("d4_topic_pairs", f"WITH {MQ._CAND} SELECT s.passage_id, s.page_id, b.text <> '' AS filled FROM sc s JOIN benchmark b ON b.item_id::VARCHAR = s.passage_id WHERE s.semantic >= 0.8")
def topic_pairs(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("passage_id"), (F.col("text") != "").alias("filled"))
    return MQ._candidates(spark, d).where("semantic >= 0.8").join(items, "passage_id").select("passage_id", "page_id", "filled")


@register("d6_first_unused", f"""{Q._PSPLIT}, a AS (SELECT split, candidate_id, row_number() OVER (PARTITION BY split ORDER BY candidate_id) AS rn FROM px WHERE label = 1), b AS (SELECT split, example_id, row_number() OVER (PARTITION BY split ORDER BY {Q._RANK.format('unused', 'example_id')}) AS rn FROM px WHERE label = 0)
SELECT split, candidate_id, example_id FROM a JOIN b USING (split, rn)""")
def first_unused(spark, d):
    rows = stage(Q.split_examples(spark, d), "split")
    left = rows.where("label = 1").select("split", "candidate_id")
    right = rows.where("label = 0").select("split", "example_id")
    return R.zipped(left, right, ["split"], F.col("candidate_id"), T.rank_key("unused", "example_id"))


@register("d9_resume", "SELECT doc_id, lang FROM documents")
def resume(spark, d):
    """Two runs over overlapping rows leave each row once in the log."""
    rows = table(spark, d, "documents").select("doc_id", "lang")
    path = new_path(spark, "decisions")
    jsonl.append_decisions(rows.where("lang = 'en'"), path, "doc_id")
    jsonl.append_decisions(rows, path, "doc_id")
    return jsonl.read_jsonl(spark, [path], rows.schema)


@register("e18_target_counts", f"{Q.SPLIT_PASSAGES_SQL}, t AS (SELECT * FROM (VALUES ('train', 1248), ('validation', 268), ('test', 268)) v(split, target)) SELECT split, target, count(example_id) AS n, count(example_id) - target AS deviation FROM t LEFT JOIN sp USING (split) GROUP BY split, target")
def target_counts(spark, d):
    targets = spark.createDataFrame([("train", 1248), ("validation", 268), ("test", 268)], "split string, target int")
    counts = Q.split_passages(spark, d, texts=False).groupBy("split").agg(F.count("*").alias("n"))
    return targets.join(counts, "split", "left").na.fill(0, ["n"]).withColumn("deviation", F.col("n") - F.col("target"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(2, len({0}) - 6)), lambda i: substr({0}, i, 8)))"
_LOW = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_JAC = f"WITH {X.PAIRS_SQL}, s AS (SELECT candidate_id, {_GRAMS.format(_LOW.format('target_answer'))} AS a, {_GRAMS.format(_LOW.format('dispreferred_answer'))} AS b FROM pairs WHERE len({_LOW.format('target_answer')}) >= 8 AND len({_LOW.format('dispreferred_answer')}) >= 8), j AS (SELECT candidate_id, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS s FROM s)"


def _pair_similarity(spark, d):
    rows = X.pairs(spark, d).where((F.length(T.normalise_key("target_answer")) >= 8) & (F.length(T.normalise_key("dispreferred_answer")) >= 8))
    return rows.select("candidate_id", T.jaccard(T.char_shingles("target_answer"), T.char_shingles("dispreferred_answer")).alias("s"))


@register("g4_shingle_jaccard", f"{_JAC} SELECT candidate_id, round(s, 9) AS similarity FROM j")
def shingle_jaccard(spark, d):
    return _pair_similarity(spark, d).select("candidate_id", F.round("s", 9).alias("similarity"))


@register("g5_near_duplicate", f"{_JAC} SELECT candidate_id, s >= 0.5 AS near_duplicate FROM j")
def near_duplicate(spark, d):
    return _pair_similarity(spark, d).select("candidate_id", (F.col("s") >= 0.5).alias("near_duplicate"))


@register("g11_keyphrase_weights", f"WITH {MQ._tfidf_sql('documents', MQ._STOP, 1, 0.9, False, True)} SELECT doc_id, max_by(term, (round(weight, 9), term)) AS term, round(max(weight), 6) AS weight FROM tz GROUP BY 1")
def keyphrase_weights(spark, d):
    from quarrymill.operators import features as E

    w = MQ.key_terms(X.source_documents(spark, d), E.heaviest)
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_POOL = f"""{X.PAGES_SQL}, {MQ._tfidf_sql("(SELECT item_id AS doc_id, text FROM benchmark)", MQ._STOP, 1, 0.9, False, True)}, {MQ._PHRASES}, {MQ._VARIANTS},
vq AS (SELECT doc_id AS query_id, unnest(list_transform(keep, lambda i: v[i])[1:4]) AS q, generate_subscripts(list_transform(keep, lambda i: v[i])[1:4], 1) AS variant FROM f),
vt AS (SELECT query_id, variant, unnest(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+'))) AS token FROM vq), pt AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(extract), '[a-z0-9]+'))) AS token FROM pg),
vh AS (SELECT query_id, variant, page_id, count(*) AS hits FROM vt JOIN pt USING (token) GROUP BY ALL), vp AS (SELECT * FROM vh QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY hits DESC, page_id) <= 10),
pv AS (SELECT query_id, page_id, min(variant) AS variant FROM vp GROUP BY ALL), cum AS (SELECT query_id, variant, coalesce(sum(count(*)) OVER (PARTITION BY query_id ORDER BY variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pv GROUP BY query_id, variant)"""


@register("g13_candidate_pool", f"WITH {_POOL} SELECT query_id, page_id, variant::INTEGER AS variant FROM pv JOIN cum USING (query_id, variant) WHERE before < 15")
def candidate_pool(spark, d):
    """Pages that a text's query variants find, one variant after the other, until 15 pages have been seen."""
    from quarrymill.operators import features as E

    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    phrases = MQ.key_terms(items, E.keyphrases)
    return E.pool(phrases.select(F.col("doc_id").alias("query_id"), T.query_variants("phrases", F.lit(None).cast("string")).alias("variants")), X.pages(spark, d))


@register("g16_page_candidates", f"""WITH {MQ._WIN}, c AS (SELECT a.page_id, a.i AS f, b.i AS l FROM ps a JOIN ps b ON a.page_id = b.page_id AND a.i <= b.i AND b.p - a.p + a.n BETWEEN 85 AND 115)
SELECT page_id, count(*) AS windows FROM c JOIN pg USING (page_id) WHERE NOT (lower(title) LIKE 'list of%' OR lower(title) LIKE 'index of%' OR suffix(lower(title), '(disambiguation)') OR contains(lower(substr(extract, 1, 400)), 'refer to:') OR contains(lower(substr(extract, 1, 400)), 'refers to:')) GROUP BY 1""")
def page_candidates(spark, d):
    pages = X.pages(spark, d).where("extract <> ''").where(~T.is_list_page("title", "extract")).select("page_id", T.first_words("extract", 400).alias("opening"))
    return G.sentence_windows(pages.repartition(spark.sparkContext.defaultParallelism), 100).groupBy("page_id").agg(F.count("*").alias("windows"))


@register("g16_distinct_candidates")
def distinct_candidates(spark, d):
    """As ``g16_page_candidates``, but of pages of 50 words or more, and equal texts of a page count once."""
    pages = X.pages(spark, d).where(T.word_count("extract") >= 50).where(~T.is_list_page("title", "extract")).select("page_id", T.first_words("extract", 400).alias("opening"))
    windows = G.sentence_windows(pages.repartition(spark.sparkContext.defaultParallelism), 100, texts=True)
    return windows.groupBy("page_id").agg(F.count_distinct(F.md5("text")).alias("windows"))


@register("h5_predictions", f"WITH {X.scored_sql()} SELECT doc_id, label, score AS probability, (score >= 0.5)::INTEGER AS prediction FROM scored")
def predictions(spark, d):
    return X.scored(spark, d).select("doc_id", "label", F.col("score").alias("probability"), (F.col("score") >= 0.5).cast("int").alias("prediction"))


@register("j9_three_to_one", f"{MQ._HYBRID}, e2 AS (SELECT split, example_id, row_number() OVER (PARTITION BY split ORDER BY {Q._RANK.format('third', 'example_id')}) AS rn FROM sp WHERE negative_type = 'fr'), t2 AS (SELECT example_id, split, negative_id, row_number() OVER (PARTITION BY split ORDER BY example_id) AS rn FROM hy WHERE kind = 'topic') SELECT t2.split, t2.example_id AS positive, t2.negative_id AS topic, e2.example_id AS easy FROM t2 JOIN e2 USING (split, rn)")
def three_to_one(spark, d):
    rows = MQ.thin_passages(spark, d)
    topic = MQ._hybrid(spark, d, rows).where("kind = 'topic'").select("split", F.col("example_id").alias("positive"), F.col("negative_id").alias("topic"))
    easy = rows.where("negative_type = 'fr'").select("split", F.col("example_id").alias("easy"))
    return R.zipped(topic, easy, ["split"], F.col("positive"), T.rank_key("third", "easy"))


@register("j15_excluded_sources", f"""WITH RECURSIVE {X.PAIRS_SQL}, {Q._EX}, ex2 AS (SELECT * FROM example WHERE document_id NOT IN (SELECT document_id FROM example WHERE candidate_id::BIGINT % 9 = 0)), sizes AS (SELECT 'all' AS stratum, document_id, count(DISTINCT candidate_id) AS size FROM ex2 GROUP BY 2), {Q.SPLIT_SQL}
SELECT e.candidate_id, e.document_id, s.split FROM (SELECT DISTINCT candidate_id, document_id FROM ex2) e JOIN split s USING (document_id)""")
def excluded_sources(spark, d):
    """Pairs whose document is not in the common test set, split by document weight."""
    rows = stage(Q.examples(spark, d).select("candidate_id", "document_id").distinct(), "pairs")
    test = rows.where(F.col("candidate_id").cast("long") % 9 == 0).select("document_id").distinct()
    free = rows.join(test, "document_id", "left_anti")
    weights = free.groupBy("document_id").agg(F.count("*").alias("size")).withColumn("stratum", F.lit("all"))
    return free.join(S.balanced(weights).select("document_id", "split"), "document_id").select("candidate_id", "document_id", "split")


@register("a12_embedding_cache", "SELECT d.doc_id, len(e.embedding)::INTEGER AS dimensions FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_cache(spark, d):
    """Vectors come to their rows by id, so the order of the cache does not matter."""
    cache = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimensions"))
    return table(spark, d, "documents").select("doc_id").join(cache, "doc_id")


@register("a13_missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, d):
    """Rows that an encoder still has to do."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
