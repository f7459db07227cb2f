"""The relations that the queries work on, from the input tables, each with its SQL twin.

documents become passages (English ones are positives, the other languages are kinds of negatives); labels
become scored rows; conversations become preference pairs; pages get a title and an extract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import passages as P
from quarrymill.runtime import spread, table

#: SQL for the units of a text of at most 200 words each (RE2 has no lookaround, so a mark is put in).
_UNITS = r"""flatten(list_transform(list_filter(string_split(regexp_replace(t, '([.!?])["''’”)]*\s+([A-Z0-9"''‘“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> ''),
  lambda x: list_transform(range(0, len(string_split(x, ' ')), 200), lambda i: array_to_string(string_split(x, ' ')[i + 1 : i + 200], ' '))))"""
_WORDS = "list_sum(list_transform({0}, lambda x: len(string_split(x, ' '))))"

#: CTEs up to ``passages``, without the leading WITH.
PASSAGES_SQL = rf"""
norm AS (SELECT doc_id, lang, source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
unit AS (SELECT doc_id, lang, source, t, {_UNITS} AS units FROM norm WHERE t <> ''),
pack AS (SELECT doc_id, lang, source, t, list_reduce(list_transform(units, lambda x: {{'done': []::VARCHAR[][], 'cur': [x], 'n': len(string_split(x, ' '))}}),
  lambda a, b: CASE WHEN a.n + b.n > 200 THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}} ELSE {{'done': a.done, 'cur': list_concat(a.cur, b.cur), 'n': a.n + b.n}} END) AS st FROM unit),
two AS (SELECT doc_id, lang, source, t, list_append(st.done, st.cur) AS c, st.cur AS tail, st.done[-1] AS prev, st.n::BIGINT AS tn,
  CASE WHEN len(st.done) > 0 THEN {_WORDS.format("st.done[-1]")} END::BIGINT AS pn FROM pack),
mv AS (SELECT *, CASE WHEN prev IS NULL OR tn >= 50 OR pn + tn <= 200 THEN 0 ELSE len(list_filter(range(1, len(prev)), lambda k:
  tn + CASE WHEN k = 1 THEN 0 ELSE {_WORDS.format("prev[len(prev) - k + 2 : len(prev)]")} END < 50 AND tn + {_WORDS.format("prev[len(prev) - k + 1 : len(prev)]")} <= 200)) END AS k FROM two),
chunked AS (SELECT doc_id, lang, source, t, CASE
  WHEN prev IS NULL OR tn >= 50 THEN c
  WHEN pn + tn <= 200 THEN list_append(c[1 : len(c) - 2], list_concat(prev, tail))
  ELSE list_append(list_append(c[1 : len(c) - 2], prev[1 : len(prev) - k]), list_concat(prev[len(prev) - k + 1 : len(prev)], tail)) END AS chunks FROM mv),
flat AS (SELECT doc_id, lang, source, t, unnest(list_transform(chunks, lambda x: array_to_string(x, ' '))) AS text, generate_subscripts(chunks, 1) - 1 AS chunk_index FROM chunked
  WHERE len(string_split(t, ' ')) >= 50),
passages AS (SELECT substr(sha256(doc_id || chr(0) || chunk_index || chr(0) || text), 1, 20) AS example_id, doc_id::VARCHAR AS document_id, chunk_index::INTEGER AS chunk_index, text,
  CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS label, CASE WHEN lang <> 'en' THEN lang END AS negative_type, source AS source_group, len(string_split(text, ' '))::INTEGER AS word_count
  FROM flat WHERE len(string_split(text, ' ')) BETWEEN 50 AND 200)"""

SCORED_SQL = """
scored AS (SELECT doc_id, quality AS label, CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END END AS negative_type,
  round((hu('a' || doc_id) + quality * hu('b' || doc_id)) / 2.0::DOUBLE, 3) AS score FROM labels)"""

HASH_SQL = "(('0x' || substr(md5({0}::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def scored_sql() -> str:
    """CTE ``scored``: labelled rows with a score that depends on their ids."""
    return SCORED_SQL.replace("hu('a' || doc_id)", HASH_SQL.format("('a' || doc_id)")).replace("hu('b' || doc_id)", HASH_SQL.format("('b' || doc_id)"))


PAIRS_SQL = """
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations WHERE role IN ('user', 'assistant')),
pairs AS (SELECT a.conv_id::VARCHAR AS candidate_id, (a.conv_id % 40)::VARCHAR AS doc_id, a.text AS target_answer, u.text AS dispreferred_answer, a.text <> '' AND u.text <> '' AND a.text <> u.text AS passed
  FROM turns a JOIN turns u ON a.conv_id = u.conv_id AND a.role = 'assistant' AND u.role = 'user' AND a.rn = 1 AND u.rn = 1)"""

PAGES_SQL = r"""
pg AS (SELECT page_id::VARCHAR AS page_id, url, trim(regexp_replace(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1), '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS extract FROM pages)"""


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in parts that several tasks can take."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 to 200 words of all documents."""
    docs = source_documents(spark, sf_dir)
    rows = P.chunk_documents(docs.withColumnRenamed("doc_id", "document_id"), 50, 200)
    return rows.select(
        "example_id",
        F.col("document_id").cast("string").alias("document_id"),
        "chunk_index",
        "text",
        F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("negative_type"),
        F.col("source").alias("source_group"),
        "word_count",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, negative_type, score (with ties)."""
    rows = table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    score = (T.hash_unit(F.concat(F.lit("a"), key)) + F.col("quality") * T.hash_unit(F.concat(F.lit("b"), key))) / F.lit(2.0)
    kind = F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "toxic").otherwise("plain"))
    return rows.select("doc_id", F.col("quality").alias("label"), kind.alias("negative_type"), F.round(score, 3).alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs: the first answer of the assistant against the first message of the user."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    firsts = rows.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("rn = 1")
    wide = firsts.groupBy("conv_id").pivot("role", ["assistant", "user"]).agg(F.first("text")).where("assistant is not null and user is not null")
    passed = (F.col("assistant") != "") & (F.col("user") != "") & (F.col("assistant") != F.col("user"))
    return wide.select(F.col("conv_id").cast("string").alias("candidate_id"), (F.col("conv_id") % 40).cast("string").alias("doc_id"), F.col("assistant").alias("target_answer"), F.col("user").alias("dispreferred_answer"), passed.alias("passed"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, title, extract (tags removed)."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", T.normalise(F.regexp_extract(html, "<title>([^<]*)", 1)).alias("title"), T.normalise(bare).alias("extract"))
