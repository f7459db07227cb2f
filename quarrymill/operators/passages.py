"""From documents and pages to passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T


def chunk_documents(docs: DataFrame, least: int = 50, most: int = 200, id_column: str = "document_id") -> DataFrame:
    """One row a passage: the columns of ``docs`` with chunk_index, text, word_count and example_id.

    Documents without id or text, or under ``least`` words, give none; passages out of bounds are dropped.
    Rows that repeat (document, index, text) are one.
    """
    # the text is normalised once, in the row; short ones give no chunks
    chunks = T.bound(T.normalise("text"), lambda t: F.when((t != "") & (T.spaced(t) >= least), T.chunk_normalised(t, least, most)))
    rows = docs.where(F.col(id_column).isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("_chunks", chunks).drop("text")
    # "outer", as Spark else puts a filter on the chunks below the shuffle before, and makes them twice
    rows = rows.select("*", F.posexplode_outer("_chunks").alias("chunk_index", "text")).drop("_chunks").where(F.col("text").isNotNull())
    rows = rows.withColumn("word_count", T.spaced(F.col("text"))).where(F.col("word_count").between(least, most))  # chunks are normal
    rows = rows.withColumn("example_id", T.stable_id(id_column, "chunk_index", "text"))
    return rows.dropDuplicates(["example_id"])


def audit(docs: DataFrame, least: int = 50, most: int = 200, id_column: str = "doc_id") -> DataFrame:
    """One row: counts of records, missing and duplicate ids, words, and a bound on the passages."""
    n = T.word_count(T.normalise(F.coalesce("text", F.lit(""))))
    usable = F.col("text").isNotNull() & (F.trim("text") != "")
    counted = docs.select(F.col(id_column).alias("id"), usable.alias("usable"), n.alias("n"))
    words = F.when(F.col("usable"), F.col("n"))
    bound = F.when(F.col("usable") & (F.col("n") >= least), F.greatest(F.lit(1), F.ceil(F.col("n") / most)))
    return counted.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("id").isNull()).alias("missing_id"),
        F.count_if(~F.col("usable")).alias("missing_text"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"),
        F.min(words).cast("long").alias("min_words"),
        F.expr("percentile(CASE WHEN usable THEN n END, 0.5)").alias("median_words"),
        F.max(words).cast("long").alias("max_words"),
        F.sum(words).alias("total_words"),
        F.sum(bound).cast("long").alias("passage_bound"),
    )


def stratified_pages(pages: DataFrame, title_pattern: str, cap: int, least: int = 50, most: int = 200) -> DataFrame:
    """Passages of pages by stratum: ``hit`` where the title matches, else ``general``.

    Pages are taken in hash order; a stratum takes whole pages until it has ``cap`` passages, so it may
    overshoot by less than a page.
    """
    rows = pages.where(T.word_count("extract") >= least).withColumn("stratum", F.when(F.col("title").rlike(title_pattern), "hit").otherwise("general"))
    chunks = chunk_documents(rows.withColumnRenamed("extract", "text"), least, most, "page_id")
    sizes = chunks.groupBy("stratum", "page_id").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("stratum").orderBy(T.rank_key("pool", "page_id"), "page_id")
    # every page has a passage, so no more than ``cap`` pages of a stratum can count: a group limit on each task
    sizes = sizes.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= cap)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    taken = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < cap)
    return chunks.join(taken.select("stratum", "page_id"), ["stratum", "page_id"], "left_semi")
