"""Line files: JSON scans and sinks, append-only logs, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """All lines of all paths (folders and globs too); blank lines are skipped."""
    return spark.read.schema(schema).json(paths)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``path`` if it is there, else no rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return read_jsonl(spark, [path], schema)
    return spark.createDataFrame([], schema)


def count_malformed(lines: DataFrame) -> DataFrame:
    """records and malformed: lines (column value) that are no JSON are counted, not fatal; blank ones are skipped."""
    rows = lines.where("value is not null and trim(value) <> ''")
    good = F.expr("try_parse_json(value)").isNotNull()
    return rows.agg(F.count("*").alias("records"), F.count_if(~good).alias("malformed"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written."""
    rows.write.option("ignoreNullFields", False).json(path)


def append_decisions(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the log does not have yet; returns what was there before. Repeating it adds nothing."""
    spark = rows.sparkSession
    before = read_jsonl_or_empty(spark, path, rows.schema)
    rows.join(before.select(key).distinct(), key, "left_anti").write.mode("append").option("ignoreNullFields", False).json(path)
    return before


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def markdown(rows: DataFrame) -> str:
    """A small result as a Markdown table (collected: for reports of a few rows)."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows.collect())
