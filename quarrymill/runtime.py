"""Session plumbing that every operator shares: shipping the package, shared folders and staged tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
#: Rows and bytes of an Arrow batch at most: a worker holds some MB of text, however long the texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors, once per application.

    The archive goes through Spark's own file server, so driver and executors need no common folder.
    """
    for key, most in BATCH.items():  # a caller's smaller bounds stay
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        path = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
        Path(path).write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped[app] = path
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = getattr(spark, "_quarrymill_dir", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
            spark._quarrymill_dir = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor, and rows that a recomputation
    might deal differently are fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application has staged; results that still read it can't be used any more."""
    jvm = spark.sparkContext._jvm
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """``df`` in as many parts as the session has cores, and no fewer than one for each ``size`` bytes of its files, as a
    table may be one file and a task's share should not grow with the table."""
    stored = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-stored // size)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
