"""Linear classifiers: training with a grid, scoring, storage, and vectors from encoders with their caches.

A model is a table of coefficients, an intercept and a threshold. Over TF-IDF its features are terms, and scoring joins
them; over vectors they are places, few enough for literals. Scoring stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import features as E
from quarrymill.operators import metrics as M
from quarrymill.runtime import stage
from quarrymill.sources.jsonl import read_jsonl_or_empty

#: Inverse strengths of the penalty that are tried. Fixed values.
GRID = (0.01, 0.1, 1.0, 10.0)
TERMS, VECTORS = "terms", "vectors"


@dataclass(frozen=True)
class LinearModel:
    """``coefficients``: feature (a term, or a place in decimal), coefficient, and for terms df and n; ``facts``: more
    to be kept with it (fingerprint of the data, encoder, dimension)."""

    kind: str
    coefficients: DataFrame
    intercept: float
    threshold: float
    facts: Mapping[str, str]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probabilities(model: LinearModel, rows: DataFrame, id_column: str = "example_id") -> DataFrame:
    """id and probability of rows (id, text) for a model over terms, (id, embedding) for one over vectors.

    A text without a known term has the intercept's probability.
    """
    if model.kind == VECTORS:
        known = {int(r["feature"]): r["coefficient"] for r in model.coefficients.select("feature", "coefficient").collect()}  # a row a dimension
        weights = F.array(*[F.lit(float(known.get(k, 0.0))) for k in range(max(known, default=-1) + 1)])
        return rows.select(id_column, sigmoid(T.dot("embedding", weights) + model.intercept).alias("probability"))
    known = {r["feature"]: r["coefficient"] for r in model.coefficients.select("feature", "coefficient").collect()}  # a row a term of the vocabulary
    sums = E.scored(rows, model.coefficients.select(F.col("feature").alias("term"), "df", "n"), known, id_column=id_column)
    return rows.select(id_column).join(sums, id_column, "left").select(id_column, sigmoid(F.coalesce("sum", F.lit(0.0)) + model.intercept).alias("probability"))


def predicted(model: LinearModel, rows: DataFrame, id_column: str = "example_id") -> DataFrame:
    """``rows`` without text and vector, with probability and prediction."""
    found = rows.drop("text", "embedding").join(probabilities(model, rows, id_column), id_column)
    return found.withColumn("prediction", (F.col("probability") >= model.threshold).cast("int"))


def _vectors(rows: DataFrame, vocabulary: DataFrame | None, id_column: str) -> tuple[DataFrame, list[str]]:
    """id, label and ml vectors, and the features' names; the vocabulary is bounded, see ``features.vocabulary``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors, VectorUDT

    if vocabulary is None:
        size = len(rows.select("embedding").first()["embedding"])
        return rows.select(id_column, "label", array_to_vector("embedding").alias("features")), [str(k) for k in range(size)]
    names = [r["term"] for r in vocabulary.select("term").orderBy("term").collect()]
    held = E.listed(rows, vocabulary, id_column=id_column)
    size = len(names)
    sparse = F.udf(lambda places, weights: Vectors.sparse(size, places or [], weights or []), VectorUDT())  # Spark has no function that makes sparse vectors
    return rows.select(id_column, "label").join(held, id_column, "left").select(id_column, "label", sparse("places", "weights").alias("features")), names


def tuned(train: DataFrame, validation: DataFrame, kind: str, grid: tuple[float, ...] = GRID, facts: Mapping[str, str] | None = None, id_column: str = "example_id", **vocabulary) -> tuple[LinearModel, list[dict]]:
    """The model of the grid that is best on ``validation``, and what each value reached there.

    Logistic regression with classes of equal weight is fitted on ``train`` alone, as is the vocabulary. The best has
    the greatest (roc_auc, f1, -C); its threshold is the one of the greatest f1. ``train`` and ``validation``: id,
    label, and text or embedding.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    terms = stage(E.vocabulary(train, id_column=id_column, **vocabulary), "vocabulary") if kind == TERMS else None
    vectors, names = _vectors(train, terms, id_column)
    n, pos = train.agg(F.count("*"), F.sum(F.col("label").cast("double"))).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(pos or 0, 1))).otherwise(n / (2 * max(n - (pos or 0), 1)))
    fitted = stage(vectors.select(F.col("label").cast("double").alias("label"), "features", weight.alias("weight")), "vectors")
    # each step of a fit gathers a gradient a part: no more parts than cores, whatever the rows
    fitted = fitted.coalesce(fitted.sparkSession.sparkContext.defaultParallelism)
    tried, best = [], None
    held = stage(_vectors(validation, terms, id_column)[0], "validation")
    # the objective over n, so that the penalty is 1 / C on the sum of the weighted losses
    fit = lambda c: LogisticRegression(standardization=False, weightCol="weight", regParam=1.0 / (c * max(n, 1)), maxIter=500, tol=1e-9).fit(fitted)
    with ThreadPoolExecutor(2) as pool:  # the steps of one fit wait for each other; each keeps its rows in memory
        models = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), grid))
    for c, found in zip(grid, models):
        scored = stage(found.transform(held).select(F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score")), "scored")
        cut = M.select_threshold(scored).first()["threshold"]
        auc = M.ranking_metrics(scored).first()["roc_auc"]
        f1 = M.point_metrics(M.confusion(scored, cut)).first()["f1"]
        tried.append({"C": c, "threshold": cut, "roc_auc": auc, "f1": f1})
        if best is None or (auc or 0.0, f1, -c) > best[0]:
            best = (auc or 0.0, f1, -c), found, cut
    spark = train.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in zip(names, best[1].coefficients.toArray())], "feature string, coefficient double")
    if terms is not None:
        table = table.join(terms.select(F.col("term").alias("feature"), "df", "n"), "feature")
    return LinearModel(kind, stage(table, "coefficients"), float(best[1].intercept), float(best[2]), facts or {}), tried


def save(model: LinearModel, path: str) -> None:
    """Coefficients as Parquet and the rest as one JSON record below ``path``."""
    model.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    spark = model.coefficients.sparkSession
    record = {"kind": model.kind, "artifact": "coefficients", "intercept": model.intercept, "threshold": model.threshold, "facts": json.dumps(dict(model.facts))}
    spark.createDataFrame([tuple(record.values())], "kind string, artifact string, intercept double, threshold double, facts string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> LinearModel:
    """The model that ``save`` wrote."""
    record = read_jsonl_or_empty(spark, f"{path}/metadata", "kind string, artifact string, intercept double, threshold double, facts string").first()
    if record is None:
        raise FileNotFoundError(f"no model in {path}")
    return LinearModel(record["kind"], spark.read.parquet(f"{path}/{record['artifact']}"), record["intercept"], record["threshold"], json.loads(record["facts"]))


def reorganised(spark: SparkSession, paths: Mapping[str, str], dataset: str, to: str) -> list[str]:
    """The models of one training run (kind -> path) in folders of their own below ``to``, named dataset_kind."""
    out = []
    for kind, path in paths.items():
        out.append(f"{to}/{dataset}_{kind}")
        save(load(spark, path), out[-1])
    return out


def score_texts(spark: SparkSession, path: str, texts: list[str], encoder: Callable | None = None) -> DataFrame:
    """text, model, probability, threshold, prediction of a few texts by the model in ``path``, in their order."""
    model = load(spark, path)
    rows = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    if model.kind == VECTORS:
        if encoder is None:
            raise ValueError("a model over vectors needs its encoder")
        rows = encoded(rows, encoder)
    found = probabilities(model, rows, "number")
    order = spark.createDataFrame(list(enumerate(texts)), "number long, text string").join(found, "number").orderBy("number")
    return order.select("text", F.lit(model.kind).alias("model"), "probability", F.lit(model.threshold).alias("threshold"), (F.col("probability") >= model.threshold).cast("int").alias("prediction"))


def cross_evaluated(model: LinearModel, tests: Mapping[str, DataFrame], id_column: str = "example_id") -> DataFrame:
    """test and all metrics of the model, with its own threshold, on other test sets (id, label, and text or embedding)."""
    out = None
    for name, rows in tests.items():
        scored = predicted(model, rows, id_column).select("label", F.col("probability").alias("score"))
        one = M.evaluated(scored, model.threshold).withColumn("test", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def top_coefficients(model: LinearModel, most: int = 30) -> DataFrame:
    """feature, coefficient, side of the greatest and the smallest ones."""
    top = lambda order, side: model.coefficients.select("feature", "coefficient").orderBy(order, "feature").limit(most).withColumn("side", F.lit(side))
    return top(F.desc("coefficient"), "positive").union(top(F.col("coefficient"), "negative"))


def hashed_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: sums of fixed random vectors of the words. It stands in for a frozen one."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimension))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                rng = np.random.default_rng(xxhash.xxh64_intdigest(word))
                out[k] += rng.standard_normal(dimension)
        return out

    return encode


def encoded(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], batch: int = 16) -> DataFrame:
    """``rows`` with ``embedding``: the encoder's vector of ``text`` at unit length (null counts as empty). The encoder
    gets ``batch`` texts at a time; it is any function that can be sent to executors."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType([*rows.schema.fields]).add("embedding", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            parts = [np.asarray(encoder(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
            if parts:
                vectors = np.concatenate(parts)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def cached_vectors(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], path: str) -> DataFrame:
    """text and embedding of all distinct ``texts`` (text): only those that the cache in ``path`` lacks are encoded, and
    appended to it."""
    spark = texts.sparkSession
    wanted = texts.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    schema = "text string, embedding array<float>"
    there = _parquet_or_empty(spark, path, schema)
    missing = wanted.join(there.select("text"), "text", "left_anti")
    encoded(missing, encoder).select("text", "embedding").write.mode("append").parquet(path)
    return _parquet_or_empty(spark, path, schema).join(wanted, "text", "left_semi").dropDuplicates(["text"])


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """SHA-256 that depends on the rows, not on their order."""
    digests = rows.select(F.sha2(F.concat_ws("\0", *columns), 256).alias("h"))
    total = F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)"))
    return digests.agg(F.sha2(F.concat_ws("-", F.count("*"), total), 256).alias("f")).first()["f"]


def dataset_vectors(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], folder: str, id_column: str = "example_id") -> DataFrame:
    """id and embedding of a dataset (id, text), from the cache of just this dataset if there is one.

    The cache's name is the dataset's fingerprint; vectors are found by id, whatever their order. A cache whose ids are
    not those of the dataset raises.
    """
    spark = rows.sparkSession
    path = f"{folder}/{fingerprint(rows, [id_column, 'text'])[:16]}"
    kind = rows.schema[id_column].dataType.simpleString()
    cache = _parquet_or_empty(spark, path, f"`{id_column}` {kind}, embedding array<float>")
    if cache.isEmpty():
        encoded(rows.select(id_column, "text"), encoder).select(id_column, "embedding").write.mode("append").parquet(path)
        cache = spark.read.parquet(path)
    ids, there = rows.select(id_column), cache.select(id_column)
    if not (ids.join(there, id_column, "left_anti").isEmpty() and there.join(ids, id_column, "left_anti").isEmpty()):
        raise ValueError(f"the vectors in {path} are not those of the dataset")
    return cache


def _parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
