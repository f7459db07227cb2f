"""Queries over classifiers: fitted on a training split, tuned on another, stored, and fixed ones with SQL twins.

What is fitted has no twin (SQL has no optimiser); it is tested against Newton's method in numpy. Models with fixed
coefficients, which hash functions give, go through the same scoring, storage and evaluation and do have twins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import features as E
from quarrymill.operators import models as L
from quarrymill.plans import fixtures as X
from quarrymill.plans import match_queries as MQ
from quarrymill.plans.registry import register
from quarrymill.runtime import new_path, stage, table


def _split(spark, d):
    """Vectors with a label (five of the ten groups) and a split by their number."""
    m = F.col("vec_id") % 10
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), "embedding", (F.col("label") < 5).cast("int").alias("label"), F.when(m < 6, "train").when(m < 8, "validation").otherwise("test").alias("split"))


def _foreign(spark, d):
    """Another test set: labelled documents by their vectors, quality being the label."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(labels, "doc_id").select(F.col("doc_id").alias("example_id"), "embedding", "label")


def _tuned(spark, d):
    rows = _split(spark, d)
    return L.tuned(rows.where("split = 'train'"), rows.where("split = 'validation'"), L.VECTORS), rows


@register("h4_grid")
def grid(spark, d):
    """What each value of the grid reaches on the validation rows, and which one is taken."""
    (model, tried), _ = _tuned(spark, d)
    rows = [(t["C"], t["threshold"], t["roc_auc"], t["f1"], t["threshold"] == model.threshold) for t in tried]
    return spark.createDataFrame(rows, "C double, threshold double, roc_auc double, f1 double, taken boolean")


@register("h4_logistic_regression")
def logistic_regression(spark, d):
    """Test rows, scored by the model that was fitted on training rows and tuned on validation rows."""
    (model, _), rows = _tuned(spark, d)
    return L.predicted(model, rows.where("split = 'test'")).select(F.col("example_id").alias("vec_id"), "label", F.round("probability", 6).alias("score"), "prediction")


@register("h4_text_classifier")
def text_classifier(spark, d):
    """TF-IDF and logistic regression over the labelled documents, scored on their test split."""
    m = F.col("doc_id") % 10
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = stage(rows.select(F.col("doc_id").alias("example_id"), "text", "label", F.when(m < 6, "train").when(m < 8, "validation").otherwise("test").alias("split")), "labelled")
    model, _ = L.tuned(rows.where("split = 'train'"), rows.where("split = 'validation'"), L.TERMS)
    return L.predicted(model, rows.where("split = 'test'")).select("example_id", "label", F.round("probability", 6).alias("score"), "prediction")


@register("h7_top_coefficients")
def top_coefficients(spark, d):
    (model, _), _ = _tuned(spark, d)
    return L.top_coefficients(model)


@register("h8_cross_evaluation")
def cross_evaluation(spark, d):
    """The tuned model, with its frozen threshold, on its own test rows and on a set that it has nothing to do with."""
    (model, _), rows = _tuned(spark, d)
    return L.cross_evaluated(model, {"own": rows.where("split = 'test'"), "foreign": _foreign(spark, d)})


_COEF = "coef AS (SELECT k::VARCHAR AS feature, round({0} - 0.5::DOUBLE, 6) AS coefficient FROM range(64) t(k))".format(X.HASH_SQL.format("('c' || k)"))
_FIXED = f"""{_COEF}, ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
fixed AS (SELECT vec_id, label, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(sum(x * coefficient) + 0.1::DOUBLE))) AS score FROM ex JOIN coef ON feature = k::VARCHAR GROUP BY ALL)"""


def fixed_model(spark):
    """A model whose coefficients are hashes, saved and loaded."""
    table_ = spark.range(64).select(F.col("id").cast("string").alias("feature"), F.round(T.hash_unit(F.concat(F.lit("c"), "id")) - 0.5, 6).alias("coefficient"))
    path = new_path(spark, "model")
    L.save(L.LinearModel(L.VECTORS, table_, 0.1, 0.52, {"encoder": "table", "dimension": "64"}), path)
    return L.load(spark, path)


@register("a14_stored_model", f"WITH {_FIXED} SELECT vec_id, round(score, 6) AS score, (score >= 0.52)::INTEGER AS prediction FROM fixed")
def stored_model(spark, d):
    """Scores of a model that went through storage."""
    found = L.predicted(fixed_model(spark), table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id"), "embedding"))
    return found.select(F.col("example_id").alias("vec_id"), F.round("probability", 6).alias("score"), "prediction")


@register("h7_fixed_coefficients", f"WITH {_COEF} SELECT * FROM (SELECT feature, coefficient, 'positive' AS side FROM coef ORDER BY coefficient DESC, feature LIMIT 30) UNION ALL SELECT * FROM (SELECT feature, coefficient, 'negative' FROM coef ORDER BY coefficient, feature LIMIT 30)")
def fixed_coefficients(spark, d):
    return L.top_coefficients(fixed_model(spark))


_TESTS = "tests AS (SELECT 'own' AS test, (label < 5)::INTEGER AS label, score FROM fixed WHERE vec_id % 10 >= 8 UNION ALL SELECT 'foreign', quality, score FROM fixed JOIN labels ON doc_id = vec_id)"


@register("h8_fixed_cross_evaluation", f"""WITH {_FIXED}, {_TESTS}, c AS (SELECT test, count(*) AS n, count(*) FILTER (score < 0.52 AND label = 0) AS tn, count(*) FILTER (score >= 0.52 AND label = 0) AS fp, count(*) FILTER (score < 0.52 AND label = 1) AS fn, count(*) FILTER (score >= 0.52 AND label = 1) AS tp FROM tests GROUP BY 1),
b AS (SELECT test, avg((score - label) * (score - label)) AS br FROM tests GROUP BY 1), r AS (SELECT test, label, row_number() OVER (PARTITION BY test ORDER BY score) AS rk FROM tests), a AS (SELECT test, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE AS auc FROM r GROUP BY 1)
SELECT test, n, tn, fp, fn, tp, round((tp + tn) / n::DOUBLE, 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round(auc, 9) AS roc_auc, round(br, 9) AS brier_score FROM c JOIN a USING (test) JOIN b USING (test)""")
def fixed_cross_evaluation(spark, d):
    own = _split(spark, d).where("split = 'test'").select("example_id", "embedding", "label")
    m = L.cross_evaluated(fixed_model(spark), {"own": own, "foreign": _foreign(spark, d)})
    return m.select("test", "n", "tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "roc_auc", "brier_score")])


_FIT = "fit AS (SELECT * FROM documents WHERE doc_id % 10 < 7)"
_FIT_TFIDF = MQ._tfidf_sql("documents", "", 2, 0.98, True).replace("tn AS (SELECT count(*) AS n FROM documents)", "tn AS (SELECT count(*) AS n FROM fit)").replace("FROM tc GROUP BY 1 HAVING", "FROM tc SEMI JOIN fit USING (doc_id) GROUP BY 1 HAVING")


@register("h1_fitted_tfidf", f"WITH {_FIT}, {_FIT_TFIDF} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM tz GROUP BY 1")
def fitted_tfidf(spark, d):
    """Vocabulary and idf of the training documents alone, weights of all."""
    docs = X.source_documents(spark, d)
    w = E.weight_sums(docs, E.vocabulary(docs.where("doc_id % 10 < 7")))
    return w.select("doc_id", "terms", F.round("total", 6).alias("total"), F.round("largest", 6).alias("largest"))


_TERM = X.HASH_SQL.format("('t' || term)")


@register("a19_scored_texts", f"""WITH {_FIT}, {_FIT_TFIDF.replace('FROM documents', "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)")}
SELECT b.text, 'terms' AS model, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(coalesce(s, 0) - 0.05::DOUBLE))), 6) AS probability, 0.5::DOUBLE AS threshold, (1.0::DOUBLE / (1.0::DOUBLE + exp(-(coalesce(s, 0) - 0.05::DOUBLE))) >= 0.5)::INTEGER AS prediction
FROM benchmark b LEFT JOIN (SELECT doc_id, sum(weight * round({_TERM} - 0.5::DOUBLE, 6)) AS s FROM tz WHERE doc_id < 0 GROUP BY 1) z ON z.doc_id = -1 - b.item_id""")
def scored_texts(spark, d):
    """Single texts (the benchmark's) scored by a stored model over terms, as the command line does it."""
    terms = E.vocabulary(X.source_documents(spark, d).where("doc_id % 10 < 7"))
    table_ = terms.select(F.col("term").alias("feature"), F.round(T.hash_unit(F.concat(F.lit("t"), "term")) - 0.5, 6).alias("coefficient"), "df", "n")
    path = new_path(spark, "model")
    L.save(L.LinearModel(L.TERMS, table_, -0.05, 0.5, {}), path)
    texts = [r["text"] for r in table(spark, d, "benchmark").select("text").collect()]  # the texts of a command line
    return L.score_texts(spark, path, texts).withColumn("probability", F.round("probability", 6))


@register("a12_dataset_vectors", "SELECT item_id, 64 AS dimensions, 1.0::DOUBLE AS norm FROM benchmark")
def dataset_vectors(spark, d):
    """Vectors of a dataset from the cache that its fingerprint names: made by the first call, read by the second."""
    rows = table(spark, d, "benchmark").select("item_id", "text")
    folder = new_path(spark, "vectors")
    for _ in range(2):
        found = L.dataset_vectors(rows, L.hashed_encoder(64), folder, "item_id")
    return found.select("item_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(T.dot("embedding", "embedding")), 5).alias("norm"))


@register("a13_cached_vectors", "SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS vectors FROM benchmark")
def cached_vectors(spark, d):
    """Two calls over growing sets of texts: each distinct text is encoded once."""
    rows = table(spark, d, "benchmark").select("text")
    path = new_path(spark, "texts")
    L.cached_vectors(rows.where(F.length("text") % 2 == 0), L.hashed_encoder(16), path)
    found = L.cached_vectors(rows, L.hashed_encoder(16), path)
    return found.agg(F.count("*").alias("texts")).crossJoin(spark.read.parquet(path).agg(F.count("*").alias("vectors")))
