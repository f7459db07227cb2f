"""Queries that evaluate scores: metrics, slices, thresholds, pairs and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import metrics as M
from quarrymill.operators import pairing as R
from quarrymill.operators import stats
from quarrymill.operators.ordering import positions
from quarrymill.plans import fixtures as X
from quarrymill.plans.registry import register
from quarrymill.runtime import new_path, stage, table

_S = X.scored_sql()
_D = "ds AS (SELECT score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM scored GROUP BY 1)"
_CUT = "ct AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(n) OVER (ORDER BY score) - n AS below FROM ds)"


@register("f1_confusion", f"WITH {_S} SELECT count(*) AS n, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM scored")
def confusion(spark, d):
    return M.confusion(X.scored(spark, d), 0.5)


@register("f2_point_metrics", f"""WITH {_S}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (score < 0.5 AND label = 0)::DOUBLE AS tn, count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE AS tp FROM scored)
SELECT round((tp + tn) / n, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def point_metrics(spark, d):
    m = M.point_metrics(M.confusion(X.scored(spark, d), 0.5))
    return m.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("f3_roc_auc", f"WITH {_S}, {_D}, {_CUT} SELECT round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 9) AS roc_auc FROM ct")
def roc_auc(spark, d):
    return M.ranking_metrics(X.scored(spark, d)).select(F.round("roc_auc", 9).alias("roc_auc"))


@register("f4_average_precision", f"WITH {_S}, {_D}, {_CUT} SELECT round(sum(p * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(p)::DOUBLE, 9) AS average_precision FROM ct")
def average_precision(spark, d):
    return M.ranking_metrics(X.scored(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


@register("f5_brier", f"WITH {_S} SELECT round(avg((score - label) * (score - label)), 9) AS brier_score FROM scored")
def brier(spark, d):
    return M.brier(X.scored(spark, d)).select(F.round("brier_score", 9).alias("brier_score"))


@register("f6_threshold", f"""WITH {_S}, {_D}, {_CUT}, t AS (SELECT sum(p) AS all_p FROM ds), q AS (SELECT score, tp::DOUBLE / greatest((tp + fp)::DOUBLE, 1e-12) AS pr, tp::DOUBLE / greatest(all_p::DOUBLE, 1e-12) AS re FROM ct, t),
f AS (SELECT score, 2.0::DOUBLE * pr * re / greatest(pr + re, 1e-12) AS f1 FROM q) SELECT score AS threshold, round(f1, 9) AS f1 FROM f ORDER BY round(f1, 12) DESC, score LIMIT 1""")
def threshold(spark, d):
    return M.select_threshold(X.scored(spark, d)).select("threshold", F.round("f1", 9).alias("f1"))


_SLICED = "sl AS (SELECT 'overall' AS slice, * FROM scored UNION ALL SELECT k.negative_type, s.* FROM scored s JOIN (SELECT DISTINCT negative_type FROM scored WHERE negative_type IS NOT NULL) k ON s.label = 1 OR s.negative_type = k.negative_type)"


@register("f7_slices", f"""WITH {_S}, {_SLICED}, c AS (SELECT slice, count(*) AS n, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, avg((score - label) * (score - label)) AS br FROM sl GROUP BY 1),
dd AS (SELECT slice, score, sum(label) AS p, sum(1 - label) AS n FROM sl GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY slice ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY slice ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY slice ORDER BY score DESC) AS fp FROM dd),
a AS (SELECT slice, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) AS auc, sum(p * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(p)::DOUBLE AS ap FROM r GROUP BY 1)
SELECT slice, n, round((tp + tn) / n::DOUBLE, 9) AS accuracy, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision, round(br, 9) AS brier_score FROM c JOIN a USING (slice)""")
def slices(spark, d):
    m = M.evaluated(M.sliced(X.scored(spark, d)), 0.5, ("slice",))
    return m.select("slice", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "roc_auc", "average_precision", "brier_score")])


_GRID = f"grid AS (SELECT c, doc_id, label, round({X.HASH_SQL.format('(c || doc_id)')} + label * c / 20.0::DOUBLE, 3) AS score FROM scored, (SELECT unnest([1, 2, 4, 8]) AS c))"


@register("f8_model_selection", f"""WITH {_S}, {_GRID}, g AS (SELECT c, score, sum(label) AS p, sum(1 - label) AS n FROM grid GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY c ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY c ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY c) AS ap FROM g),
a AS (SELECT c, round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 9) AS roc_auc, round(max(2.0::DOUBLE * tp / (tp + fp + ap)), 9) AS f1 FROM r GROUP BY c) SELECT c, roc_auc, f1 FROM a ORDER BY roc_auc DESC, f1 DESC, c LIMIT 1""")
def model_selection(spark, d):
    """The best of four by (roc_auc, f1 at the best threshold, smallest c)."""
    rows = X.scored(spark, d).withColumn("c", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8)])))
    rows = rows.withColumn("score", F.round(T.hash_unit(F.concat("c", "doc_id")) + F.col("label") * F.col("c") / F.lit(20.0), 3))
    auc = M.ranking_metrics(rows, ("c",)).select("c", F.round("roc_auc", 9).alias("roc_auc"))
    f1 = M.select_threshold(rows, ("c",)).select("c", F.round("f1", 9).alias("f1"))
    return auc.join(f1, "c").orderBy(F.desc("roc_auc"), F.desc("f1"), "c").limit(1)


@register("d13_error_rows", f"WITH {_S} SELECT doc_id, label, score FROM scored WHERE label <> (score >= 0.5)::INTEGER")
def error_rows(spark, d):
    return X.scored(spark, d).where(F.col("label") != (F.col("score") >= 0.5).cast("int")).select("doc_id", "label", "score")


@register("h6_error_report", f"WITH {_S} SELECT d.source, count(*) AS errors FROM scored s JOIN documents d USING (doc_id) WHERE label <> (score >= 0.5)::INTEGER GROUP BY 1")
def error_report(spark, d):
    return error_rows(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("errors"))


_HP, _HN = X.HASH_SQL.format("('p' || candidate_id)"), X.HASH_SQL.format("('n' || candidate_id)")
_SCORES = f"WITH {X.PAIRS_SQL}, ps AS (SELECT candidate_id, round({_HP}, 2) AS positive_score, round({_HN}, 2) AS negative_score, target_answer, dispreferred_answer FROM pairs), m AS (SELECT *, round(positive_score - negative_score, 6) AS margin FROM ps)"


def pair_scores(spark, d):
    unit = lambda k: F.round(T.hash_unit(F.concat(F.lit(k), "candidate_id")), 2)
    rows = X.pairs(spark, d).select("candidate_id", unit("p").alias("positive_score"), unit("n").alias("negative_score"), "target_answer", "dispreferred_answer")
    return rows.withColumn("margin", F.round(F.col("positive_score") - F.col("negative_score"), 6))


@register("e9_score_summary", f"{_SCORES} SELECT count(*) AS n, count(*) FILTER (margin > 1e-9) AS wins, count(*) FILTER (margin < -1e-9) AS losses, count(*) FILTER (abs(margin) <= 1e-9) AS ties, round(avg((margin > 1e-9)::INTEGER), 9) AS win_rate, round(avg(margin), 9) AS mean_margin, round(quantile_cont(margin, 0.5), 9) AS median_margin FROM m")
def score_summary(spark, d):
    s = R.score_summary(pair_scores(spark, d))
    return s.select("n", "wins", "losses", "ties", *[F.round(c, 9).alias(c) for c in ("win_rate", "mean_margin", "median_margin")])


@register("e10_threshold_outcomes", f"{_SCORES} SELECT count(*) FILTER (positive_score >= 0.5 AND negative_score >= 0.5) AS both, count(*) FILTER (positive_score >= 0.5 AND negative_score < 0.5) AS target_only, count(*) FILTER (positive_score < 0.5 AND negative_score >= 0.5) AS other_only, count(*) FILTER (positive_score < 0.5 AND negative_score < 0.5) AS neither FROM m")
def threshold_outcomes(spark, d):
    a, b = F.col("positive_score") >= 0.5, F.col("negative_score") >= 0.5
    return pair_scores(spark, d).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("target_only"), F.count_if(~a & b).alias("other_only"), F.count_if(~a & ~b).alias("neither"))


@register("e11_answer_lengths", rf"{_SCORES}, w AS (SELECT len(string_split(trim(regexp_replace(target_answer, '\s+', ' ', 'g')), ' ')) AS a FROM m WHERE trim(target_answer) <> '') SELECT min(a)::INTEGER AS least, quantile_cont(a, 0.5)::DOUBLE AS median, max(a)::INTEGER AS most, count(*) FILTER (a < 50) AS short FROM w")
def answer_lengths(spark, d):
    w = pair_scores(spark, d).where("trim(target_answer) <> ''").select(T.word_count(T.normalise("target_answer")).alias("a"))
    return w.agg(F.min("a").alias("least"), F.expr("percentile(a, 0.5)").alias("median"), F.max("a").alias("most"), F.count_if(F.col("a") < 50).alias("short"))


@register("h10_winner_labels", f"{_SCORES} SELECT candidate_id, margin, CASE WHEN margin > 1e-9 THEN 'target' WHEN margin < -1e-9 THEN 'dispreferred' ELSE 'tie' END AS winner FROM m")
def winner_labels(spark, d):
    winner = F.when(F.col("margin") > 1e-9, "target").when(F.col("margin") < -1e-9, "dispreferred").otherwise("tie")
    return pair_scores(spark, d).select("candidate_id", "margin", winner.alias("winner"))


@register("h11_sample_picks", f"{_SCORES}, a AS (SELECT 'high' AS pick, candidate_id, margin FROM m ORDER BY margin DESC, candidate_id LIMIT 3), b AS (SELECT 'low', candidate_id, margin FROM m ORDER BY margin, candidate_id LIMIT 3), c AS (SELECT 'close', candidate_id, margin FROM m ORDER BY abs(margin), candidate_id LIMIT 2) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def sample_picks(spark, d):
    rows = pair_scores(spark, d).select("candidate_id", "margin")
    top = lambda name, n, key: rows.orderBy(key, "candidate_id").limit(n).select(F.lit(name).alias("pick"), "candidate_id", "margin")
    return top("high", 3, F.desc("margin")).union(top("low", 3, F.col("margin"))).union(top("close", 2, F.abs("margin")))


_MODELS = f"WITH {X.PAIRS_SQL}, mm AS (SELECT candidate_id, k, round({X.HASH_SQL.format('(k || candidate_id)')} - 0.4::DOUBLE, 3) AS margin FROM pairs, (SELECT unnest([1, 2, 3]) AS k))"


def model_margins(spark, d):
    rows = X.pairs(spark, d).select("candidate_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k"))
    return rows.withColumn("margin", F.round(T.hash_unit(F.concat("k", "candidate_id")) - 0.4, 3))


@register("d12_common_candidates", f"{_MODELS} SELECT candidate_id FROM mm WHERE margin > -0.3 GROUP BY 1 HAVING count(DISTINCT k) = 3")
def common_candidates(spark, d):
    return model_margins(spark, d).where("margin > -0.3").groupBy("candidate_id").agg(F.count_distinct("k").alias("n")).where("n = 3").select("candidate_id")


_RECORDS = "g AS (SELECT candidate_id, bool_and(margin > 0) AS up, bool_and(margin < 0) AS down, round(avg(margin), 9) AS mean, round(sum(abs(margin)), 9) AS spread FROM mm GROUP BY 1)"


def _records(spark, d):
    return model_margins(spark, d).groupBy("candidate_id").agg(F.every(F.col("margin") > 0).alias("up"), F.every(F.col("margin") < 0).alias("down"), F.round(F.avg("margin"), 9).alias("mean"), F.round(F.sum(F.abs("margin")), 9).alias("spread"))


@register("h12_consensus", f"{_MODELS}, {_RECORDS} SELECT candidate_id, CASE WHEN up THEN 'all_positive' ELSE 'all_negative' END AS kind, mean FROM g WHERE up OR down")
def consensus(spark, d):
    return _records(spark, d).where("up or down").select("candidate_id", F.when(F.col("up"), "all_positive").otherwise("all_negative").alias("kind"), "mean")


@register("h12_consensus_picks", f"""{_MODELS}, {_RECORDS}, k AS (SELECT candidate_id, CASE WHEN up THEN 'all_positive' ELSE 'all_negative' END AS kind, mean FROM g WHERE up OR down), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mean, candidate_id) - 1 AS place, count(*) OVER (PARTITION BY kind) AS n FROM k)
SELECT kind, candidate_id FROM o WHERE n < 2 OR place IN (n // 2 - 1, n // 2) UNION ALL SELECT 'near_tie', candidate_id FROM (SELECT candidate_id FROM g ORDER BY spread, candidate_id LIMIT 1)""")
def consensus_picks(spark, d):
    """The two around the median mean margin of the candidates on which all models agree, and the one nearest to a tie."""
    records = stage(_records(spark, d), "records")
    agreed = records.where("up or down").select("candidate_id", F.when(F.col("up"), "all_positive").otherwise("all_negative").alias("kind"), "mean")
    sizes = agreed.groupBy("kind").agg(F.count("*").alias("n"))
    placed = positions(agreed, ["kind"], [F.col("mean"), F.col("candidate_id")], "place").join(F.broadcast(sizes), "kind")  # two kinds
    half = F.floor(F.col("n") / 2)
    picks = placed.where((F.col("n") < 2) | F.col("place").isin(half - 1, half)).select("kind", "candidate_id")
    return picks.unionByName(records.orderBy("spread", "candidate_id").limit(1).select(F.lit("near_tie").alias("kind"), "candidate_id"))


@register("h9_unique_scoring", f"WITH t AS (SELECT DISTINCT md5(text) AS h FROM documents) SELECT d.doc_id, round({X.HASH_SQL.format('md5(d.text)')}, 9) AS score FROM documents d JOIN t ON t.h = md5(d.text)")
def unique_scoring(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    scores = docs.select("h").distinct().withColumn("score", F.round(T.hash_unit("h"), 9))
    return docs.join(scores, "h").select("doc_id", "score")


#: Names shown for the keys of result names, and the tests that the combined model is reported on.
_TRAINED = {"easy": "Easy", "combined": "Combined"}
_KINDS = {"tfidf": "TF-IDF", "vec": "Vectors"}
_TESTED = {"easy": "Easy", "hybrid": "Hybrid", "topic": "Topic", "preference": "Preference"}
_COMBINED_TESTS = ("easy", "topic", "preference")
_PATTERN = "^(.*)_([^_]*)_on_(.*)$"
_NAME = "CASE WHEN doc_id % 3 = 0 THEN 'combined' ELSE 'easy' END || '_' || CASE WHEN doc_id % 2 = 0 THEN 'tfidf' ELSE 'vec' END || '_on_' || (['easy', 'hybrid', 'topic', 'preference', 'other'])[1 + doc_id % 5]"


def _named(names: dict[str, str], column: str) -> str:
    return f"coalesce(CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" END, {column})"


@register("h13_result_matrix", f"""WITH {_S}, n AS (SELECT {_NAME} AS name, label, score FROM scored), k AS (SELECT regexp_extract(name, '{_PATTERN}', 1) AS tr, regexp_extract(name, '{_PATTERN}', 2) AS mo, regexp_extract(name, '{_PATTERN}', 3) AS te, label, score FROM n),
q AS (SELECT * FROM k WHERE tr <> 'combined' OR te IN {_COMBINED_TESTS}), c AS (SELECT tr, mo, te, count(*) AS n, count(*) FILTER (label = (score >= 0.5)::INTEGER) AS hits, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM q GROUP BY ALL),
r AS (SELECT tr, mo, te, score, sum(label) AS p, sum(1 - label) AS m FROM q GROUP BY ALL), b AS (SELECT *, sum(m) OVER (PARTITION BY tr, mo, te ORDER BY score) - m AS below FROM r), a AS (SELECT tr, mo, te, CASE WHEN sum(p) > 0 AND sum(m) > 0 THEN sum(p * (below + m / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(m)::DOUBLE) END AS auc FROM b GROUP BY ALL)
SELECT {_named(_TRAINED, 'tr')} AS training_dataset, {_named(_KINDS, 'mo')} AS model, {_named(_TESTED, 'te')} AS test_dataset, n, printf('%.4f', hits / n::DOUBLE) AS accuracy, printf('%.4f', CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END) AS f1, printf('%.4f', auc) AS roc_auc FROM c JOIN a USING (tr, mo, te)""")
def result_matrix(spark, d):
    """Metrics by (training set, model, test set), which the name of a result gives; a combined model counts on three tests."""
    tests = F.array(*[F.lit(t) for t in (*_TESTED, "other")])
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "combined").otherwise("easy"), F.lit("_"), F.when(F.col("doc_id") % 2 == 0, "tfidf").otherwise("vec"), F.lit("_on_"), F.get(tests, (F.col("doc_id") % 5).cast("int")))
    part = lambda i: F.regexp_extract("name", _PATTERN, i)
    rows = X.scored(spark, d).select(name.alias("name"), "label", "score").select(part(1).alias("training_dataset"), part(2).alias("model"), part(3).alias("test_dataset"), "label", "score")
    keys = ("training_dataset", "model", "test_dataset")
    rows = rows.where((F.col("training_dataset") != "combined") | F.col("test_dataset").isin(*_COMBINED_TESTS))
    shown = lambda names, c: F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), lambda k, _: k == F.col(c))), 0), F.col(c)).alias(c)
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).alias(c)
    found = M.evaluated(rows, 0.5, keys)
    return found.select(shown(_TRAINED, keys[0]), shown(_KINDS, keys[1]), shown(_TESTED, keys[2]), "n", number("accuracy"), number("f1"), number("roc_auc"))


@register("e7_quantiles", f"WITH {_S} SELECT " + ", ".join(f"round(quantile_cont(score, {q})::DOUBLE, 9) AS {k}" for k, q in (("min", 0), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", 1))) + ", round(avg(score), 9) AS mean FROM scored")
def quantiles(spark, d):
    q = stats.quantiles(X.scored(spark, d), "score")
    return q.select(*[F.round(c, 9).alias(c) for c in q.columns])


@register("e8_weak_rows", f"WITH {_S} SELECT doc_id, score FROM scored WHERE score <= (SELECT quantile_cont(score, 0.1) FROM scored)")
def weak_rows(spark, d):
    rows = X.scored(spark, d)
    cut = rows.agg(F.expr("percentile(score, 0.1)").alias("cut"))  # one number
    return rows.crossJoin(F.broadcast(cut)).where("score <= cut").select("doc_id", "score")


@register("e16_source_metrics", f"""WITH {_S}, j AS (SELECT d.lang, s.* FROM scored s JOIN documents d USING (doc_id)), c AS (SELECT lang, count(*) AS n, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, avg((score - label) * (score - label)) AS br FROM j GROUP BY 1),
dd AS (SELECT lang, score, sum(label) AS p, sum(1 - label) AS n FROM j GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS fp FROM dd),
a AS (SELECT lang, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) END AS auc, CASE WHEN sum(p) > 0 THEN sum(p * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(p)::DOUBLE END AS ap FROM r GROUP BY 1)
SELECT lang, n, tn, fp, fn, tp, round((tp + tn) / n::DOUBLE, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision, round(br, 9) AS brier_score FROM c JOIN a USING (lang)""")
def source_metrics(spark, d):
    rows = X.scored(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    m = M.evaluated(rows, 0.5, ("lang",))
    return m.select("lang", "n", "tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier_score")])


@register("i1_bootstrap", f"""{_SCORES}, v AS (SELECT margin, row_number() OVER (ORDER BY candidate_id) - 1 AS rn FROM m), n AS (SELECT count(*) AS n FROM v),
dr AS (SELECT b, ('0x' || substr(md5(b || '-' || rn), 1, 8))::UBIGINT::BIGINT % n AS at FROM v, n, range(10000) t(b)), me AS (SELECT b, avg(v.margin) AS mean FROM dr JOIN v ON v.rn = dr.at GROUP BY b)
SELECT round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM me""")
def bootstrap(spark, d):
    rows = positions(pair_scores(spark, d).select("candidate_id", "margin"), [], [F.col("candidate_id")], "rn").select("margin", "rn")
    return stats.bootstrap_interval(rows).select(F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@register("i2_sign_test", f"{_SCORES}, c AS (SELECT count(*) FILTER (margin > 1e-9) AS w, count(*) FILTER (margin < -1e-9) AS l FROM m) SELECT w AS wins, l AS losses, round((SELECT sum(exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2))) FROM range(w, w + l + 1) t(k)), 9) AS p FROM c")
def sign_test(spark, d):
    return stats.sign_test(pair_scores(spark, d)).select("wins", "losses", F.round("p", 9).alias("p"))


_Z = "(w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)"
# the normal tail by Simpson's rule over [0, z]; exact for few untied differences is tested in Python
_TAIL = "0.5::DOUBLE - (SELECT sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * k / 2000.0::DOUBLE) * (z * k / 2000.0::DOUBLE) / 2)) * z / 6000.0::DOUBLE / sqrt(2 * pi()) FROM range(2001) t(k))"


@register("i3_signed_rank", f"""{_SCORES}, a AS (SELECT abs(margin) AS x, count(*) AS t, count(*) FILTER (margin > 0) AS up FROM m WHERE margin <> 0 GROUP BY 1), r AS (SELECT *, sum(t) OVER (ORDER BY x) - (t - 1) / 2.0::DOUBLE AS rk FROM a),
s AS (SELECT sum(t)::DOUBLE AS n, sum(rk * up) AS w, sum(t * t * t - t)::DOUBLE AS ties FROM r), y AS (SELECT n, w, {_Z} AS z FROM s) SELECT n::BIGINT AS n, round(w, 6) AS w_plus, round(z, 8) AS z, round({_TAIL}, 8) AS p FROM y""")
def signed_rank(spark, d):
    return stats.signed_rank(pair_scores(spark, d), exact=0).select("n", F.round("w_plus", 6).alias("w_plus"), F.round("z", 8).alias("z"), F.round("p", 8).alias("p"))


@register("i4_margin_correlation", f"{_SCORES} SELECT round(corr(margin, len(target_answer) - len(dispreferred_answer)), 9) AS correlation FROM m")
def margin_correlation(spark, d):
    return pair_scores(spark, d).agg(F.round(F.corr("margin", F.length("target_answer") - F.length("dispreferred_answer")), 9).alias("correlation"))


@register("a15_fingerprint", "SELECT sha256(count(*) || '-' || sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT)) AS fingerprint FROM (SELECT sha256(doc_id || chr(0) || quality || chr(0) || toxic) AS h FROM labels)")
def fingerprint(spark, d):
    rows = table(spark, d, "labels").select(F.sha2(F.concat_ws("\0", "doc_id", "quality", "toxic"), 256).alias("h"))
    # count and sum of row digests: the order of rows does not matter, and partial sums combine before the shuffle
    total = F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("-", F.count("*"), total), 256).alias("fingerprint"))


@register("a1_jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, d):
    from quarrymill.sources import jsonl

    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = new_path(spark, "jsonl")
    jsonl.write_jsonl(rows, path)
    return jsonl.read_jsonl(spark, [path], rows.schema)


@register("a3_malformed_lines", "SELECT count(*) AS records, count(*) FILTER (NOT json_valid(props)) AS malformed FROM events WHERE props IS NOT NULL AND trim(props) <> ''")
def malformed_lines(spark, d):
    from quarrymill.sources import jsonl

    return jsonl.count_malformed(table(spark, d, "events").select(F.col("props").alias("value")))


@register("a16_csv_matrix", f"WITH {_S} SELECT coalesce(negative_type, 'own') AS test, printf('%.4f', avg(score)) AS mean_score FROM scored GROUP BY 1")
def csv_matrix(spark, d):
    from quarrymill.sources import jsonl

    rows = X.scored(spark, d).groupBy(F.coalesce("negative_type", F.lit("own")).alias("test")).agg(F.format_string("%.4f", F.avg("score")).alias("mean_score"))
    path = new_path(spark, "csv")
    jsonl.write_csv(rows, path)
    return spark.read.option("header", True).schema("test string, mean_score string").csv(path)


@register("a6_shards", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def shards(spark, d):
    """Shards of one dataset in folders of their own, read as one by a pattern."""
    from quarrymill.sources import jsonl

    rows = table(spark, d, "documents").select("doc_id", "lang")
    path = new_path(spark, "shards")
    for lang in ("en", "fr"):
        jsonl.write_jsonl(rows.where(F.col("lang") == lang), f"{path}/shard-{lang}")
    return jsonl.read_jsonl(spark, [f"{path}/shard-*"], rows.schema)


@register("a17_report", f"WITH {_S} SELECT '| kind | rows |\n| --- | --- |\n' || string_agg('| ' || kind || ' | ' || n || ' |\n', '' ORDER BY kind) AS report FROM (SELECT coalesce(negative_type, 'own') AS kind, count(*) AS n FROM scored GROUP BY 1)".replace("\\n", "\n"))
def report(spark, d):
    """Counts by kind as a Markdown table in one row."""
    from quarrymill.sources import jsonl

    rows = X.scored(spark, d).groupBy(F.coalesce("negative_type", F.lit("own")).alias("kind")).agg(F.count("*").alias("rows")).orderBy("kind")
    return spark.createDataFrame([(jsonl.markdown(rows),)], "report string")


@register("c5_hash_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('42' || chr(0) || 'shuffle' || chr(0) || doc_id)) - 1 AS place FROM documents")
def hash_order(spark, d):
    """Places of a whole table in hash order: the shuffle that needs no generator, without one task that holds all."""
    rows = table(spark, d, "documents").select("doc_id").withColumn("key", T.rank_key("shuffle", "doc_id"))
    return positions(rows, [], [F.col("key"), F.col("doc_id")], "place").select("doc_id", "place")
