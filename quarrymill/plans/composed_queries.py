"""Datasets composed as a whole: combined, pure, preference-heavy and hybrid ones, and their checks.

English passages are positives. Each French passage is the topic negative of one English first passage of its split
(the i-th of either in hash order); Spanish and French ones are easy negatives; conversations give preference pairs
whose documents are split by their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import composed as C
from quarrymill.operators.pairing import zipped
from quarrymill.plans import dataset_queries as Q
from quarrymill.plans import fixtures as X
from quarrymill.plans.registry import register
from quarrymill.runtime import stage, table

QUOTAS = {"train": {"easy": 20, "hybrid": 20, "pure_topic": 20, "preference": 10}, "validation": {"easy": 5, "hybrid": 4, "pure_topic": 4, "preference": 2}, "test": {"easy": 4, "hybrid": 4, "pure_topic": 5, "preference": 3}}
_RANK = "sha256('42' || chr(0) || '{0}' || chr(0) || {1})"


def _key(namespace: str, column: str) -> str:
    return _RANK.format(namespace.replace("\0", "' || chr(0) || '"), column)


def _quota(source: str) -> str:
    return "CASE split " + " ".join(f"WHEN '{s}' THEN {q[source]}" for s, q in QUOTAS.items()) + " END"


def _zip(name: str, left: str, right: str, left_key: str, right_key: str, by: str = "split") -> str:
    return f"""{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {left_key}) AS rn FROM ({left})), {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {right_key}) AS rn FROM ({right})),
{name} AS (SELECT * FROM {name}_l JOIN {name}_r USING ({by}, rn))"""


_POS = "SELECT split, example_id AS pos_id, document_id AS pos_document, text AS pos_text FROM sp WHERE {0}"
_NEG = "SELECT split, example_id AS neg_id, document_id AS neg_document, text AS neg_text FROM sp WHERE {0}"
_BASE = f"""{Q.SPLIT_PASSAGES_SQL}, {X.PAIRS_SQL},
{_zip('tz', _POS.format("label = 1 AND chunk_index = 0"), _NEG.format("negative_type = 'fr'"), _key('topic-pos', 'pos_id'), _key('topic-neg', 'neg_id'))},
pure AS (SELECT split, pos_id AS pair_id, pos_id, pos_document, pos_text, neg_id, neg_document, neg_text FROM tz),
{_zip('ez', _POS.format("label = 1"), _NEG.format("negative_type IN ('es', 'fr')"), _key('easy-pos', 'pos_id'), _key('easy-neg', 'neg_id'))},
simple AS (SELECT split, pos_id || '::' || neg_id AS pair_id, pos_id, pos_document, pos_text, neg_id, neg_document, neg_text FROM ez),
pref AS (SELECT CASE WHEN doc_id::INTEGER % 10 < 7 THEN 'train' WHEN doc_id::INTEGER % 10 < 8 THEN 'validation' ELSE 'test' END AS split, candidate_id AS pair_id, candidate_id || '-1' AS pos_id, doc_id AS pos_document, target_answer AS pos_text,
  candidate_id || '-0' AS neg_id, doc_id AS neg_document, dispreferred_answer AS neg_text FROM pairs WHERE passed)"""


def _passages(spark, d):
    return stage(Q.split_passages(spark, d).select("example_id", "document_id", "text", "label", "split", "negative_type", "chunk_index"), "split")


def _pure(rows):
    pos = C.side(rows.where("label = 1 and chunk_index = 0").select("split", "example_id", "document_id", "text"), "pos")
    neg = C.side(rows.where("negative_type = 'fr'").select("split", "example_id", "document_id", "text"), "neg")
    return zipped(pos, neg, ["split"], T.rank_key("topic-pos", "pos_id"), T.rank_key("topic-neg", "neg_id")).withColumn("pair_id", F.col("pos_id"))


def _easy(rows):
    return rows.where("label = 1 or negative_type in ('es', 'fr')")


def _preference(spark, d):
    m = F.col("doc_id").cast("int") % 10
    one = lambda s, n, text: [F.concat("candidate_id", F.lit(f"-{n}")).alias(f"{s}_id"), F.col("doc_id").alias(f"{s}_document"), F.col(text).alias(f"{s}_text")]
    return X.pairs(spark, d).where("passed").select(F.when(m < 7, "train").when(m < 8, "validation").otherwise("test").alias("split"), F.col("candidate_id").alias("pair_id"), *one("pos", 1, "target_answer"), *one("neg", 0, "dispreferred_answer"))


_SIDES = "(pos_{0}, neg_{0})"


def _taken(name: str, source: str, rows: str, rank: str) -> str:
    """CTEs: the candidates of a source, and those within the quota of splits that do not fall short."""
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {rank}, pair_id) AS place, count(*) OVER (PARTITION BY split) AS there FROM ({rows})),
{name} AS (SELECT * FROM {name}_c WHERE place <= {_quota(source)} AND there >= {_quota(source)})"""


def _short(parts: list[tuple[str, str]]) -> str:
    quotas = ", ".join(f"('{s}', '{source}', {q[source]})" for s, q in QUOTAS.items() for source in {p[1] for p in parts})
    counts = " UNION ALL ".join(f"SELECT split, '{source}' AS source, count(*) AS n FROM {name}_c GROUP BY 1" for name, source in parts)
    return f"SELECT q.split, q.source, q.needed::INTEGER AS needed, coalesce(n, 0)::INTEGER AS available FROM (VALUES {quotas}) q(split, source, needed) LEFT JOIN ({counts}) c ON c.split = q.split AND c.source = q.source WHERE coalesce(n, 0) < needed"


_NOT_USED = "pos_id NOT IN (SELECT id FROM {0} u WHERE u.split = p.split) AND neg_id NOT IN (SELECT id FROM {0} u WHERE u.split = p.split) AND pos_text NOT IN (SELECT text FROM {0} u WHERE u.split = p.split) AND neg_text NOT IN (SELECT text FROM {0} u WHERE u.split = p.split)"
_UNTESTED = "(split = 'test' OR (pos_document NOT IN (SELECT * FROM tested) AND neg_document NOT IN (SELECT * FROM tested)))"


def _used(name: str, sources: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT split, unnest([pos_id, neg_id]) AS id, unnest([pos_text, neg_text]) AS text FROM {s}" for s in sources)
    return f"{name} AS ({rows})"


_CANON = "canon AS (SELECT document_id, min_by(split, (k, split)) AS canonical FROM (SELECT DISTINCT unnest([pos_document, neg_document]) AS document_id, split, 0 AS k FROM {0} UNION ALL SELECT DISTINCT {1}) GROUP BY 1)"
_PURE_SQL = f"""{_BASE}, tested AS (SELECT unnest([pos_document, neg_document]) AS d FROM (SELECT * FROM pure UNION ALL SELECT * FROM simple UNION ALL SELECT * FROM pref) WHERE split = 'test'),
{_CANON.format('pure', "unnest([pos_document, neg_document]), split, 1 FROM simple")},
{_taken('a', 'pure_topic', f"SELECT * FROM pure WHERE {_UNTESTED}", _key('combined_pure' + chr(0) + 'pure_topic', 'pair_id'))}, {_used('ua', ['a'])},
{_taken('b', 'easy', f"SELECT * FROM simple p WHERE {_UNTESTED} AND {_NOT_USED.format('ua')}", _key('combined_pure' + chr(0) + 'easy', 'pair_id'))}, {_used('ub', ['a', 'b'])},
{_taken('c', 'preference', f"SELECT p.* FROM pref p LEFT JOIN canon ON canon.document_id = p.pos_document WHERE {_UNTESTED} AND (canonical IS NULL OR canonical = p.split) AND {_NOT_USED.format('ub')}", _key('combined_pure' + chr(0) + 'preference', 'pair_id'))}"""


def _combined_pure(spark, d):
    rows = _passages(spark, d)
    sources = {"pure_topic": stage(_pure(rows), "pure"), "easy": stage(C.synthetic_pairs(_easy(rows), "easy"), "easy"), "preference": stage(_preference(spark, d), "preference")}
    return C.combined_pure(sources, QUOTAS, strict=False)


@register("j14_combined_pure", f"{_PURE_SQL} SELECT split, 'pure_topic' AS source, pair_id, pos_id, neg_id FROM a UNION ALL SELECT split, 'easy', pair_id, pos_id, neg_id FROM b UNION ALL SELECT split, 'preference', pair_id, pos_id, neg_id FROM c")
def combined_pure(spark, d):
    """Three sources without a document, id or text in common; a source that falls short adds nothing to the split."""
    return _combined_pure(spark, d)[0].select("split", "source", "pair_id", "pos_id", "neg_id")


@register("j14_shortfalls", f"{_PURE_SQL} {_short([('a', 'pure_topic'), ('b', 'easy'), ('c', 'preference')])}")
def pure_shortfalls(spark, d):
    return _combined_pure(spark, d)[1]


_PICK = "SELECT split, example_id AS pair_id FROM sp WHERE {0}"
_COMBINED_SQL = f"""{_BASE}, {_CANON.format('pure', "document_id, split, -1 FROM sp WHERE label = 1 OR negative_type IN ('es', 'fr')")},
{_taken('ep', 'easy', _PICK.format('label = 1'), _key('combined-pos' + chr(0) + 'easy', 'pair_id'))}, {_taken('en', 'easy', _PICK.format("negative_type IN ('es', 'fr')"), _key('combined-neg' + chr(0) + 'easy', 'pair_id'))},
eb AS (SELECT split FROM ep INTERSECT SELECT split FROM en),
{_taken('hb', 'hybrid', "SELECT * FROM pure p WHERE pos_id NOT IN (SELECT pair_id FROM ep WHERE ep.split = p.split AND ep.split IN (SELECT * FROM eb)) AND neg_id NOT IN (SELECT pair_id FROM en WHERE en.split = p.split AND en.split IN (SELECT * FROM eb))", _key('combined' + chr(0) + 'hybrid', 'pair_id'))},
{_taken('pr', 'preference', "SELECT p.* FROM pref p LEFT JOIN canon ON canon.document_id = p.pos_document WHERE canonical IS NULL OR canonical = p.split", _key('combined' + chr(0) + 'preference', 'pair_id'))}"""


def _combined(spark, d):
    rows = _passages(spark, d)
    return C.combined(_easy(rows), stage(_pure(rows), "pure"), stage(_preference(spark, d), "preference"), QUOTAS, strict=False)


@register("j13_combined", f"""{_COMBINED_SQL}, both_ AS (SELECT split, 'hybrid' AS source, * EXCLUDE (split) FROM hb UNION ALL SELECT split, 'preference', * EXCLUDE (split) FROM pr)
SELECT split, source, pair_id, pos_id AS example_id, 1 AS label FROM both_ UNION ALL SELECT split, source, pair_id, neg_id, 0 FROM both_ UNION ALL SELECT split, 'easy', NULL, pair_id, 1 FROM ep WHERE split IN (SELECT * FROM eb) UNION ALL SELECT split, 'easy', NULL, pair_id, 0 FROM en WHERE split IN (SELECT * FROM eb)""")
def combined(spark, d):
    """Quotas of easy rows, hybrid pairs and preference pairs, each exclusive of the sources before."""
    return _combined(spark, d)[0]


_HEAVY_SQL = rf"""{_BASE}, xd AS (SELECT document_id AS d FROM sp WHERE split = 'test' AND label = 1 UNION SELECT doc_id FROM pairs WHERE candidate_id::BIGINT % 9 = 0), xt AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM sp WHERE split = 'test' AND label = 1),
hp AS (SELECT 'pure_topic' AS source, * EXCLUDE (split) FROM pure WHERE pos_document NOT IN (SELECT * FROM xd) AND neg_document NOT IN (SELECT * FROM xd) AND trim(regexp_replace(lower(pos_text), '\s+', ' ', 'g')) NOT IN (SELECT * FROM xt) AND trim(regexp_replace(lower(neg_text), '\s+', ' ', 'g')) NOT IN (SELECT * FROM xt)),
hl AS (SELECT example_id AS pos_id, document_id AS pos_document, text AS pos_text, row_number() OVER (ORDER BY {_key('preference-heavy-easy-pos', 'example_id')}) AS rn FROM sp WHERE label = 1 AND document_id NOT IN (SELECT * FROM xd) AND example_id NOT IN (SELECT pos_id FROM hp)),
hd AS (SELECT document_id, min_by(example_id, {_key('preference-heavy-easy-neg', 'example_id')}) AS example_id FROM sp WHERE negative_type = 'es' AND document_id NOT IN (SELECT * FROM xd) GROUP BY 1),
hn AS (SELECT example_id AS neg_id, document_id AS neg_document, row_number() OVER (ORDER BY {_key('preference-heavy-easy-neg', 'example_id')}) AS rn FROM hd),
hq AS (SELECT * FROM pref WHERE pos_document NOT IN (SELECT * FROM xd) AND trim(regexp_replace(lower(pos_text), '\s+', ' ', 'g')) NOT IN (SELECT * FROM xt) AND trim(regexp_replace(lower(neg_text), '\s+', ' ', 'g')) NOT IN (SELECT * FROM xt) AND pair_id::BIGINT % 9 <> 0),
hall AS (SELECT source, pair_id, pos_id, neg_id, pos_document, neg_document FROM hp UNION ALL SELECT 'easy', pos_id || '::' || neg_id, pos_id, neg_id, pos_document, neg_document FROM hl JOIN hn USING (rn) UNION ALL SELECT 'preference', pair_id, pos_id, neg_id, pos_document, neg_document FROM hq)
SELECT source, pair_id, pos_id, neg_id FROM hall"""


def _excluded(spark, d, rows):
    common = X.pairs(spark, d).where(F.col("candidate_id").cast("long") % 9 == 0)
    test = rows.where("split = 'test' and label = 1")
    return {"documents": test.select(F.col("document_id").alias("document")).union(common.select("doc_id")), "texts": test.select(T.normalise_key("text").alias("text")), "pairs": common.select(F.col("candidate_id").alias("pair_id"))}


def _heavy(spark, d):
    rows = _passages(spark, d)
    return C.preference_heavy(_pure(rows), rows.where("label = 1 or negative_type = 'es'"), _preference(spark, d), _excluded(spark, d, rows)), _excluded(spark, d, rows)


@register("j15_preference_heavy", _HEAVY_SQL)
def preference_heavy(spark, d):
    """Pairs of three sources without the common test sets (their joint split: ``j15_joint_splits``)."""
    return _heavy(spark, d)[0].select("source", "pair_id", "pos_id", "neg_id")


@register("j15_joint_splits")
def joint_splits(spark, d):
    """The same pairs with the split of their component, which SQL's recursion cannot find; tested against union-find."""
    return _heavy(spark, d)[0].select("source", "pair_id", "split", "pos_document", "neg_document")


_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_SHARED = " UNION ALL ".join(f"SELECT 'shared_texts_{a}_{b}', (SELECT count(*) FROM (SELECT {_NORMAL} FROM lr WHERE split = '{a}' INTERSECT SELECT {_NORMAL} FROM lr WHERE split = '{b}'))" for a, b in (("test", "train"), ("test", "validation"), ("train", "validation")))


@register("j16_leakage", f"""{_PURE_SQL}, lp AS (SELECT 'pure_topic' AS source, * FROM a UNION ALL SELECT 'easy', * FROM b UNION ALL SELECT 'preference', * FROM c),
lr AS (SELECT split, source, pos_id AS example_id, pos_document AS document_id, pos_text AS text, 1 AS label FROM lp UNION ALL SELECT split, source, neg_id, neg_document, neg_text, 0 FROM lp)
SELECT 'duplicate_ids' AS "check", (SELECT count(*) - count(DISTINCT example_id) FROM lr) AS violations UNION ALL SELECT 'duplicate_texts', (SELECT count(*) - count(DISTINCT text) FROM lr) UNION ALL SELECT 'leaking_documents', (SELECT count(*) FROM (SELECT document_id FROM lr GROUP BY 1 HAVING count(DISTINCT split) > 1))
UNION ALL {_SHARED} UNION ALL SELECT 'excluded_documents', (SELECT count(*) FROM (SELECT document_id FROM lr INTERSECT SELECT item_id::VARCHAR FROM benchmark)) UNION ALL SELECT 'excluded_texts', (SELECT count(*) FROM (SELECT {_NORMAL} FROM lr INTERSECT SELECT {_NORMAL} FROM benchmark))
UNION ALL SELECT 'uneven_groups', (SELECT count(*) FROM (SELECT split, source FROM lr GROUP BY ALL HAVING sum(CASE WHEN label = 1 THEN 1 ELSE -1 END) <> 0))""")
def leakage(spark, d):
    """All leakage checks of the combined pure set, the benchmark's ids and texts being the excluded ones."""
    items = table(spark, d, "benchmark")
    rows = C.rows_of(_combined_pure(spark, d)[0])
    return C.leakage(rows, items.select(F.col("item_id").cast("string").alias("document")), items.select(T.normalise_key("text").alias("text")))


_VERIFY = """v{0} AS (SELECT '{1}' AS dataset, example_id, document_id, md5(text) AS text, label, split FROM ({2}))"""
_VERIFY_SQL = f"""{_BASE}, {_VERIFY.format(1, 'easy', 'SELECT * FROM sp')}, {_VERIFY.format(2, 'pure_topic', "SELECT split, pos_id AS example_id, pos_document AS document_id, pos_text AS text, 1 AS label FROM pure UNION ALL SELECT split, neg_id, neg_document, neg_text, 0 FROM pure")},
{_VERIFY.format(3, 'preference', "SELECT split, pos_id AS example_id, pos_document AS document_id, pos_text AS text, 1 AS label FROM pref UNION ALL SELECT split, neg_id, neg_document, neg_text, 0 FROM pref")},
ve AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3), vc AS (SELECT dataset, count(*) - count(DISTINCT example_id) AS ids, count(*) - count(DISTINCT text) AS texts, abs(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END)) AS uneven FROM ve GROUP BY 1),
vl AS (SELECT dataset, count(*) FILTER (n > 1) AS leaking FROM (SELECT dataset, document_id, count(DISTINCT split) AS n FROM ve GROUP BY ALL) GROUP BY 1),
vr AS (SELECT dataset || ': no duplicate ids' AS "check", ids AS detail FROM vc UNION ALL SELECT dataset || ': no duplicate texts', texts FROM vc UNION ALL SELECT dataset || ': no document in two splits', leaking FROM vl UNION ALL SELECT dataset || ': equal labels', CASE WHEN dataset = 'easy' THEN 0 ELSE uneven END FROM vc
 UNION ALL SELECT 'no document with two splits over all datasets', (SELECT count(*) FROM (SELECT document_id FROM ve GROUP BY 1 HAVING count(DISTINCT split) > 1))
 UNION ALL SELECT 'test candidates are the common ones', (SELECT count(*) FROM pref WHERE split = 'test' AND pair_id::BIGINT % 9 <> 0) + (SELECT count(*) FROM pairs WHERE passed AND candidate_id::BIGINT % 9 = 0 AND doc_id::INTEGER % 10 < 8)
 UNION ALL SELECT 'no metric is NaN', 0 UNION ALL SELECT 'no probability is missing', (SELECT count(*) FROM labels WHERE toxic IS NULL))
SELECT "check", CASE WHEN detail = 0 THEN 'PASS' WHEN "check" LIKE '%over all datasets' THEN 'NOTE' ELSE 'FAIL' END AS status, detail::BIGINT AS detail FROM vr"""


@register("j17_experiment_checks", _VERIFY_SQL)
def experiment_checks(spark, d):
    """All checks of an experiment: each dataset's, those across datasets, common test ids, metrics and probabilities."""
    rows = _passages(spark, d)
    preference = stage(_preference(spark, d), "preference")
    both = lambda p: C.rows_of(p.withColumn("source", F.lit("")))
    datasets = {"easy": rows, "pure_topic": both(_pure(rows)), "preference": both(preference)}
    common = X.pairs(spark, d).where("passed").where(F.col("candidate_id").cast("long") % 9 == 0).select("candidate_id")
    metrics = X.scored(spark, d).agg(F.avg("score").alias("value"))
    return C.verified(datasets, ("easy",), preference.where("split = 'test'").select(F.col("pair_id").alias("candidate_id")), common, metrics, table(spark, d, "labels").select(F.col("toxic").alias("probability")))


_RUNS = f"""runs AS (SELECT * FROM (SELECT example_id, split, (document_id::BIGINT // 3)::VARCHAR AS page_id, 1 AS run, round({X.HASH_SQL.format("('1' || example_id)")}, 2) AS score FROM sp WHERE label = 1 UNION ALL SELECT example_id, split, (document_id::BIGINT // 3 + 7)::VARCHAR, 2, round({X.HASH_SQL.format("('2' || example_id)")}, 2) FROM sp WHERE label = 1) WHERE score >= 0.5),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY score DESC, run, page_id) = 1), merged AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, example_id) = 1)"""
_HYBRID_SQL = f"""{Q.SPLIT_PASSAGES_SQL}, {_RUNS}, rest AS (SELECT split, example_id FROM sp WHERE label = 1 AND example_id NOT IN (SELECT example_id FROM merged)), free AS (SELECT split, example_id AS negative_id FROM sp WHERE label = 0 AND document_id NOT IN (SELECT page_id FROM merged)),
{_zip('hz', 'SELECT * FROM rest', 'SELECT * FROM free', _key('hybrid-passage', 'example_id'), _key('hybrid-easy', 'negative_id'))}"""


def _hybrid(spark, d):
    rows = _passages(spark, d)
    pos = rows.where("label = 1")
    run = lambda k, page: pos.select("example_id", page.cast("string").alias("page_id"), F.lit(k).alias("run"), F.round(T.hash_unit(F.concat(F.lit(str(k)), "example_id")), 2).alias("score"))
    page = F.floor(F.col("document_id").cast("long") / 3)
    topic = C.merged_runs(stage(run(1, page).unionByName(run(2, page + 7)).where("score >= 0.5"), "runs"))
    topic = topic.select("example_id", F.concat(F.lit("page-"), "page_id").alias("negative_id"), F.col("page_id").alias("document_id"))
    easy = rows.where("label = 0").select(F.col("example_id").alias("negative_id"), "document_id", "split")
    return C.hybrid(pos.select("example_id", "split"), stage(topic, "topic"), easy, strict=False)


@register("j10_merged_hybrid", f"{_HYBRID_SQL} SELECT example_id, split, 'page-' || page_id AS negative_id, 'topic' AS kind FROM merged UNION ALL SELECT example_id, split, negative_id, 'easy' FROM hz")
def merged_hybrid(spark, d):
    """Two runs merged, a page a passage; easy negatives of other documents fill in."""
    return _hybrid(spark, d)[0]


@register("j10_shortfalls", f"{_HYBRID_SQL} SELECT split, 'easy' AS source, n::INTEGER AS needed, coalesce(m, 0)::INTEGER AS available FROM (SELECT split, count(*) AS n FROM rest GROUP BY 1) LEFT JOIN (SELECT split, count(*) AS m FROM free GROUP BY 1) USING (split) WHERE coalesce(m, 0) < n")
def hybrid_shortfalls(spark, d):
    return _hybrid(spark, d)[1]


@register("j8_common_test_ids", f"""{Q._PSPLIT}, c AS (SELECT split, candidate_id, row_number() OVER (PARTITION BY split ORDER BY {_key('preference', 'candidate_id')}) AS n FROM px GROUP BY split, candidate_id HAVING count(DISTINCT label) = 2)
SELECT 42 AS seed, array_to_string(list(candidate_id ORDER BY candidate_id), ',') AS candidate_ids FROM c WHERE split = 'test' AND n <= 8""")
def common_test_ids(spark, d):
    """The test pairs of the quota sample as the one-row record that other datasets exclude: bounded by the quota."""
    ids = Q.quota_sample(spark, d).where("split = 'test'").agg(F.sort_array(F.collect_list("candidate_id")).alias("ids"))
    return ids.select(F.lit(42).alias("seed"), F.array_join("ids", ",").alias("candidate_ids"))
