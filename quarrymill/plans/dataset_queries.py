"""Queries that split, pair, sample and check datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import pairing as R
from quarrymill.operators import splits as S
from quarrymill.operators.graph import connected_components
from quarrymill.plans import fixtures as X
from quarrymill.plans.registry import register
from quarrymill.runtime import stage, table

_RANK = "sha256('42' || chr(0) || '{0}' || chr(0) || {1})"
_COST = "greatest(0, {0} + size - total * {1}::DOUBLE) / greatest(total * {1}::DOUBLE, 1) * 10.0::DOUBLE + ({0} + size) / greatest(total * {1}::DOUBLE, 1)"
#: CTEs that deal ``sizes`` (stratum, document_id, size) to splits, one document after the other.
SPLIT_SQL = f"""
o AS (SELECT stratum, document_id, size, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, {_RANK.format('split', 'document_id')}) AS rn, sum(size) OVER (PARTITION BY stratum)::DOUBLE AS total FROM sizes),
w AS (SELECT DISTINCT stratum, 0::BIGINT AS rn, NULL::VARCHAR AS document_id, NULL::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM sizes
  UNION ALL
  SELECT stratum, rn, document_id, s, a + CASE WHEN s = 'train' THEN size ELSE 0 END, b + CASE WHEN s = 'validation' THEN size ELSE 0 END, c + CASE WHEN s = 'test' THEN size ELSE 0 END
  FROM (SELECT o.*, w.a, w.b, w.c, list_min([{{'x': {_COST.format('a', '0.7')}, 'n': a, 's': 'train'}}, {{'x': {_COST.format('b', '0.15')}, 'n': b, 's': 'validation'}}, {{'x': {_COST.format('c', '0.15')}, 'n': c, 's': 'test'}}]).s AS s
        FROM w JOIN o ON o.stratum = w.stratum AND o.rn = w.rn + 1)),
split AS (SELECT document_id, max_by(split, stratum) AS split FROM w WHERE rn > 0 GROUP BY document_id)"""
_STRATUM = "CASE WHEN label = 1 THEN '0_positive' ELSE coalesce(nullif(negative_type, ''), 'other') END"
_SIZES = f"sizes AS (SELECT {_STRATUM} AS stratum, document_id, count(*) AS size FROM (SELECT DISTINCT ON (example_id) * FROM passages) GROUP BY ALL)"
SPLIT_PASSAGES_SQL = f"WITH RECURSIVE {X.PASSAGES_SQL}, {_SIZES}, {SPLIT_SQL}, sp AS (SELECT * FROM (SELECT DISTINCT ON (example_id) * FROM passages) JOIN split USING (document_id))"


def split_passages(spark, d, texts=True):
    """Passages, with their texts or without, and the split of their document; staged, as they are used twice."""
    rows = X.passages(spark, d)
    rows = stage(rows if texts else rows.drop("text"), "passages")
    return S.with_splits(rows, S.group_splits(rows))


@register("e1_split_summary", f"{SPLIT_PASSAGES_SQL}, names AS (SELECT unnest(['train', 'validation', 'test']) AS split) SELECT split, count(example_id) AS passages, count(DISTINCT document_id) AS documents, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM names LEFT JOIN sp USING (split) GROUP BY split")
def split_summary(spark, d):
    return S.summary(split_passages(spark, d, texts=False))


@register("e2_violations", f"""{SPLIT_PASSAGES_SQL} SELECT 'duplicate_ids' AS "check", (SELECT count(example_id) - count(DISTINCT example_id) FROM sp) AS violations UNION ALL SELECT 'duplicate_texts', (SELECT count(text) - count(DISTINCT md5(text)) FROM sp)
UNION ALL SELECT 'invalid_split', (SELECT count(*) FILTER (split NOT IN ('train', 'validation', 'test') OR split IS NULL) FROM sp) UNION ALL SELECT 'leaking_documents', (SELECT count(*) FROM (SELECT document_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1))""")
def violations(spark, d):
    return S.violations(split_passages(spark, d))


@register("e5_split_by_source", f"{SPLIT_PASSAGES_SQL} SELECT source_group, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM sp GROUP BY 1")
def split_by_source(spark, d):
    return split_passages(spark, d, texts=False).groupBy("source_group").pivot("split", list(S.RATIOS)).count().na.fill(0)


@register("e6_kinds_by_split", f"{SPLIT_PASSAGES_SQL} SELECT split, negative_type, count(*) AS n FROM sp WHERE label = 0 GROUP BY ALL")
def kinds_by_split(spark, d):
    return split_passages(spark, d, texts=False).where("label = 0").groupBy("split", "negative_type").agg(F.count("*").alias("n"))


@register("j1_strata", f"WITH {X.PASSAGES_SQL} SELECT {_STRATUM} AS stratum, count(DISTINCT example_id) AS n FROM passages GROUP BY 1")
def strata(spark, d):
    return X.passages(spark, d).groupBy(S.stratum().alias("stratum")).agg(F.count("*").alias("n"))


@register("j2_group_splits", f"WITH RECURSIVE {X.PASSAGES_SQL}, {_SIZES}, {SPLIT_SQL} SELECT document_id, split FROM split")
def group_splits(spark, d):
    return S.group_splits(X.passages(spark, d))


_ONE = _SIZES.replace(_STRATUM, "'all'")


@register("j3_document_splits", f"WITH RECURSIVE {X.PASSAGES_SQL}, {_ONE}, {SPLIT_SQL} SELECT document_id, split FROM split")
def document_splits(spark, d):
    return S.group_splits(X.passages(spark, d), strata=F.lit("all"))


@register("j6_split_dataset", f"{SPLIT_PASSAGES_SQL} SELECT example_id, document_id, chunk_index, label, negative_type, split FROM sp")
def split_dataset(spark, d):
    rows = split_passages(spark, d, texts=False).select("example_id", "document_id", "chunk_index", "label", "negative_type", "split")
    return rows.orderBy("split", "document_id", F.coalesce("chunk_index", F.lit(0)))


@register("j18_inherited_split", f"{SPLIT_PASSAGES_SQL} SELECT d.doc_id, s.split FROM documents d JOIN (SELECT DISTINCT document_id, split FROM sp) s ON s.document_id = d.doc_id::VARCHAR")
def inherited_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"))
    return rows.join(S.group_splits(X.passages(spark, d)), "document_id").select("doc_id", "split")


_EX = """ex AS (SELECT candidate_id, doc_id AS document_id, 1 AS label, NULL::VARCHAR AS negative_type, target_answer AS text FROM pairs WHERE passed UNION ALL
  SELECT candidate_id, doc_id, 0, 'dispreferred', dispreferred_answer FROM pairs WHERE passed),
example AS (SELECT *, substr(sha256(candidate_id || chr(0) || label || chr(0) || text), 1, 20) AS example_id FROM ex)"""


def examples(spark, d):
    """Two rows a passed pair: the preferred answer (1) and the other (0)."""
    p = X.pairs(spark, d).where("passed")
    one = lambda label, kind, text: F.struct(F.lit(label).alias("label"), F.lit(kind).cast("string").alias("negative_type"), F.col(text).alias("text"))
    rows = p.select("candidate_id", F.col("doc_id").alias("document_id"), F.inline(F.array(one(1, None, "target_answer"), one(0, "dispreferred", "dispreferred_answer"))))
    return rows.withColumn("example_id", T.stable_id("candidate_id", "label", "text"))


@register("j7_preference_rows", f"WITH {X.PAIRS_SQL}, {_EX} SELECT candidate_id, document_id, label, negative_type, example_id FROM example")
def preference_rows(spark, d):
    return examples(spark, d).drop("text")


@register("d2_complete_pairs", f"WITH {X.PAIRS_SQL}, {_EX} SELECT a.candidate_id, a.example_id AS positive, b.example_id AS negative FROM example a JOIN example b ON a.candidate_id = b.candidate_id AND a.label = 1 AND b.label = 0")
def complete_pairs(spark, d):
    return R.complete_pairs(examples(spark, d).withColumn("ord", F.col("example_id")))


@register("d3_incomplete_pairs", f"WITH {X.PAIRS_SQL}, {_EX} SELECT count(*) AS incomplete FROM (SELECT candidate_id FROM example GROUP BY 1 HAVING count(DISTINCT label) < 2)")
def incomplete_pairs(spark, d):
    return examples(spark, d).groupBy("candidate_id").agg(F.count_distinct("label").alias("n")).agg(F.count_if(F.col("n") < 2).alias("incomplete"))


_PS = f"""psizes AS (SELECT {_STRATUM} AS stratum, document_id, count(*) AS size FROM example GROUP BY ALL)"""
_PSPLIT = f"WITH RECURSIVE {X.PAIRS_SQL}, {_EX}, {_PS.replace('psizes', 'sizes')}, {SPLIT_SQL}, px AS (SELECT * FROM example JOIN split USING (document_id))"


def split_examples(spark, d):
    rows = stage(examples(spark, d), "examples")
    return S.with_splits(rows, S.group_splits(rows))


@register("c4_quota_sample", f"""{_PSPLIT}, c AS (SELECT split, candidate_id, row_number() OVER (PARTITION BY split ORDER BY {_RANK.format('preference', 'candidate_id')}) AS n FROM px GROUP BY split, candidate_id HAVING count(DISTINCT label) = 2)
SELECT split, candidate_id FROM c WHERE n <= CASE split WHEN 'train' THEN 30 WHEN 'validation' THEN 8 ELSE 8 END""")
def quota_sample(spark, d):
    full = split_examples(spark, d).groupBy("split", "candidate_id").agg(F.count_distinct("label").alias("n")).where("n = 2").drop("n")
    return R.quota(full, ["split"], T.rank_key("preference", "candidate_id"), F.when(F.col("split") == "train", 30).otherwise(8))


@register("j8_preference_counts", f"{_PSPLIT} SELECT split, count(DISTINCT candidate_id) AS pairs, count(*) // 2 AS half_rows FROM px GROUP BY split")
def preference_counts(spark, d):
    return split_examples(spark, d).groupBy("split").agg(F.count_distinct("candidate_id").alias("pairs"), F.floor(F.count("*") / 2).alias("half_rows"))


@register("c6_synthetic_pairs", f"""WITH p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_RANK.format('synthetic', 'doc_id')}) AS rn FROM labels)
SELECT a.doc_id AS positive, b.doc_id AS negative FROM p a JOIN p b ON a.quality = 1 AND b.quality = 0 AND a.rn = b.rn""")
def synthetic_pairs(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality")
    key = T.rank_key("synthetic", "doc_id")
    pos = rows.where("quality = 1").select(F.lit(1).alias("g"), F.col("doc_id").alias("positive"), key.alias("x"))
    neg = rows.where("quality = 0").select(F.lit(1).alias("g"), F.col("doc_id").alias("negative"), key.alias("y"))
    return R.zipped(pos, neg, ["g"], F.col("x"), F.col("y")).select("positive", "negative")


@register("d5_easy_fallback", f"""{SPLIT_PASSAGES_SQL}, a AS (SELECT split, example_id, row_number() OVER (PARTITION BY split ORDER BY example_id) AS rn FROM sp WHERE negative_type = 'es'),
b AS (SELECT split, example_id, row_number() OVER (PARTITION BY split ORDER BY {_RANK.format('easy', 'example_id')}) AS rn FROM sp WHERE label = 1) SELECT split, a.example_id AS passage, b.example_id AS negative FROM a JOIN b USING (split, rn)""")
def easy_fallback(spark, d):
    rows = stage(split_passages(spark, d, texts=False), "split")
    left = rows.where("negative_type = 'es'").select("split", F.col("example_id").alias("passage"))
    right = rows.where("label = 1").select("split", F.col("example_id").alias("negative"))
    return R.zipped(left, right, ["split"], F.col("passage"), T.rank_key("easy", "negative"))


@register("d7_nearest_lengths", f"""WITH RECURSIVE {X.PASSAGES_SQL}, p AS (SELECT DISTINCT example_id, negative_type, word_count, {_RANK.format('length', 'example_id')} AS ord FROM passages),
t AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM p WHERE negative_type = 'es'), q AS (SELECT * FROM p WHERE negative_type = 'fr'),
m AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS target_id, NULL::VARCHAR AS pool_id, NULL::BIGINT AS gap, []::VARCHAR[] AS used
  UNION ALL SELECT x.rn, x.example_id, x.c.i, x.c.g, list_append(used, x.c.i) FROM (SELECT t.rn, t.example_id, m.used, (SELECT min({{'g': abs(q.word_count - t.word_count)::BIGINT, 'o': q.ord, 'i': q.example_id}}) FROM q WHERE NOT list_contains(m.used, q.example_id)) AS c FROM m JOIN t ON t.rn = m.rn + 1) x)
SELECT 'all' AS stratum, target_id, pool_id, gap FROM m WHERE rn > 0""")
def nearest_lengths(spark, d):
    rows = stage(X.passages(spark, d).select(F.lit("all").alias("stratum"), F.col("example_id").alias("id"), F.col("word_count").alias("words"), T.rank_key("length", "example_id").alias("ord"), "negative_type"), "lengths")
    return R.nearest_lengths(rows.where("negative_type = 'es'").drop("negative_type"), rows.where("negative_type = 'fr'").drop("negative_type"))


_RUNS = f"""runs AS (SELECT doc_id AS passage, doc_id // 7 AS page, run, round({X.HASH_SQL.format("(run || '-' || doc_id)")}, 2) AS score FROM documents, (SELECT unnest([1, 2, 3]) AS run)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY score DESC, run) AS n FROM runs) WHERE n = 1)"""


def _runs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("passage"), F.floor(F.col("doc_id") / 7).alias("page"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("run"))
    return docs.withColumn("score", F.round(T.hash_unit(F.concat_ws("-", "run", "passage")), 2))


@register("e12_best_of_runs", f"WITH {_RUNS} SELECT passage, page, run, score FROM best")
def best_of_runs(spark, d):
    return R.first_by(_runs(spark, d), ["passage"], F.desc("score"), "run")


@register("e13_best_of_pages", f"WITH {_RUNS} SELECT passage, page, run, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, passage) AS m FROM best) WHERE m = 1")
def best_of_pages(spark, d):
    return R.first_by(R.first_by(_runs(spark, d), ["passage"], F.desc("score"), "run"), ["page"], F.desc("score"), "passage")


@register("e14_first_of_document", f"WITH {X.PASSAGES_SQL} SELECT document_id, min_by(example_id, {_RANK.format('article', 'example_id')}) AS example_id FROM passages GROUP BY 1")
def first_of_document(spark, d):
    return X.passages(spark, d).groupBy("document_id").agg(F.min_by("example_id", T.rank_key("article", "example_id")).alias("example_id"))


@register("e4_pairs_by_source", f"{_PSPLIT} SELECT split, coalesce(negative_type, 'target') AS source, count(*) AS pairs FROM px GROUP BY ALL")
def pairs_by_source(spark, d):
    return split_examples(spark, d).groupBy("split", F.coalesce("negative_type", F.lit("target")).alias("source")).agg(F.count("*").alias("pairs"))


@register("e15_shared_documents", f"WITH {X.PAIRS_SQL} SELECT count(*) AS shared FROM (SELECT doc_id::VARCHAR AS x FROM documents INTERSECT SELECT doc_id FROM pairs)")
def shared_documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("x")).intersect(X.pairs(spark, d).select("doc_id")).agg(F.count("*").alias("shared"))


@register("e17_split_conflicts", f"""{_PSPLIT}, other AS (SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT document_id FROM (SELECT document_id, split FROM px UNION SELECT * FROM other WHERE document_id IN (SELECT document_id FROM px)) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_conflicts(spark, d):
    rows = split_examples(spark, d).select("document_id", "split").distinct()
    m = F.col("doc_id") % 10
    other = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.when(m < 7, "train").when(m < 9, "validation").otherwise("test").alias("split"))
    both = rows.union(other.join(rows.select("document_id"), "document_id", "left_semi"))
    return both.groupBy("document_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("document_id")


@register("d11_conflict_anti_join", f"""{_PSPLIT}, canon AS (SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS canonical FROM documents)
SELECT DISTINCT candidate_id, split FROM px LEFT JOIN canon USING (document_id) WHERE canonical IS NULL OR canonical = split""")
def conflict_anti_join(spark, d):
    m = F.col("doc_id") % 10
    canon = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.when(m < 7, "train").when(m < 9, "validation").otherwise("test").alias("canonical"))
    return split_examples(spark, d).join(canon, "document_id", "left").where("canonical is null or canonical = split").select("candidate_id", "split").distinct()


@register("d10_exclusions", f"WITH {X.PAIRS_SQL} SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id FROM pairs) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = documents.text)")
def exclusions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.md5("text").alias("digest"))
    used = X.pairs(spark, d).select(F.col("doc_id").alias("key")).distinct()
    texts = table(spark, d, "benchmark").select(F.md5("text").alias("digest")).distinct()
    return docs.join(used, "key", "left_anti").join(texts, "digest", "left_anti").select("doc_id")


@register("j5_components", """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey % 997 AS a, 10000 + l_partkey % 1009 AS b FROM lineitem WHERE l_quantity >= 50),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id""")
def components(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity >= 50").select((F.col("l_orderkey") % 997).alias("src"), (10000 + F.col("l_partkey") % 1009).alias("dst"))
    return connected_components(rows)


@register("j5_whole_components")
def whole_components(spark, d):
    """Components of orders and parts over all of lineitem. Orders are even nodes, parts odd ones, so no two ids meet.
    SQL has no twin for it: its recursion holds every pair of a component's nodes. ``j5_components`` is the slice that it can do."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * 2).alias("src"), (F.col("l_partkey").cast("long") * 2 + 1).alias("dst"))
    return connected_components(rows)


_COMP = """l AS (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey AS b FROM orders WHERE o_totalprice > 0),
comp AS (SELECT a::BIGINT AS component, count(*) AS size FROM l GROUP BY a)"""


@register("e19_component_weights", f"WITH {_COMP} SELECT component, size FROM comp")
def component_weights(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 0").select(F.col("o_custkey").alias("src"), (1000000 + F.col("o_orderkey")).alias("dst"))
    found = connected_components(orders)
    return found.where("id >= 1000000").groupBy("component").agg(F.count("*").alias("size"))


@register("j4_component_splits", f"WITH RECURSIVE {_COMP}, sizes AS (SELECT 'all' AS stratum, component::VARCHAR AS document_id, size FROM comp), {SPLIT_SQL} SELECT document_id, split FROM split")
def component_splits(spark, d):
    weights = component_weights(spark, d).select(F.lit("all").alias("stratum"), F.col("component").cast("string").alias("document_id"), "size")
    return S.balanced(weights).select("document_id", "split")


@register("j16_text_overlap", rf"""{SPLIT_PASSAGES_SQL}, n AS (SELECT DISTINCT split, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM sp)
SELECT a.split AS one, b.split AS other, count(*) AS shared FROM n a JOIN n b ON a.t = b.t AND a.split < b.split GROUP BY ALL""")
def text_overlap(spark, d):
    n = split_passages(spark, d).select("split", F.md5(T.normalise_key("text")).alias("t")).distinct()
    sets = n.groupBy("t").agg(F.sort_array(F.collect_set("split")).alias("s")).where("size(s) > 1")  # three splits at most
    pairs = sets.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, 3), y -> struct(x as one, y as other))))")).alias("p"))
    return pairs.groupBy("p.one", "p.other").agg(F.count("*").alias("shared"))


@register("j17_dataset_checks", f"""{SPLIT_PASSAGES_SQL}, c AS (SELECT (SELECT count(example_id) - count(DISTINCT example_id) FROM sp) AS ids, (SELECT count(*) FROM sp WHERE split = 'train') AS train, (SELECT count(*) FROM sp) AS n)
SELECT 'unique_ids' AS "check", CASE WHEN ids = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c UNION ALL SELECT 'train_share', CASE WHEN abs(train / n::DOUBLE - 0.7::DOUBLE) <= 0.02::DOUBLE THEN 'PASS' ELSE 'NOTE' END FROM c""")
def dataset_checks(spark, d):
    c = split_passages(spark, d, texts=False).agg((F.count("example_id") - F.count_distinct("example_id")).alias("ids"), F.avg((F.col("split") == "train").cast("double")).alias("share"))
    row = lambda name, ok, other: F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(other).alias("status"))
    return c.select(F.inline(F.array(row("unique_ids", F.col("ids") == 0, "FAIL"), row("train_share", F.abs(F.col("share") - 0.7) <= 0.02, "NOTE"))))


@register("k2_top_margins", f"WITH {X.scored_sql()} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 30")
def top_margins(spark, d):
    return X.scored(spark, d).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(30)


@register("k3_top_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "doc_id")


@register("k4_bag_union", "SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def bag_union(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").unionByName(table(spark, d, "labels").select("doc_id", "quality"), allowMissingColumns=True)


@register("k5_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@register("k6_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("k7_distinct_keep_first", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def distinct_keep_first(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))
