import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import matching
from quarrymill.operators import metrics as M
from quarrymill.operators import pairing as R
from quarrymill.operators import splits as S
from quarrymill.operators import stats
from quarrymill.operators.graph import connected_components
from quarrymill.operators.ordering import positions
from quarrymill.plans import registry
from quarrymill.sources import jsonl


def test_metrics_against_brute_force(spark):
    random.seed(1)
    rows = [(random.randint(0, 1), round(random.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.evaluated(df, 0.5).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["roc_auc"] - auc) < 1e-12
    assert got["tp"] == sum(s >= 0.5 for s in pos) and got["tn"] == sum(s < 0.5 for s in neg)

    def f1(t):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        return 2 * tp / (tp + fp + len(pos))

    best = M.select_threshold(df).first()
    top = max(f1(t) for _, t in rows)
    assert abs(best["f1"] - top) < 1e-9 and best["threshold"] == min(t for _, t in rows if abs(f1(t) - top) < 1e-9)


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.9)], "label int, score double")
    assert M.ranking_metrics(df).first()["roc_auc"] is None
    assert M.select_threshold(df.limit(0)).first()["threshold"] == 0.5


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 160)} == {100} and got[500] == 500
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_whole_components_against_union_find(spark, tmp_path):
    random.seed(2)
    edges = [(random.choice([7, 40_000, 5_000_000]) + random.randint(0, 60), random.randint(0, 90), float(random.randint(1, 50))) for _ in range(150)]
    spark.createDataFrame(edges, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for order, part, _ in edges:
        a, b = find(2 * order), find(2 * part + 1)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in registry.queries()["j5_whole_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root} and len(set(got.values())) > 1


def test_splits_balance_and_last_stratum_wins(spark):
    rows = [(f"d{i % 60}", int(i % 3 > 0), "k" if i % 3 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "document_id string, label int, negative_type string")
    got = dict(tuple(r) for r in S.group_splits(df).collect())
    assert len(got) == 60 and set(got.values()) == {"train", "validation", "test"}
    bad = df.withColumns({"split": F.lit("nowhere"), "example_id": F.lit("same"), "text": F.lit("same")})
    found = dict(tuple(r) for r in S.violations(bad).collect())
    assert found == {"duplicate_ids": 299, "duplicate_texts": 299, "invalid_split": 300, "leaking_documents": 0}


def test_nearest_lengths_and_duplicate_pairs(spark):
    t = spark.createDataFrame([("s", "t1", 10, "a"), ("s", "t2", 10, "b"), ("s", "t3", 99, "c"), ("s", "t4", 1, "d")], "stratum string, id string, words int, ord string")
    p = spark.createDataFrame([("s", "p1", 11, "b"), ("s", "p2", 9, "a"), ("s", "p3", 50, "c")], "stratum string, id string, words int, ord string")
    got = {r["target_id"]: (r["pool_id"], r["gap"]) for r in R.nearest_lengths(t, p).collect()}
    assert got == {"t1": ("p2", 1), "t2": ("p1", 1), "t3": ("p3", 49), "t4": (None, None)}
    rows = spark.createDataFrame([("c", 1, "x", 1), ("c", 1, "y", 2), ("c", 0, "z", 1), ("d", 1, "w", 1)], "candidate_id string, label int, example_id string, ord int")
    assert [tuple(r) for r in R.complete_pairs(rows).collect()] == [("c", "y", "z")]


def test_copies_are_no_matches(spark):
    words = lambda seed: " ".join(str(random.Random(seed * 1000 + i).random()) for i in range(30))
    passages = spark.createDataFrame([("a", words(1)), ("b", words(2)), ("c", words(3))], "id string, text string")
    pages = spark.createDataFrame([("own", words(1) + " more"), ("x", words(4)), ("x2", words(4) + " end"), ("y", words(5))], "id string, text string")
    rows = [("a", 1, "own", 0.9, 0.9), ("a", 1, "x", 0.8, 0.8), ("b", 2, "x2", 0.9, 0.9), ("b", 2, "y", 0.8, 0.8), ("c", 3, "x2", 0.9, 0.9), ("c", 3, "y", 0.9, 0.8)]
    candidates = spark.createDataFrame(rows, "passage_id string, ord int, page_id string, semantic double, score double")
    got = {r["passage_id"]: (r["page_id"], r["reason"]) for r in matching.greedy_matches(matching.candidate_copies(candidates, passages, pages), 0.4).collect()}
    assert got == {"a": ("x", "matched"), "b": ("y", "matched"), "c": (None, "no_candidates")}


def test_equal_windows_count_once(spark, tmp_path):
    sentence = " ".join(["Word"] + ["word"] * 49) + "."
    pages = [(1, "u", f"<title>T</title>{sentence} {sentence} {sentence} {sentence}"), (2, "u", "<title>T</title>Too short.")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["windows"] for r in registry.queries()["g16_distinct_candidates"](spark, str(tmp_path)).collect()}
    old = {r["page_id"]: r["windows"] for r in registry.queries()["g16_page_candidates"](spark, str(tmp_path)).collect()}
    # the title is text of the page too, so the first window differs from the others
    assert old["1"] == 3 and got == {"1": 2}


def test_bootstrap_against_numpy(spark):
    margins = [((i * 37) % 23 - 9) / 7 for i in range(12)]
    draw = lambda b, i: int(hashlib.md5(f"{b}-{i}".encode()).hexdigest()[:8], 16) % 12
    means = [np.mean([margins[draw(b, i)] for i in range(12)]) for b in range(10_000)]
    r = stats.bootstrap_interval(spark.createDataFrame(list(enumerate(margins)), "rn long, margin double")).first()
    assert np.allclose([r["low"], r["high"]], np.quantile(means, [0.025, 0.975]), atol=1e-9)


def test_sign_test(spark):
    df = spark.createDataFrame([(0.1,)] * 8 + [(-0.1,)] * 2 + [(0.0,)], "margin double")
    r = stats.sign_test(df).first()
    assert (r["wins"], r["losses"]) == (8, 2) and abs(r["p"] - 56 / 1024) < 1e-12


def test_decision_log_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "example_id string, n int")
    assert jsonl.append_decisions(rows, path, "example_id").count() == 0
    jsonl.append_decisions(rows, path, "example_id")
    assert jsonl.read_jsonl(spark, [path], rows.schema).count() == 2
    lines = spark.createDataFrame([('{"a": 1}',), ("{bad",), ("",), (None,)], "value string")
    assert tuple(jsonl.count_malformed(lines).first()) == (2, 1)
    assert jsonl.markdown(rows.orderBy("n")).splitlines()[2] == "| a | 1 |"


def test_incomplete_pairs_raise(spark):
    rows = spark.createDataFrame([("c", 1, "x", 1), ("c", 0, "z", 1), ("d", 1, "w", 1)], "candidate_id string, label int, example_id string, ord int")
    with pytest.raises(ValueError, match="among them d"):
        R.complete_pairs(rows, strict=True)
    assert R.complete_pairs(rows.where("candidate_id = 'c'"), strict=True).count() == 1


def test_signed_rank_exact_and_normal(spark):
    margins = [0.3, -0.1, 0.7, 0.2, 0.9, -0.4, 0.5]
    ranks = {m: r for r, m in enumerate(sorted(margins, key=abs), 1)}
    w = sum(ranks[m] for m in margins if m > 0)
    sums = [sum(k + 1 for k in range(7) if b >> k & 1) for b in range(128)]
    r = stats.signed_rank(spark.createDataFrame([(m,) for m in margins], "margin double")).first()
    assert r["w_plus"] == w and r["p"] == sum(s >= w for s in sums) / 128
    tied = stats.signed_rank(spark.createDataFrame([(m,) for m in [*margins, 0.7, 0.0]], "margin double")).first()
    assert tied["n"] == 8 and 0 < tied["p"] < 0.2


def test_positions_and_sums_within_groups(spark):
    random.seed(4)
    rows = [(random.choice(["a", "a", "a", "b", None]), random.randint(0, 10_000), random.randint(1, 9)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v int").withColumn("u", F.monotonically_increasing_id()).repartition(5)
    for group in ([], ["g"]):
        got = positions(df, group, [F.desc("k"), F.col("u")], sums={"before": "v"}).collect()
        assert len(got) == 900
        held: dict = {}
        for r in sorted(got, key=lambda r: (-r["k"], r["u"])):
            n, s = held.get(r["g"] if group else 0, (0, 0))
            assert (r["position"], r["before"]) == (n, s)
            held[r["g"] if group else 0] = n + 1, s + r["v"]


def test_chunks_are_made_once(spark, tmp_path):
    """No filter on the chunks may go below the shuffle, where it would make them all a first time."""
    from quarrymill.operators import passages

    docs = spark.createDataFrame([("a", "One two. " * 40), ("b", None), ("c", "short"), (None, "One two. " * 40)], "document_id string, text string")
    rows = passages.chunk_documents(docs.repartition(3), 50, 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [tuple(r) for r in rows.select("document_id", "chunk_index", "word_count").collect()] == [("a", 0, 80)]


def test_parts_grow_with_the_table(spark, tmp_path):
    from quarrymill.runtime import spread

    spark.range(100_000).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, 1000).rdd.getNumPartitions() > 100 and spread(df, 1000).count() == 100_000


def test_bootstrap_draws_meet_no_join(spark, monkeypatch):
    """Draws are made and added up in the task: as many rows as resamples leave it. Numbers of 1 to 5 digits."""
    rows = [b"%d-%d" % (b, i) for b in (0, 37, 9999) for i in (0, 9, 10, 12_345)]
    words = stats._row_words(12_346)
    heads = {b"%d-" % b: np.concatenate([stats._md5_heads(b"%d-" % b, w) for w in words]) for b in (0, 37, 9999)}
    for r in rows:
        prefix, i = r.split(b"-")
        assert heads[prefix + b"-"][int(i)] == int(hashlib.md5(r).hexdigest()[:8], 16)
    df = spark.createDataFrame([(k, ((k * 37) % 23 - 9) / 7) for k in range(1234)], "rn long, margin double")
    found = stats.bootstrap_interval(df, 50)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    one = found.first()
    monkeypatch.setattr(stats, "HELD", 0)
    assert np.allclose(one, stats.bootstrap_interval(df, 50).first(), atol=1e-12)
    assert stats.bootstrap_interval(df.limit(0), 50).first()["low"] is None


def test_zipped_and_quotas_meet_in_no_single_task(spark):
    """Places are counted by ranges, and a quota limits what each task sends on."""
    from quarrymill.operators import composed

    left = spark.createDataFrame([("ab"[k % 3 == 0], k) for k in range(600)], "split string, x int")
    right = spark.createDataFrame([("ab"[k % 2], k) for k in range(500)] + [(None, 1)], "split string, y int")
    found = R.zipped(left, right, ["split"], F.desc("x"), F.col("y"))
    assert "row_number() windowspecdefinition(split" not in found._jdf.queryExecution().optimizedPlan().toString()
    a = {s: sorted((x for t, x in left.collect() if t == s), reverse=True) for s in "ab"}
    b = {s: sorted(y for t, y in right.collect() if t == s) for s in "ab"}
    assert sorted(found.collect()) == sorted((s, x, y) for s in "ab" for x, y in zip(a[s], b[s]))
    pairs = spark.createDataFrame([("train" if k % 4 else "test", f"p{k}") for k in range(400)], "split string, pair_id string")
    plans = []
    stage = composed.stage
    try:
        composed.stage = lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stage(df, label))[1]
        rows, short = composed.within_quota(pairs, "x", "n", {"train": {"x": 5}, "test": {"x": 7}, "validation": {"x": 1}})
    finally:
        composed.stage = stage
    assert "WindowGroupLimit" in plans[0]
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 5, "test": 7}
    assert [tuple(r) for r in short.collect()] == [("validation", "x", 1, 0)]


def test_edges_of_a_hub_do_not_meet(spark, monkeypatch):
    """A hub's minimum goes to its edges, whichever end it is; components are those of union-find."""
    from quarrymill.operators import graph

    random.seed(3)
    for hub in (0, 10_000):
        edges = [(hub, k) for k in range(1, 400)] + [(random.randint(500, 900), random.randint(500, 900)) for _ in range(150)] + [(7, 7), (None, 3)]
        parent: dict = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for a, b in edges:
            if a is not None:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        expected = {x: find(x) for x in parent}
        df = spark.createDataFrame(edges, "src long, dst long")
        for most in (graph.HUB, 20):
            monkeypatch.setattr(graph, "HUB", most)
            assert {r["id"]: r["component"] for r in graph.connected_components(df).collect()} == expected
    lows = graph._lows(df, "src", "dst")
    # what a join on the key shuffles: in one partition of many, none has the hub's rows
    spread = graph._with_lows(df, lows, "src")
    assert "leftanti" in spread._jdf.queryExecution().optimizedPlan().toString().lower() and spread.count() == len(edges) - 1
