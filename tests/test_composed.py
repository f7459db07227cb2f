import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import composed as C

PAIR = "pair_id string, split string, pos_id string, pos_document string, pos_text string, neg_id string, neg_document string, neg_text string"


def pair(k, split, pos=None, neg=None, doc=None, other=None):
    return (str(k), split, pos or f"p{k}", doc or f"d{k}", f"text {pos or k}", neg or f"n{k}", other or f"e{k}", f"other {neg or k}")


def test_sources_are_exclusive_and_shortfalls_raise(spark):
    pure = spark.createDataFrame([pair(1, "train"), pair(2, "test"), pair(3, "train", doc="d2")], PAIR)
    easy = spark.createDataFrame([pair(11, "train", pos="p1"), pair(12, "train"), pair(13, "test")], PAIR)
    preference = spark.createDataFrame([pair(21, "train", doc="x", other="x"), pair(22, "train", doc="d13", other="d13"), pair(23, "validation", doc="d12", other="d12")], PAIR)
    sources = {"pure_topic": pure, "easy": easy, "preference": preference}
    quotas = {"train": {"pure_topic": 1, "easy": 1, "preference": 1}, "validation": {"pure_topic": 0, "easy": 0, "preference": 0}, "test": {"pure_topic": 1, "easy": 1, "preference": 0}}
    rows, short = C.combined_pure(sources, quotas)
    # 3 is a test document's, 11 repeats the positive of 1, 22 is a test document's, 23 disagrees with the split of d12
    assert {(r["source"], r["pair_id"]) for r in rows.collect()} == {("pure_topic", "1"), ("pure_topic", "2"), ("easy", "12"), ("easy", "13"), ("preference", "21")}
    assert short.count() == 0
    more = {**quotas, "validation": {"pure_topic": 0, "easy": 0, "preference": 1}}
    with pytest.raises(C.Shortfall, match="validation/preference: 1 needed, 0 available"):
        C.combined_pure(sources, more)
    rows, short = C.combined_pure(sources, more, strict=False)
    assert rows.count() == 5 and [tuple(r) for r in short.collect()] == [("validation", "preference", 1, 0)]


def test_text_of_an_earlier_source_is_left_out(spark):
    pure = spark.createDataFrame([pair(1, "train")], PAIR)
    easy = spark.createDataFrame([("2", "train", "p2", "d2", "text 1", "n2", "e2", "y"), ("3", "train", "p3", "d3", "z", "n3", "e3", "w")], PAIR)
    quotas = {"train": {"pure_topic": 1, "easy": 1}, "validation": {"pure_topic": 0, "easy": 0}, "test": {"pure_topic": 0, "easy": 0}}
    rows, _ = C.combined_pure({"pure_topic": pure, "easy": easy}, quotas)
    assert {r["pair_id"] for r in rows.collect()} == {"1", "3"}


def test_linked_documents_share_a_split(spark):
    rng = random.Random(3)
    docs = [f"d{k}" for k in range(60)]
    pure = [(f"u{k}", "", f"pu{k}", rng.choice(docs), f"a{k}", f"nu{k}", f"w{rng.randint(0, 30)}", f"b{k}") for k in range(40)]
    rows = [(f"pu{k}", "d1", f"c{k}", 1) for k in range(3)] + [(f"x{k}", rng.choice(docs), f"c{k}", 1) for k in range(30)] + [(f"y{k}", f"w{rng.randint(0, 50)}", f"e{k}", 0) for k in range(80)]
    preference = [(f"c{k}", "", f"cp{k}", f"d{rng.randint(50, 90)}", f"g{k}", f"cn{k}", "", f"h{k}") for k in range(30)]
    preference = [(*r[:6], r[3], r[7]) for r in preference]
    excluded = {"documents": spark.createDataFrame([("d5",), ("w7",)], "document string"), "texts": spark.createDataFrame([("a3",), ("h4",)], "text string"), "pairs": spark.createDataFrame([("c9",)], "pair_id string")}
    found = C.preference_heavy(spark.createDataFrame(pure, PAIR), spark.createDataFrame(rows, "example_id string, document_id string, text string, label int"), spark.createDataFrame(preference, PAIR), excluded)
    got = found.collect()
    kept = [r for r in pure if not {r[3], r[6]} & {"d5", "w7"} and not {r[4], r[7]} & {"a3", "h4"}]
    assert {r["pair_id"] for r in got if r["source"] == "pure_topic"} == {r[0] for r in kept}
    assert {r["pair_id"] for r in got if r["source"] == "preference"} == {r[0] for r in preference if r[3] != "d5" and not {r[4], r[7]} & {"a3", "h4"} and r[0] != "c9"}
    easy = [r for r in got if r["source"] == "easy"]
    free = {r[0] for r in rows if r[3] == 1 and r[1] != "d5"} - {r[2] for r in kept}
    assert len(easy) == min(len(free), len({r[1] for r in rows if r[3] == 0 and r[1] != "w7"})) and len({r["neg_document"] for r in easy}) == len(easy)
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in got:
        root[find(r["pos_document"])] = find(r["neg_document"])
    splits: dict[str, set] = {}
    for r in got:
        splits.setdefault(find(r["pos_document"]), set()).add(r["split"])
    assert all(len(s) == 1 for s in splits.values()) and len(set.union(*splits.values())) == 3
    found = {r["check"]: r["violations"] for r in C.leakage(C.rows_of(spark.createDataFrame(got)), excluded["documents"], excluded["texts"]).collect()}
    assert found["leaking_documents"] == found["excluded_documents"] == found["excluded_texts"] == found["uneven_groups"] == 0


def test_checks_find_what_is_wrong(spark):
    rows = [("a", "d1", "T  one", 1, "train", "s"), ("a", "d1", "x", 0, "test", "s"), ("b", "bad", "t ONE", 1, "test", "s"), ("c", "d3", "x", 1, "validation", "s")]
    df = spark.createDataFrame(rows, "example_id string, document_id string, text string, label int, split string, source string")
    got = {r["check"]: r["violations"] for r in C.leakage(df, spark.createDataFrame([("bad",)], "document string"), spark.createDataFrame([("t one",)], "text string")).collect()}
    assert got == {"duplicate_ids": 1, "duplicate_texts": 1, "leaking_documents": 1, "shared_texts_test_train": 1, "shared_texts_test_validation": 1, "shared_texts_train_validation": 0, "excluded_documents": 1, "excluded_texts": 1, "uneven_groups": 2}
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "value double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "candidate_id string")
    told = {r["check"]: (r["status"], r["detail"]) for r in C.verified({"one": df}, (), ids("p", "q"), ids("q", "r"), nan, nan.select(F.lit(None).cast("double").alias("probability"))).collect()}
    assert told["one: no duplicate ids"] == ("FAIL", 1) and told["one: equal labels"] == ("FAIL", 2)
    assert told["no document with two splits over all datasets"] == ("NOTE", 1) and told["test candidates are the common ones"] == ("FAIL", 2)
    assert told["no metric is NaN"] == ("FAIL", 1) and told["no probability is missing"] == ("FAIL", 2)


def test_hybrid_fills_in_once_and_falls_short(spark):
    runs = spark.createDataFrame([("p1", "w1", 1, 0.5), ("p1", "w2", 2, 0.9), ("p2", "w2", 1, 0.8), ("p3", "w3", 1, 0.7)], "example_id string, page_id string, run int, score double")
    merged = C.merged_runs(runs)
    assert sorted(tuple(r) for r in merged.select("example_id", "page_id").collect()) == [("p1", "w2"), ("p3", "w3")]
    topic = merged.select("example_id", F.concat(F.lit("t"), "page_id").alias("negative_id"), F.col("page_id").alias("document_id"))
    passages = spark.createDataFrame([(f"p{k}", "train") for k in range(1, 5)], "example_id string, split string")
    easy = spark.createDataFrame([("e1", "w2", "train"), ("e2", "w9", "train"), ("e3", "w8", "test")], "negative_id string, document_id string, split string")
    rows, short = C.hybrid(passages, topic, easy, strict=False)
    assert {r["negative_id"] for r in rows.collect()} == {"tw2", "tw3", "e2"} and [tuple(r) for r in short.collect()] == [("train", "easy", 2, 1)]
    with pytest.raises(C.Shortfall):
        C.hybrid(passages, topic, easy)
    assert all(a["example_id"] != b["example_id"] for a, b in itertools.combinations(rows.collect(), 2))
