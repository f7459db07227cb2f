import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import features as E
from quarrymill.operators import matching
from quarrymill.operators import models as L
from quarrymill.sources import http


def newton(x, y, c):
    """Logistic regression with balanced classes and a free intercept: C * weighted losses + half the squared weights."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    z, beta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = c * z.T @ (w * (p - y)) + penalty * beta
        hessian = c * (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_grid_against_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 5))
    y = ((x @ [1, -2, 0.5, 0, 0] + rng.normal(size=240)) > 0.6).astype(int)
    df = spark.createDataFrame([(f"e{k}", [float(v) for v in x[k]], int(y[k]), "train" if k < 150 else "validation") for k in range(240)], "example_id string, embedding array<double>, label int, split string")
    train, held = df.where("split = 'train'"), df.where("split = 'validation'")
    model, tried = L.tuned(train, held, L.VECTORS)
    scores = {}
    for t in tried:
        beta = newton(x[:150], y[:150], t["C"])
        s = 1 / (1 + np.exp(-(x[150:] @ beta[:-1] + beta[-1])))
        pos, neg = s[y[150:] == 1], s[y[150:] == 0]
        auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
        f1 = max(2 * (pos >= c).sum() / ((pos >= c).sum() + (neg >= c).sum() + len(pos)) for c in s)
        assert t["roc_auc"] == pytest.approx(auc, abs=2e-3) and t["f1"] == pytest.approx(f1, abs=0.02)
        scores[t["C"]] = (t["roc_auc"], t["f1"], -t["C"]), beta, s
    _, beta, s = max(scores.values(), key=lambda v: v[0])
    found = {int(r["feature"]): r["coefficient"] for r in model.coefficients.collect()}
    assert [found[k] for k in range(5)] == pytest.approx(list(beta[:-1]), abs=2e-3) and model.intercept == pytest.approx(beta[-1], abs=2e-3)
    got = {r["example_id"]: r["probability"] for r in L.predicted(model, held).collect()}
    assert [got[f"e{k}"] for k in range(150, 240)] == pytest.approx(list(s), abs=2e-3)
    assert L.top_coefficients(model, 2).where("side = 'positive'").first()["feature"] == "0"


def test_text_model_is_fitted_on_training_rows_only(spark, tmp_path):
    rows = [(f"e{k}", f"common word{k % 7} " + ("good fine" if k % 2 else "bad poor"), k % 2) for k in range(60)]
    train = spark.createDataFrame(rows, "example_id string, text string, label int")
    held = spark.createDataFrame([("v1", "good unseen", 1), ("v2", "poor unseen unseen", 0), ("v3", None, 0)], "example_id string, text string, label int")
    model, _ = L.tuned(train, held, L.TERMS, facts={"fingerprint": L.fingerprint(train, ["example_id", "text"])})
    assert "unseen" not in {r["feature"] for r in model.coefficients.collect()}
    L.save(model, f"file://{tmp_path}/m")
    loaded = L.load(spark, f"file://{tmp_path}/m")
    assert (loaded.kind, loaded.intercept, loaded.threshold, dict(loaded.facts)) == (model.kind, model.intercept, model.threshold, dict(model.facts))
    scored = L.score_texts(spark, f"file://{tmp_path}/m", ["bad poor", "good fine", ""]).collect()
    assert [r["prediction"] for r in scored][:2] == [0, 1] and scored[0]["text"] == "bad poor"
    assert scored[2]["probability"] == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    folders = L.reorganised(spark, {"terms": f"file://{tmp_path}/m"}, "own", f"file://{tmp_path}")
    assert L.load(spark, folders[0]).threshold == model.threshold and folders[0].endswith("/own_terms")
    with pytest.raises(FileNotFoundError):
        L.load(spark, f"file://{tmp_path}/none")


def test_vocabulary_comes_from_the_fitted_rows(spark):
    fit = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "beta beta")], "doc_id long, text string")
    other = spark.createDataFrame([(9, "alpha delta beta beta")], "doc_id long, text string")
    got = {r["term"]: r["weight"] for r in E.weigh(other, E.vocabulary(fit)).collect()}
    raw = {"alpha": np.log(4 / 3) + 1, "beta": (1 + np.log(2)) * (np.log(4 / 3) + 1)}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({k: v / norm for k, v in raw.items()})


def test_caches_of_vectors(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "x"), ("d", None)], "example_id string, text string")
    path = f"file://{tmp_path}/texts"
    assert L.cached_vectors(rows.where("example_id <> 'b'").select("text"), encoder, path).count() == 2 and calls.value == 2
    assert L.cached_vectors(rows.select("text"), encoder, path).count() == 3 and calls.value == 3
    folder = f"file://{tmp_path}/sets"
    first = L.dataset_vectors(rows, encoder, folder)
    before = calls.value
    assert first.count() == 4 and L.dataset_vectors(rows.orderBy(F.desc("example_id")), encoder, folder).count() == 4 and calls.value == before
    mark = L.fingerprint(rows, ["example_id", "text"])[:16]
    L.encoded(rows.limit(1).select(F.lit("z").alias("example_id"), "text"), encoder).select("example_id", "embedding").write.mode("append").parquet(f"{folder}/{mark}")
    with pytest.raises(ValueError, match="not those of the dataset"):
        L.dataset_vectors(rows, encoder, folder)


def test_requests_repeat_and_are_remembered(spark, tmp_path):
    answers, pauses, asked = [(429, {"retry-after": "3"}, b""), (429, {}, b""), (200, {}, b'{"query": {"search": [{"pageid": 5}, {}, {"pageid": 6}]}}')], [], []

    def opener(url):
        asked.append(url)
        return answers.pop(0)

    source = http.CachedSource(spark, "http://host/api", f"file://{tmp_path}/cache", opener, pauses.append)
    assert source.search("two words", 10) == [5, 6] and source.search("two words", 10) == [5, 6]
    assert pauses == [3.0, 4.0] and len(asked) == 3 and "srsearch=two+words" in asked[0]
    source.keep()
    again = http.CachedSource(spark, "http://host/api", f"file://{tmp_path}/cache", opener, pauses.append)
    assert again.search("two words", 10) == [5, 6] and len(asked) == 3
    page = lambda k: {"pageid": k, "title": f"T{k}", "fullurl": "u", "extract": "e"}
    answers += [(200, {}, json.dumps({"query": {"pages": [page(k) for k in range(20)]}}).encode()), (200, {}, json.dumps({"query": {"pages": [page(20)]}}).encode())]
    assert again.pages(range(21)).count() == 21 and len(asked) == 5
    answers += [(503, {}, b"")]
    with pytest.raises(http.HttpError):
        http.get_json("http://host", opener, http.BUSY, pauses.append)
    pauses.clear()
    answers += [(503, {}, b"")] * 7
    with pytest.raises(http.HttpError):
        http.get_json("http://host", opener, http.UNWELL, pauses.append)
    assert pauses == [2, 4, 8, 16, 30, 30]
    answers += [(502, {}, b""), (200, {}, b'{"rows": [{"row": {"a": 1}}]}'), (200, {}, b'{"rows": []}')]
    assert list(http.dataset_rows("http://host/rows", {"split": "train"}, [(0, 100), (500, 100)], opener, pauses.append)) == [{"a": 1}]


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(40)]
    base = [list(rng.choice(words, 40)) for _ in range(6)]
    texts = []
    for k in range(60):
        w = list(base[k % 6])
        for at in rng.choice(40, int(rng.integers(0, 14)), replace=False):
            w[at] = str(rng.choice(words))
        texts.append(" ".join(w) if k % 11 else " ".join(base[k % 6]).upper())
    texts += ["", None, "short", "short", " SHORT "]
    left = [(f"l{k}", t) for k, t in enumerate(texts[::2])]
    right = [(f"r{k}", t) for k, t in enumerate(texts)]
    norm = lambda t: " ".join((t or "").lower().split())
    grams = lambda t: {norm(t)[i : i + 8] for i in range(max(1, len(norm(t)) - 7))} if norm(t) else set()
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    for least in (0.5, 0.8):
        expected = {(i, j): len(a & b) / len(a | b) for i, s in left for j, t in right if (a := grams(s)) and (b := grams(t)) and len(a & b) / len(a | b) >= least}
        got = {(r["left_id"], r["right_id"]): r["similarity"] for r in matching.near_duplicates(make(left), make(right), least).collect()}
        assert got == pytest.approx(expected)
    assert len(expected) > 30


def test_near_duplicates_by_index_and_by_join(spark, monkeypatch):
    """A few texts against many are met where they are: no shingle is shuffled. Both ways give the same pairs."""
    base = ["Ünder the bridge a boat went by", "the boat that went under the bridge", "abc", "\U0001f600\U0001f601 smile", "abcabcabcabc"]
    left = spark.createDataFrame([(f"l{k}", t) for k, t in enumerate(base)], "id string, text string")
    right = spark.createDataFrame([(f"r{k}", t.upper() if k % 2 else f" {t} ") for k, t in enumerate(base * 2 + ["abd", "", None])], "id string, text string")
    found = matching.near_duplicates(left, right)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join Inner" in plan
    key = lambda df: sorted((r["left_id"], r["right_id"], r["similarity"]) for r in df.collect())
    one, turned = key(found), key(matching.near_duplicates(right, left))
    monkeypatch.setattr(matching, "INDEXED", 0)
    assert one == key(matching.near_duplicates(left, right)) and len(one) >= 10
    assert turned == key(matching.near_duplicates(right, left)) == sorted((b, a, s) for a, b, s in one)
    # one large side, on the left
    monkeypatch.setattr(matching, "INDEXED", 150)
    assert key(matching.near_duplicates(right, left)) == turned
    empty = left.where("id is null")
    assert matching.near_duplicates(empty, right).count() == 0 == matching.near_duplicates(right, empty).count()


def test_terms_are_counted_in_their_documents(spark):
    """Against a plain count: repeated and missing ids, accents, stop words, long documents; no term of a document is shuffled."""
    import re
    from collections import Counter

    rng = np.random.default_rng(5)
    words = ["été", "ete", "the", "a", "naïve", "snake_case", "x1", "Ω", "ΩΩ", "word", "Straße", "b"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) + rng.choice([".", "!\n", " - ", ""]) for _ in range(40)]
    rows = [(k if k % 9 else 7 if k % 2 else None, t) for k, t in enumerate(texts)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = str.maketrans(*E._accents())
    for stop, accents in (((), False), (("the",), True)):
        held: dict = {}
        for i, t in rows:
            w = [x for x in re.findall(r"\w{2,}", (t or "").lower() if accents else (t or "").lower().translate(plain)) if x not in stop]
            held.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        df, total = Counter(t for c in held.values() for t in c), sum(held.values(), Counter())
        found = E.vocabulary(docs, 2, 0.98, 60, stop, accents=accents)
        best = sorted((t for t in df if 2 <= df[t] <= len(rows) * 0.98), key=lambda t: (-total[t], t))[:60]
        assert {r["term"]: (r["df"], r["n"]) for r in found.collect()} == {t: (df[t], len(rows)) for t in best}
        got = E.weigh(docs, found, stop=stop, accents=accents)
        every = {(r["doc_id"], r["term"]): r["weight"] for r in got.collect()}
        raw = {(i, t): (1 + np.log(c[t])) * (np.log((1 + len(rows)) / (1 + df[t])) + 1) for i, c in held.items() for t in best if c[t]}
        norm = {i: np.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i in held}
        assert every == pytest.approx({(i, t): v / norm[i] for (i, t), v in raw.items()})
        sums = {r["doc_id"]: (r["terms"], r["total"], r["largest"]) for r in E.weight_sums(docs, found, stop=stop, accents=accents).collect()}
        assert sums.keys() == {i for i, _ in every}
        for i, (n, s, most) in sums.items():
            mine = [v for (j, _), v in every.items() if j == i]
            assert (n, s, most) == (len(mine), pytest.approx(sum(mine)), max(mine))
        phrases = {r["doc_id"]: r["phrases"] for r in E.keyphrases(docs, found, stop=stop, accents=accents).collect()}
        top = {r["doc_id"]: (r["term"], r["weight"]) for r in E.heaviest(docs, found, stop=stop, accents=accents).collect()}
        for i in sums:
            order = sorted(((-round(v, 9), t) for (j, t), v in every.items() if j == i))
            kept: list = []
            for _, t in order:
                if len(kept) < 3 and not any(t in k or k in t for k in kept):
                    kept.append(t)
            assert phrases[i] == kept and top[i] == (max((-w, t) for w, t in order)[1], sums[i][2])
    once = docs.where("doc_id > 7 and doc_id % 9 > 0")
    plan = E.weight_sums(once, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    counts = E.vocabulary(once)._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count("MapInArrow") == 1 and "Generate" not in counts


def test_vectors_are_made_in_their_rows(spark):
    """A text's vector comes from its row: no term is shuffled, and a text without a known term has an empty one."""
    rows = spark.createDataFrame([("a", "one two two", 1), ("b", "two three", 0), ("c", "four", 1), ("d", None, 0)], "example_id string, text string, label int")
    vectors, names = L._vectors(rows, E.vocabulary(rows, 1, 1.0, id_column="example_id"), "example_id")
    assert "Aggregate" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    got = {r["example_id"]: r["features"] for r in vectors.collect()}
    assert names == sorted(["one", "two", "three", "four", "one two", "two two", "two three"])
    assert [names[k] for k in got["a"].indices] == ["one", "one two", "two", "two two"] and got["d"].numNonzeros() == 0
    assert got["b"].norm(2) == pytest.approx(1)
