import os
import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from quarrymill.llm import quality, queries

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, kept boolean, digest string"


def small_corpus():
    """Good, poor and toxic texts; copies, near copies, shared passages, nulls, empties, repeated rows and ids."""
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    rows, labels = [], []
    for i in range(700):
        text, kind = prose(rnd.randint(30, 90)), i % 3
        if kind == 0:
            text = text.upper() + "!!!"
        elif kind == 1:
            text = text.replace(" ", " nasty ", 3)
        rows.append((i, text))
        labels.append((i, int(kind > 0), int(kind == 1)))
    passage = prose(60)
    for k in range(12):
        rows.append((2000 + k, f"{prose(40)} {passage} {prose(40)}"))
    base = prose(120)
    rows += [(3000 + k, base) for k in range(6)] + [(2999, base.replace(" ", "\n", 1))]
    for k in range(10):
        w = base.split()
        w[rnd.randrange(120)] = "changed"
        rows.append((3100 + k, " ".join(w)))
    rows += [(4000, None), (4001, ""), (4002, "one"), (None, prose(50)), (None, None), (5, rows[5][1]), (5, prose(40)), (4003, "é" * 900), (4004, prose(9000))]
    labels += [(2, 0, 0), (8, None, 1), (None, 1, 0), (2, 1, 0)]
    rnd.shuffle(rows)
    return rows, labels


def as_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels = small_corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2).write.parquet(f"{tmp_path}/labels.parquet")
    full = [(i, t, "en", f"s{k % 3}", len(t or ""), 1, True, "x") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: corpus_pipeline.stage(stages[name](spark, docs, str(tmp_path)), name)
    good = run("quality_classifier", docs)
    judged = quality.graded(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept").count()
    assert good.columns == docs.columns and good.count() == judged < docs.count()
    kept = {r["doc_id"] for r in good.collect()}
    clean = [i for i in range(700) if i % 3 == 2]
    assert len(kept & set(clean)) >= 0.98 * len(clean) and len(kept & {i for i in range(700) if i % 3 != 2 and i != 5}) <= 0.1 * 466
    before = as_rows(good)
    single = run("exact_dedup", good)
    groups: dict = {}
    for i, t in before:
        groups.setdefault(brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, t or ""))
    assert sorted((a, b) for a, b, _ in (min((x[0], x[1], "") for x in g) for g in groups.values())) == sorted((i is None, i or 0) for i, _ in as_rows(single))
    before = as_rows(single)
    near = run("minhash_near_dedup", single)
    plain = brute.near([(k, t) for k, (_, t) in enumerate(before)], 5)
    chosen: dict = {}
    for k, (i, _) in enumerate(before):
        key = ("alone", k) if not plain[k][0] else plain[k][1]
        chosen.setdefault(key, []).append((i is not None, i or 0))
    assert sorted(min(v) for v in chosen.values()) == sorted((i is not None, i or 0) for i, _ in as_rows(near))
    before = as_rows(near)
    left = run("suffix_dedup", near)
    assert left.columns == docs.columns
    data = {k: (t or "").encode() for k, (_, t) in enumerate(before)}
    seen = brute.Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    expected = []
    for k, (i, t) in enumerate(before):
        gone = bytearray(len(data[k]))
        for p in range(len(data[k]) - 199):
            if seen[data[k][p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        expected.append((i, t if not any(gone) else bytes(x for x, g in zip(data[k], gone) if not g).decode("utf-8", "ignore")))
    got = as_rows(left)
    assert got == sorted(expected, key=str) and any(a != b for a, b in zip(got, before))
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())
    packed = stages["best_fit_packing"](spark, left, str(tmp_path))
    assert packed.where("piece = 0").count() == left.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    packed = corpus_pipeline.run(spark, DATA)
    assert 0 < packed.select("doc_id").distinct().count() < docs.count()


def plain_fit(rows, grades, support):
    """The cumulative-link fit by loops over rows: bucket -> weight, and the thresholds."""
    import math

    n = len(rows)
    sig = lambda x: 1 / (1 + math.exp(-x))
    share = [sum(g == k for g in grades) / n for k in range(3)]
    held: dict = {}
    for r, g in zip(rows, grades):
        for b in r:
            held.setdefault(b, []).append(g)
    usable = {b for b, gs in held.items() if len(gs) >= max(support, n / quality.COMMON) and (b >= quality.BUCKETS or any(abs(gs.count(k) - len(gs) * p) > quality.SCREEN * math.sqrt(max(len(gs) * p * (1 - p), 1e-9)) for k, p in enumerate(share)))}
    balance = [s**-0.5 if s else 0.0 for s in share]
    total = sum(b * s for b, s in zip(balance, share))
    balance = [b / total for b in balance]
    above = [min(max(sum(g > k for g in grades) / n, 1e-3), 1 - 1e-3) for k in range(2)]
    t = [-math.log(a / (1 - a)) for a in above]
    w, gw, gt = {b: 0.0 for b in held}, {b: 1e-8 for b in held}, [1e-8, 1e-8]
    rng = np.random.default_rng(7)
    for step in range(quality.PASSES):
        rate = quality.RATE / (1 + 0.1 * step)
        order = rng.permutation(n)
        for i in range(0, n, 256):
            some = order[i : i + 256]
            dw, dt = {}, [0.0, 0.0]
            for k in some:
                g, score = grades[k], sum(w[b] * v for b, v in rows[k].items() if b in usable)
                tail = [1.0, *(sig(score - x) for x in t), 0.0]
                p = max(tail[g] - tail[g + 1], 1e-9)
                up, down = tail[g] * (1 - tail[g]) / p, tail[g + 1] * (1 - tail[g + 1]) / p
                for b, v in rows[k].items():
                    if b in usable:
                        dw[b] = dw.get(b, 0.0) - balance[g] * (up - down) * v / len(some)
                for m in range(2):
                    dt[m] += balance[g] * ((up if g == m + 1 else 0.0) - (down if g == m else 0.0)) / len(some)
            for b, d in dw.items():
                d += quality.DECAY * w[b]
                gw[b] += d * d
                w[b] -= rate * d / math.sqrt(gw[b])
            for m in range(2):
                gt[m] += dt[m] * dt[m]
                t[m] -= rate * dt[m] / math.sqrt(gt[m])
            t[1] = max(t[1], t[0] + 1e-3)
    return {b: x for b, x in w.items() if x}, t


def test_fit_and_scores_against_loops(spark):
    """The whole operator against loops: features, fit, scores, tails; several labels, nulls, long texts and ties."""
    rows, labels = small_corpus()
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 5], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grades: dict = {}
    for i, good, toxic in labels:
        if i is not None and good is not None:
            grades[i] = min(grades.get(i, 2), 0 if good <= 0 else 1 if toxic else 2)
    texts = {i: t for i, t in rows if i is not None and i != 5}
    fitted = sorted(i for i in grades if i in texts)

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        bucket, value, _ = quality.features(raw, np.array([0, len(raw)]))
        return dict(zip(bucket.tolist(), np.float32(value).tolist()))

    each = {i: features(t) for i, t in texts.items()}
    weights, thresholds = plain_fit([each[i] for i in fitted], [grades[i] for i in fitted], quality.SUPPORT)
    got = {r["doc_id"]: r for r in quality.graded(docs, marks).collect()}
    for i, x in each.items():
        score = sum(weights.get(b, 0.0) * v for b, v in x.items())
        tail = [1 / (1 + np.exp(-(score - t))) for t in thresholds]
        assert got[i]["score"] == pytest.approx(score, abs=2e-3) and got[i]["expected_grade"] == pytest.approx(sum(tail), abs=2e-3)
        assert got[i]["p_good"] == pytest.approx(tail[1], abs=2e-3) and got[i]["kept"] == (got[i]["p_good"] >= quality.KEEP)


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
