import brute
import numpy as np
import pytest

from quarrymill.llm import exact_dedup, indexes, minhash_dedup, substring_dedup, suffix_dedup


def found(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact(docs, rows):
    assert found(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.exact(rows)


def test_exact_trie_spills(tmp_path):
    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 12)).astype(np.uint8)) for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, 20_000, str(tmp_path))
    for k in keys:
        trie.insert(k, 1)
    got = dict(trie.items())
    assert got == {k: keys.count(k) for k in set(keys)}


def test_exact_small_tries(docs, rows):
    staged = exact_dedup.representatives(docs.select("doc_id", "text"), 3000)
    owners = exact_dedup.owners(staged, 3000)
    assert owners.agg({"group_size": "max"}).first()[0] == max(x[1] for x in brute.exact(rows).values())


def test_substring(docs, rows):
    assert found(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept_sha256") == brute.substrings(rows)


def test_suffix(docs, rows):
    assert found(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(rows)


def test_near(docs, rows):
    assert found(minhash_dedup.near_dedup(docs, 4), "n_shingles", "component_id", "kept") == brute.near(rows)


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, minhash_dedup.near_dedup])
def test_empty_and_odd_tables(operator, empty, odd):
    assert operator(empty).count() == 0
    got = operator(odd)
    assert got.count() == 6
    if operator is exact_dedup.exact_dedup:
        assert [r["kept"] for r in got.where("group_size = 3").collect()].count(True) == 1


def test_stage_keeps_columns(spark, docs):
    for function in (exact_dedup.stage_function, minhash_dedup.stage_function, suffix_dedup.stage_function):
        out = function(spark, docs, "")
        assert out.columns == docs.columns
    assert out.count() == docs.count()


def test_prefix_groups_against_sorting():
    rng = np.random.default_rng(0)
    for trial in range(30):
        parts = [rng.integers(1, 3, rng.integers(1, 40)).astype(np.uint8) for _ in range(6)]
        symbols, _ = indexes.concatenate(parts)
        order, fresh = indexes.common_prefix_groups(symbols, 6)
        keys = [bytes(symbols)[i : i + 6] for i in order]
        assert keys == sorted(keys)
        assert list(fresh) == [True] + [a != b for a, b in zip(keys, keys[1:])]


def test_prefix_groups_begin_where_the_sort_has_been(monkeypatch):
    """Long common prefixes: the groups of plain sorting, in fewer extensions than half of the depth."""
    rng = np.random.default_rng(2)
    extend, calls = indexes.Wavelet.extensions, []
    monkeypatch.setattr(indexes.Wavelet, "extensions", lambda self, lo, hi: (calls.append(1), extend(self, lo, hi))[1])
    for trial in range(8):
        base = rng.integers(1, 90, 400)
        parts = [np.append(base[(a := rng.integers(0, 150)) : a + rng.integers(100, 250)], rng.integers(1, 90, 3)).astype(np.uint8) for _ in range(12)]
        parts += [np.full(300, 7, np.uint8), np.tile(base[:11], 30).astype(np.uint8)][: trial % 3]
        symbols, _ = indexes.concatenate(parts)
        calls.clear()
        order, fresh = indexes.common_prefix_groups(symbols, 200)
        keys = [bytes(symbols)[i : i + 200] for i in order]
        assert keys == sorted(keys)
        assert list(fresh) == [True] + [a != b for a, b in zip(keys, keys[1:])]
        assert len(calls) < 100


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 500)
    _, marked, fm = indexes.transform(text, 8, 4)
    for _ in range(50):
        k = int(rng.integers(1, 6))
        at = int(rng.integers(0, 490))
        lo, hi = np.array([0]), np.array([len(marked)])
        for symbol in text[at : at + k][::-1]:
            lo, hi = fm.extend(np.array([symbol + 1]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + k] == text[at : at + k]).all() for i in range(len(text) - k + 1))


def test_large_near_group(spark):
    """A group of near copies in which many are not close enough to the smallest."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            words[at] = f"v{rng.integers(0, 60)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(minhash_dedup.near_dedup(docs, 4), "n_shingles", "component_id", "kept") == brute.near(rows)


def test_pair_that_few_minhashes_show(spark):
    """A pair of exactly 0.8 whose own words hold the minima of many hashes, seen in mixed buckets only: each bucket
    that it shares has a smaller document, near to both but not near enough."""
    rng = np.random.default_rng(4)
    core = [f"c{i}" for i in range(80)]
    a = [f"p{i}" for i in (2830, 2235, 1828, 1830, 545, 2652, 2769, 938, 474, 229)]
    b = [f"p{i}" for i in (1039, 2161, 2288, 2113, 175, 2626, 2805, 276, 1753, 1938)]
    rows = [(k, [*rng.choice(core, 71, replace=False), *(f"j{k}_{i}" for i in range(4))]) for k in range(40)]
    rows = [(i, " ".join(w)) for i, w in [*rows, (1000, core + a), (1001, core + b)]]
    expected = brute.near(rows, 1)
    assert expected[1001][1] == expected[1000][1]
    assert found(minhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1), "n_shingles", "component_id", "kept") == expected


@pytest.fixture(scope="module")
def repeated_ids(spark):
    """Rows that share ids, with equal and with different texts."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(500)]
    prose = lambda n: " ".join(rng.choice(words, n))
    a, b, shared = prose(120), prose(90), prose(60)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, prose(80)), (4, f"{prose(20)} {shared}"), (4, f"{shared} {prose(30)}"), (5, f"{prose(10)} {shared} {prose(5)}"), (6, ""), (6, None), (7, "few words"), (7, "few words"), (3, b + " x")]
    return rows, spark.createDataFrame([(i, t, len(t or ""), f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, source string").repartition(3)


def sorted_rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_repeated_ids_in_operators(repeated_ids):
    rows, docs = repeated_ids
    own = list(enumerate(rows))  # every row under a number of its own
    data = [(t or "").encode() for _, (_, t) in own]
    plain = brute.suffixes([(k, t) for k, (_, t) in own])
    assert sorted_rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((i, *plain[k]) for k, (i, _) in own)
    words = [d.split() for d in data]
    first = {}
    for k, (i, _) in own:
        for p in range(len(words[k]) - 12):
            w = tuple(words[k][p : p + 13])
            first[w] = min(first.get(w, i), i)
    expected = []
    for k, (i, _) in own:
        gone = [False] * len(words[k])
        for p in range(len(words[k]) - 12):
            if first[tuple(words[k][p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        expected.append((i, len(gone), sum(gone), brute.sha(b" ".join(x for x, g in zip(words[k], gone) if not g))))
    assert sorted_rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected)
    near = brute.near([(k, t) for k, (_, t) in own])
    lowest = {}
    for k, (i, _) in own:
        lowest[near[k][1]] = min(lowest.get(near[k][1], i), i)
    assert sorted_rows(minhash_dedup.near_dedup(docs, 4), "doc_id", "n_shingles", "component_id") == sorted((i, near[k][0], lowest[near[k][1]]) for k, (i, _) in own)
    exact = {}
    for i, t in rows:
        exact.setdefault(" ".join((t or "").split(" ")), []).append(i)
    assert sorted_rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size") == sorted((i, min(exact[t or ""]), len(exact[t or ""])) for i, t in rows)
    assert exact_dedup.exact_dedup(docs).where("kept").count() == len(exact)


def test_repeated_ids_in_stages(spark, repeated_ids):
    rows, docs = repeated_ids
    kept = exact_dedup.stage_function(spark, docs, "")
    assert kept.columns == docs.columns
    lowest = {}
    for i, t in rows:
        lowest[t or ""] = min(lowest.get(t or "", i), i)
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t) for t, i in lowest.items())
    near = brute.near([(k, t) for k, (_, t) in enumerate(rows)], 5)
    groups = {}
    for k, (i, t) in enumerate(rows):
        if near[k][0]:
            groups.setdefault(near[k][1], []).append(i)
    got = sorted(r["doc_id"] for r in minhash_dedup.stage_function(spark, docs, "").collect())
    assert got == sorted([min(g) for g in groups.values()] + [6])  # the empty rows of one id count as one
    left = suffix_dedup.stage_function(spark, docs, "")
    assert left.count() == len(rows) and left.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())


def test_exact_small_tries_all_rows(docs, rows):
    staged = exact_dedup.representatives(docs.select("doc_id", "text"), 3000)
    owned = exact_dedup.owners(staged, 3000)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in staged.where("kind = 'M'").join(owned, "rep").collect()}
    assert got == {i: x[:2] for i, x in brute.exact(rows).items()}


def test_hot_anchors_are_parted(spark, rows):
    """A passage shorter and one longer than a window in ever new surroundings, some of which repeat; any anchor is hot."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(900)]
    prose = lambda n: " ".join(rng.choice(words, n))
    short, long = prose(9), prose(70)
    more = [(1000 + k, f"{prose(25)} {short if k % 2 else long} {prose(25)}") for k in range(60)]
    more += [(2000 + k, more[3 * k][1][20:]) for k in range(15)]
    every = rows + more
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(5)
    assert found(substring_dedup.substring_dedup(docs, hot=-4), "n_words", "n_removed", "kept_sha256") == brute.substrings(every)
    assert found(suffix_dedup.suffix_dedup(docs, hot=-4), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(every)
