import ast
import gzip
import hashlib
import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import dealing, packing, piece_bpe, quality, quotes, search, warc, windows

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_packing(docs, rows, empty, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    got: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in packing.packed_digests(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert sorted(got[i]) == [(p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed_digests(empty).count() == 0
    assert packing.packed_digests(odd).count() == 6


def test_best_two_fit_replaces_the_smallest():
    lengths = np.array([60, 25, 20, 19])
    bins, places = packing.best_two_fit(lengths, 100)
    assert len(set(bins)) == 2 and bins[0] == bins[2] == bins[3]  # 60 + 20 + 19 beats 60 + 25
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 4097, 5000)
    bins, places = packing.best_two_fit(lengths, 4096)
    assert np.bincount(bins, lengths).max() <= 4096
    assert len(set(bins)) <= 1.01 * lengths.sum() / 4096 + 1


def test_pieces(docs, rows, empty, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded"]) for r in piece_bpe.encode_decode(docs).collect()}
    for i, t in rows:
        ids = library.encode(t or "")
        assert got[i] == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    assert piece_bpe.encode_decode(empty).count() == 0 and piece_bpe.encode_decode(odd).count() == 6


def test_pieces_of_random_text():
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    model = piece_bpe.PieceModel(piece_bpe.default_path())
    random.seed(2)
    for _ in range(400):
        text = "".join(random.choices(" abcdefghilmnorstu  \n\té中🎉▁.,", k=random.randint(0, 60)))
        ids = library.encode(text)
        assert model.encode(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_warc(spark, tmp_path):
    big, small = "<p>" + "é" * 80 + "</p>\r\n\r\nWARC/1.1\r\n", "tiny"
    rows = [(3, "http://a/\r\nX: y", big), (1, None, big), (2, "", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", "z" * 99), (8, "u", "z" * 99), (9, "u", "z" * 100), (10, "u", "z" * 100)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    path = f"file://{tmp_path}/warc"
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages, path).collect()}
    firsts = {big: 1, "z" * 100: 9}
    for i, _, html in rows:
        data = (html or "").encode()
        source = firsts.get(html)
        kind = "revisit" if source not in (None, i) else "response"
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), kind, source if kind == "revisit" else None)
    read = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert all(r["sound"] for r in read.values()) and bytes(read[1]["payload"]) == big.encode() and read[3]["url"] == "http://a/ X: y"
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_long_and_repeated(spark, tmp_path):
    """Null and repeated page ids, the join without broadcast, archives cut by bytes, payloads of 16 MB and more."""
    big, long = "b" * 150, "".join(random.Random(1).choices("abcdef <>", k=17_000_000))
    rows = [(None, big), (5, big), (5, big), (5, "c" * 150), (8, big), (None, "d" * 200), (None, "d" * 200), (20, long), (21, long), (22, None)]
    pages = spark.createDataFrame([(i, f"u{k}", t) for k, (i, t) in enumerate(rows)], "page_id long, url string, html string").repartition(2)
    expected = sorted([("-1", 150, "revisit", 5), ("5", 150, "response", None), ("5", 150, "response", None), ("5", 150, "response", None), ("8", 150, "revisit", 5), ("-1", 200, "response", None), ("-1", 200, "response", None), ("20", 17_000_000, "response", None), ("21", 17_000_000, "revisit", 20), ("22", 0, "response", None)], key=str)
    for sent in (0, warc.SENT):
        path = f"file://{tmp_path}/{sent}"
        warc.write_archives(warc.resolved(pages, sent=sent), path, 300)
        read = warc.read_archives(spark, path)
        assert read.where("not sound").count() == 0 and read.where("page_id = 20").first()["payload"] == long.encode()
        headers = read.select("page_id", "record_type", "payload_digest", "refers_to", "payload_bytes")
        got = [(str(-1 if r["page_id"] is None else r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.revisit_sources(headers).collect()]
        assert sorted(got, key=str) == expected
        files = list((tmp_path / str(sent)).glob("part-*"))
        assert len(files) >= 8
        assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)  # any reader takes them


def best_by_sums(texts, asked, top=10):
    """(doc_id, score) lists by query for rows (doc_id, text); a null id is the smallest."""
    import math

    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    rows = [(i, (t or "").encode().translate(lower).split()) for i, t in texts]
    counts = [(i, len(w), Counter(w)) for i, w in rows]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(t for _, _, c in counts for t in c)
    out = {}
    for q, text in asked:
        terms = sorted(set((text or "").encode().translate(lower).split()))
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
        scores = []
        for i, size, c in counts:
            shared = [t for t in terms if t in c]
            if shared:
                scores.append((i, round(math.fsum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in shared), 6)))
        out[q] = sorted(scores, key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:top]
    return out


def found_by_search(docs, asked, shard):
    got: dict[int, list] = {}
    for r in search.top_documents(docs, asked, 10, shard).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return got


def test_search_against_sums(docs, rows, empty):
    asked = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    expected = best_by_sums(rows, [(i, t) for i, t in rows if i % 5 == 0])
    for shard in (search.SHARD, 3000):
        got = found_by_search(docs, asked, shard)
        for q, best in expected.items():
            assert [i for i, _ in got.get(q, [])] == [i for i, _ in best]
            assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in best], abs=2e-6)
    assert search.top_documents(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_search_copies_of_long_texts(spark):
    """Copies and variants of a text of 20,000 words, whose scores differ in the fifth place of five digits or not at
    all, rows that repeat an id, and one without id."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(6000)]
    base = list(rng.choice(vocabulary, 20_000))
    texts = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(5, 300))))) for k in range(200)]
    for k in range(20):
        words = list(base)
        words[int(rng.integers(0, 20_000))] = f"v{k}"
        texts += [(300 + 2 * k, " ".join(base)), (301 + 2 * k, " ".join(words))]
    texts += [(7, texts[7][1]), (7, texts[8][1]), (None, texts[9][1]), (500, None), (501, "")]
    rows = [texts[k] for k in rng.permutation(len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = [(300, texts[200][1]), (301, texts[201][1]), (9, texts[9][1]), (7, texts[7][1]), (8, "w1 w2 w1"), (10, ""), (11, "unknown")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    expected = {q: best for q, best in best_by_sums(rows, queries).items() if best}
    for shard in (search.SHARD, 40_000):
        assert found_by_search(docs, asked, shard) == expected


def test_quality(spark, empty, odd):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, int(rng.integers(30, 120))))
        kind = i % 3
        if kind == 0:
            text = [w.upper() + "!!" for w in text]
        elif kind == 1:
            text[int(rng.integers(0, len(text)))] = "nasty"
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train, held = marks.where("doc_id < 600"), {i: kind == 2 for i, kind in ((r[0], r[0] % 3) for r in rows) if i >= 600}
    got = {r["doc_id"]: r for r in quality.graded(docs, train).collect()}
    right = sum(got[i]["kept"] == good for i, good in held.items())
    assert right >= 0.97 * len(held)
    assert all(0 <= r["expected_grade"] <= 2 for r in got.values())
    assert quality.graded(empty, marks).count() == 0
    assert all(r["kept"] for r in quality.graded(odd, marks.limit(0)).collect())
    assert quality.graded(odd, marks.withColumn("toxic", F.lit(None).cast("int"))).count() == 6


def test_quotes(spark):
    first = "Can we meet on Monday? The room is free all day.\n\nBring the plan, please."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", "Monday is fine.\n> Can we meet on Monday? The room\n> is free all day."),
        (1, 2, "user", "On 3 May, A wrote:\n> Monday is fine.\n>> Bring the plan, please.\n\nGood, see you."),
        (1, 3, "assistant", "> nobody ever said this\nWhat?"),
        (1, 4, "user", "> Good, see you.\n"),
        (2, 0, "user", None),
        (2, 1, "user", "> Monday is fine.\nother conversation"),
        (None, 0, "user", "> Monday is fine."),
        (3, 0, None, "a"),
        (3, 0, None, "a"),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked_conversations(df).collect()}
    assert len(got) == 9 and quotes.linked_conversations(df).count() == 10
    links = {k: (r["parent_turn"], r["root_turn"], r["depth"]) for k, r in got.items()}
    assert links[1, 0] == (None, 0, 0) and links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2)
    assert links[1, 3] == (None, 3, 0) and links[1, 4] == (2, 0, 3) and links[2, 1] == (None, 1, 0)
    assert got[1, 2]["text"] == "Good, see you." and got[1, 4]["text"] == "" and got[2, 0]["text"] == ""
    assert got[1, 1]["chat"] == "<|assistant|>\nMonday is fine.\n" and got[3, 0]["chat"].startswith("<|unknown|>")
    assert quotes.linked_conversations(df.limit(0)).count() == 0


def test_conversations_against_plain_version(spark):
    """Random threads with nested quotes, all line ends, attributions, common lines, deep levels and long texts."""
    rnd = random.Random(8)
    rows = []
    for conv in range(12):
        said: list[str] = []
        for turn in range(rnd.randint(1, 25)):
            lines = []
            if said and rnd.random() < 0.7:
                source = rnd.choice(said)
                if rnd.random() < 0.5:
                    lines.append("On 3 May, someone wrote:")
                quoted = source.split("\n")
                cut = rnd.randint(0, len(quoted) - 1)
                lines += [">" * rnd.randint(1, 2) + rnd.choice(["", " "]) + x for x in quoted[cut : cut + rnd.randint(1, 6)]]
            for _ in range(rnd.randint(0, 3)):
                lines += ["Thanks." if rnd.random() < 0.3 else " ".join(rnd.choices(["Plan", "room", "Monday", "key", "x" * 9], k=rnd.randint(1, 30))), *[""] * rnd.randint(0, 3)]
            if turn == 5:
                lines += [">" * 40 + " deep", "word " * 20_000]
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, rnd.choice(["user", None]), text.replace("\n", rnd.choice(["\n", "\r\n", "\r"]))))
    expected = brute.conversations(rows)
    df = spark.createDataFrame([*rows, (None, 1, "user", "a"), (None, 1, "user", "a"), (3, None, "user", "b")], "conv_id long, turn long, role string, text string").repartition(5)
    for part in (quotes.PART, 3):
        got: dict = {}
        lone = 0
        for r in quotes.conversations(df, part).orderBy("conv_id", "root_turn", "part").collect():
            assert len(r["turns"]) == r["n_messages"] <= part
            if r["conv_id"] is None or r["root_turn"] is None:
                lone += r["n_messages"]
                assert r["n_messages"] == 1
                continue
            held = got.setdefault((r["conv_id"], r["root_turn"]), [[], ""])
            held[0] += zip(r["turns"], r["parents"])
            held[1] += r["chat"]
        assert lone == 3
        assert got == {k: [[(t, p) for t, p, _ in v], "".join(c for *_, c in v)] for k, v in expected.items()}
    assert any(len(v) > 3 for v in expected.values())


def test_token_ids_of_batches(monkeypatch):
    """Ids of whole batches are the tokenizer's own, whatever the cache holds and however new words are put together."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    draw = random.Random(8)
    letters = ["a", "e", "th", "ing", "ß", "é", "É", "ÿ", "÷", "×", "ª", "µ", "I", "İ", "Σ", "ς", "क़", "e\u0301", "\u0301", "ǆ", "中", "▁", "\u00a0", "\u2003", "\x85", "'s", "'", "1", "²", "<s>"]
    ends = ["", "", "", ".", ",!", "!!", "|", "<|endoftext|>", "<|EndOfText|>", "\u0301"]
    word = lambda: "".join(draw.choices(letters, k=draw.randint(1, 5))) + draw.choice(ends)
    common = [word() for _ in range(30)]
    texts = ["".join(x + draw.choice([" ", "\n", "\t ", "\x0b", "  "]) for x in draw.choices([*common, word(), word(), "plain", "x" * 90], k=draw.randint(0, 30))) for _ in range(600)]
    texts += [None, "", " ", " a ", "endof<|endoftext|>text The"]
    for cached, together in ((packing.CACHED, packing.TOGETHER), (40, 7)):
        monkeypatch.setattr(packing, "CACHED", cached)
        monkeypatch.setattr(packing, "TOGETHER", together)
        packing._state.clear()
        for i in range(0, len(texts), 100):
            some = texts[i : i + 100]
            for kind in (pa.string(), pa.large_string()):
                ids, places = packing.text_ids(pa.array(["not read", *some], kind)[1:], packing.default_path())
                assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    packing._state.clear()


def test_fit_holds_its_features_once():
    """The classifier's fit is one task: besides its features it holds a few bytes of each."""
    draw = np.random.default_rng(6)
    texts, each = 2000, 2000
    bucket = draw.integers(0, 200_000, texts * each).astype(np.int32)
    value, offsets = np.ones(texts * each, np.float32), np.arange(0, texts * each + 1, each)
    tracemalloc.start()
    quality.fit(bucket, value, offsets, draw.integers(0, 3, texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000


def test_workers_drop_what_packing_keeps():
    """A worker is used again: the ids of words go when it takes up a task of another kind."""
    import pyarrow as pa

    for taken in (dealing.released, windows.compact):
        packing.text_ids(pa.array(["some words"]), packing.default_path())
        assert packing._state
        assert not list(taken(lambda batches: batches)(iter([]))) and not packing._state


def test_search_blocks_of_common_terms():
    """Common lists are opened by blocks, not posting by posting, and skipped spans and pivots lose nothing."""
    draw = np.random.default_rng(4)
    vectors = [np.unique(np.minimum(draw.zipf(1.3, draw.integers(5, 80)), 5000).astype(np.uint64), return_counts=True) for _ in range(1500)]
    words = np.array([c.sum() for _, c in vectors], np.float64)
    sizes = np.array([len(t) for t, _ in vectors])
    ids = draw.permutation(len(vectors))
    made = search.Shard(ids, words, sizes, np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors]), words.mean())
    assert len(made.full) and 2 * len(made.doc) < sizes.sum()
    df = dict(zip(*np.unique(np.concatenate([t for t, _ in vectors]), return_counts=True)))
    idf = {t: np.log(1 + (len(ids) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    norm = search.K1 * (1 - search.B + search.B * words / words.mean())
    impacts = [dict(zip(t.tolist(), c * (search.K1 + 1) / (c + k))) for (t, c), k in zip(vectors, norm)]
    for share in (0.0, 0.5, 1.0):  # of the tenth score: none, a low threshold, the highest that loses nothing
        asked, expected = [], []
        for terms, _ in vectors[::15]:
            scores = np.array([sum(idf[t] * v[t] for t in terms.tolist() if t in v) for v in impacts])
            best = [(int(ids[k]), round(float(scores[k]), 6)) for k in np.lexsort([ids, -np.round(scores, 6)])[:10] if scores[k] > 0]
            expected.append(best)
            asked.append((made.places(np.append(terms, np.uint64(9999))), np.array([*(idf[t] for t in terms), 7.0]), share * best[-1][1] if len(best) == 10 else 0.0))
        for (found, scores), best in zip(made.search(asked, 10), expected):
            assert found.tolist() == [i for i, _ in best]
            assert scores.tolist() == pytest.approx([s for _, s in best], abs=2e-6)


def test_search_tasks_multiply_in_one_thread():
    """Threads of several tasks' matrix products would wait for each other: OMP_NUM_THREADS may ask for more."""
    code = "from quarrymill.llm import dealing; dealing.one_thread(); import ctypes, glob, os, numpy; libraries = glob.glob(os.path.join(os.path.dirname(numpy.__file__), '..', 'numpy.libs', '*openblas*')); print([getattr(ctypes.CDLL(x), 'scipy_openblas_get_num_threads64_')() for x in libraries if hasattr(ctypes.CDLL(x), 'scipy_openblas_get_num_threads64_')])"
    said = subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": "4", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}, capture_output=True, text=True, check=True).stdout
    assert set(ast.literal_eval(said)) <= {1}
