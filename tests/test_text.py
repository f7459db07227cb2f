from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators.passages import audit, chunk_documents


def value(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()], F.lit(0).alias("_")).select(column).first()[0]


def words(chunks):
    return [len(c.split()) for c in chunks]


def test_repeated_sentence_stays_within_bounds(spark):
    text = " ".join(["This sentence has exactly eleven words in it for the test."] * 30)
    assert all(50 <= n <= 100 for n in words(value(spark, T.chunk_text("t", 50, 100), t=text)))


def test_short_text_is_one_chunk(spark):
    assert value(spark, T.chunk_text("t", 50, 100), t="A short text. It stays whole.") == ["A short text. It stays whole."]


def test_long_sentence_is_cut(spark):
    text = " ".join(f"word{i}" for i in range(220))
    assert words(value(spark, T.chunk_text("t", 20, 100), t=text)) == [100, 100, 20]


def test_closing_quote_goes_with_the_break(spark):
    assert value(spark, T.sentences("t"), t='He said "go." Then left. (Maybe) not.') == ['He said "go.', "Then left.", "(Maybe) not."]


def test_tail_merges_or_takes_units(spark):
    s = lambda n, k: " ".join([f"W{k}"] + ["x"] * (n - 1)) + "."
    merged = value(spark, T.chunk_text("t", 5, 20), t=f"{s(12, 1)} {s(5, 2)} {s(3, 3)}")
    assert words(merged) == [20]
    moved = value(spark, T.chunk_text("t", 8, 20), t=f"{s(9, 1)} {s(9, 2)} {s(4, 3)}")
    assert words(moved) == [9, 13]


def test_bounds_must_be_ordered(spark):
    import pytest

    with pytest.raises(ValueError):
        T.chunk_text("t", 10, 5)


def test_shingles_and_similarity(spark):
    assert value(spark, T.char_shingles("t"), t="Abc") == ["abc"]
    assert value(spark, T.char_shingles("t"), t="  ") == []
    assert value(spark, F.size(T.char_shingles("t")), t="abcdefghij") == 3
    assert value(spark, T.jaccard(F.split("a", " "), F.split("b", " ")), a="x y z", b="y z w") == 0.5
    assert value(spark, T.length_similarity("a", "b"), a=0, b=5) == 0.0
    assert value(spark, T.word_tolerance("a"), a=250) == 25
    assert value(spark, T.word_tolerance("a"), a=245) == 24  # halves to even


def test_list_pages_and_variants(spark):
    assert value(spark, T.is_list_page("a", "b"), a="List of things", b="x")
    assert value(spark, T.is_list_page("a", "b"), a="Thing", b="Thing may refer to: one")
    assert not value(spark, T.is_list_page("a", "b"), a="Thing", b="A thing.")
    assert value(spark, T.query_variants(F.split("a", ","), "b"), a="x,y", b="x") == ["x y", "x", "y"]
    assert value(spark, T.distinct_terms(F.split("a", ",")), a="cat,cats,dog,do,hen") == ["cat", "dog", "hen"]


def test_chunking_skips_rows_without_id_or_text(spark):
    rows = [("a", "One two. " * 40), ("a", "One two. " * 40), (None, "x " * 60), ("b", None), ("c", "short")]
    df = spark.createDataFrame(rows, "document_id string, text string")
    got = chunk_documents(df, 50, 200)
    assert [(r["document_id"], r["word_count"]) for r in got.collect()] == [("a", 80)]
    counted = audit(df, id_column="document_id").first()
    assert (counted["records"], counted["missing_id"], counted["missing_text"], counted["duplicate_ids"]) == (5, 1, 1, 1)
