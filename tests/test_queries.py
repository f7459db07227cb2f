"""A selection of queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

from quarrymill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["b7_rebalanced", "b10_passages", "b12_page_strata", "e1_split_summary", "f6_threshold", "f7_slices", "d7_nearest_lengths", "j4_component_splits", "j5_components", "j10_hybrid", "j14_combined", "g10_keyphrases", "g17_greedy_matches", "h1_tfidf", "i3_signed_rank", "j13_combined", "j14_combined_pure", "j16_leakage", "j17_experiment_checks", "a14_stored_model", "h8_fixed_cross_evaluation", "h13_result_matrix", "g13_candidate_pool", "d14_near_duplicates"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    expected = con.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert got == sorted(expected.select(",".join(f'"{c}"' for c in columns)).fetchall(), key=key)


def test_every_query_has_a_name_and_most_have_sql():
    names, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 100
