import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["m03_fpr_interp_ties", "w02_percent_rank", "g01_duplicate_audit", "j08_hamming_self_join", "b01_prevalence_bootstrap", "r01_component_acceptance", "r10_floor_rule", "e12_variance_explained", "i05_crop_box", "j08_either_hash", "v04_eight_checks", "s10_tiff_stack"])
def test_queries_match_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda rows: sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert tidy([r[c] for c in columns] for r in got.collect()) == tidy([dict(zip(want.columns, r))[c] for c in columns] for r in want.fetchall())


@pytest.mark.parametrize("name, rows", [("p14_permutation", "SELECT count(*) FROM orders"), ("o03_multi_key", "SELECT count(DISTINCT o_custkey) FROM orders")])
def test_whole_tables_are_ranked(spark, name, rows):
    test_queries_match_sql(spark, name)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    assert entry.queries()[name](spark, SF).count() == con.sql(rows).fetchall()[0][0]


@pytest.mark.parametrize("name, rows", [("k05_ordered_list", "SELECT count(DISTINCT user_id) FROM events"), ("s16_array_files", "SELECT sum(len(embedding)) FROM embeddings"), ("s15_log_segments", "SELECT count(DISTINCT user_id) FROM events")])
def test_whole_tables_and_arrays_are_read(spark, name, rows):
    test_queries_match_sql(spark, name)
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert entry.queries()[name](spark, SF).count() == con.sql(rows).fetchall()[0][0]
