import os

import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
CHEAP = ["delta_table", "instability_index", "histogram_build", "classify_group", "auc_overall",
         "nearest_centroid", "dataset_features", "train_test_split", "changepoint_labels"]

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["dataset", "x", "day0_avg", "treated_avg", "delta"]
    assert df.count() == 44


@needs_tables
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracles import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours = contract.queries()[name](spark, SMALL).toPandas()
    assert compare(ours, con.execute(contract.oracle_sql()[name]).df()) == "ok"
