"""A cross-section of the registered queries against their SQL at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, table

PATH = "/root/testdata/sf0.001"
CHOSEN = ["ML_20_neighbourhood_comparison", "AGG_02_neighbour_enrichment", "ML_18_frozen_plan", "FLT_03_attribute_compare", "REV_03_apply_delta", "AGG_09_region_contrast",
          "AGG_10_quality_fields", "AGG_15_spearman", "AGG_18_density_pyramid", "ML_01_adaptive_graph", "ML_13_welch", "VAL_01_observation_contract", "SRC_01_matrix_market"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, PATH)
    cursor = db.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert row["before_directed_source_edges"] > 0 and row["status"] in ("stable", "changed", "indeterminate")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
