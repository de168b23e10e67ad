"""Cells that lie on one another: more customers than the plane of the given keys has positions."""
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from check_queries import normal


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """48 cells on 8 positions: keys that differ by 1009 * 997 share one."""
    folder, rng = tmp_path_factory.mktemp("shared"), np.random.default_rng(5)
    keys = np.array([p + 1 + 3 * c * 1009 * 997 for p in range(8) for c in range(6)])
    brands, types = [f"Brand#{i}" for i in range(1, 23)], ["T1", "T2", "T3"]
    part = pd.DataFrame({"p_partkey": range(len(brands) * len(types)), "p_brand": np.repeat(brands, len(types)), "p_type": types * len(brands),
                         "p_size": np.arange(len(brands) * len(types), dtype=np.int32) % 20 + 1})
    lines = pd.DataFrame({"l_orderkey": np.repeat(np.arange(len(keys)), 30), "l_partkey": rng.integers(0, len(part), len(keys) * 30),
                          "l_quantity": rng.integers(1, 50, len(keys) * 30).astype(float), "l_extendedprice": rng.random(len(keys) * 30) * 100 + 1})
    every = pd.DataFrame({"l_orderkey": np.repeat(np.arange(len(keys)), 3), "l_partkey": np.tile([0, 1, 2], len(keys)), "l_quantity": 1.0, "l_extendedprice": 5.0})
    made = {"customer": pd.DataFrame({"c_custkey": keys, "c_nationkey": np.zeros(len(keys), np.int32), "c_acctbal": 1.0, "c_mktsegment": "BUILDING"}),
            "orders": pd.DataFrame({"o_orderkey": np.arange(len(keys)), "o_custkey": keys}), "lineitem": pd.concat([lines, every]), "part": part}
    for name, rows in made.items():
        rows.to_parquet(folder / f"{name}.parquet", index=False)
    return folder


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else normal(v)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["AGG_32_ligand_receptor_score", "ML_05_ligand_receptor", "ML_02_row_stochastic_graph"])
def test_statistics_equal_sql_where_cells_share_positions(spark, tables, name):
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part"):
        db.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    found = entry.queries()[name](spark, str(tables))
    cursor = db.execute(entry.oracle_sql()[name])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows([d[0] for d in cursor.description], cursor.fetchall())


def test_multimodal_baseline_where_cells_share_positions(spark, tables):
    keys = {int(k) for k in pd.read_parquet(tables / "customer.parquet")["c_custkey"] if k % 3}
    rows = entry.queries()["ML_10_spatial_multimodal"](spark, str(tables)).toPandas()
    assert len(keys) == 36 and all(set(r["cell_id"]) == keys and np.isfinite(np.stack(r["embedding"])).all() for _, r in rows.groupby("representation"))
    assert set(rows["representation"]) == {"rna_only", "protein_only", "joint"}
