"""The raw count query on cells that have no count, or only damaged ones, against its SQL."""
import duckdb

import __spark_entry__ as entry


def test_cells_without_an_intact_count(spark, tmp_path):
    tables = {
        "customer": "select * from (values (1,7,'A',1.0),(2,7,'A',1.0),(3,1,'A',1.0),(4,1,'A',1.0),(5,1,'A',1.0),(6,7,'A',1.0)) v(c_custkey,c_nationkey,c_mktsegment,c_acctbal)",
        "orders": "select * from (values (1,1),(3,3),(4,4)) v(o_orderkey,o_custkey)",  # no order: 2 and 6 in region n7, 5 outside
        "part": "select * from (values (1,'Brand#12'),(2,'Brand#11'),(3,'Brand#13')) v(p_partkey,p_brand)",
        "lineitem": "select * from (values (1,3,2.0),(3,1,2.0),(4,2,2.0)) v(l_orderkey,l_partkey,l_quantity)"}  # 3 has Brand#12 only
    db = duckdb.connect()
    for name, sql in tables.items():
        db.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = sorted(map(tuple, entry.queries()["VAL_02_raw_counts"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(entry.oracle_sql()["VAL_02_raw_counts"]).fetchall()) == [("not_an_exact_count", 2), ("zero_library", 3)]
