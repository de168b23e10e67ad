"""Permutation tables: their plan sends no replicates through the driver."""
from cellweave.operators import ranking


def test_replicates_are_not_broadcast(spark):
    ids = spark.range(50).withColumnRenamed("id", "cell_id")
    out = ranking.permutations(ids, 20, 3)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan.split("Window")[0]
    rows = out.collect()
    assert len(rows) == 21 * 50
    assert all(sorted(r["from_id"] for r in rows if r["perm"] == p) == list(range(50)) for p in range(21))
