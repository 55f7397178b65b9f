"""What must hold at any size is held here on few rows: the plans, not the rows, are what larger tables break."""

from pyspark.sql import functions as F

from fieldfold.operators import spatial
from fieldfold.operators.lineage import checkpoint


def test_exploded_points_are_never_broadcast(spark):
    p = spark.range(50).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("x"), F.lit(0.0).alias("y"))
    pairs = spatial.self_pairs(p, 1.0)
    assert pairs.count() == 49 + 48
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rounds_of_joins_carry_no_estimate(spark):
    """The digits of an estimate that is carried over double with each round."""
    a = checkpoint(spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("v")))
    for _ in range(4):
        a = checkpoint(a.join(a.select("k", F.col("v").alias("w")), "k").select("k", F.col("w").alias("v")))
    assert int(str(a._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**64
    assert sorted(map(tuple, a.collect())) == [(i, i) for i in range(20)]


def test_registration_of_animals_far_apart(spark, tmp_path):
    """Twelve animals at either end of 100,000: turned about a common middle they would move by 9 m."""
    from fieldfold.plans import registry

    e = spark.range(72).select(F.explode(F.array("id", F.col("id") + 600_000)).alias("event_id"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    assert {r.frame_id: r.n for r in registry.cl_registration(spark, str(tmp_path)).collect()} == {f"f{k}": 24 for k in range(6)}
