from pyspark.sql import functions as F

from spark_trials.plans import adapters as ad


def test_events_meet_their_ledger_once(spark, tmp_path):
    """Clean events come from one join with the ledger, by id, and their repeats are found where that join leaves them."""
    at = F.timestamp_seconds(F.lit(883612800))
    spark.range(5).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority"), at.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    ledger = spark.range(1, 2).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("participant_id"), F.lit("holdout").alias("arm"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("cadence"), at.alias("assigned_at"))
    made = ad.c_clean_events(spark, str(tmp_path), ledger)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
    assert [r["event_id"] for r in made.collect()] == ["o0"]
