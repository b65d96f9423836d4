from pyspark.sql import functions as F

from spark_trials.operators import funnel


def test_a_round_is_one_join(spark):
    """What a task holds is linear in the stages: a join and an aggregate in its order for each, also where only counts are read.
    Rounds that made the ones before them again had three joins for one stage."""
    stages = ("opened", "linked", "converted", "left")
    events = spark.range(100).select(F.concat(F.lit("p"), F.col("id") % 10).alias("participant_id"), F.element_at(F.array(*map(F.lit, stages)), (F.col("id") % 4 + 1).cast("int")).alias("event_type"), F.timestamp_seconds("id").alias("event_at"))
    cohort = spark.range(10).select(F.concat(F.lit("p"), "id").alias("participant_id"), F.timestamp_seconds(F.lit(0)).alias("assigned_at"), "id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (1, 3, 4):
            made = funnel.funnel_membership(events, stages[:n], cohort=cohort, hot_rows=None)
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == n
            summary = funnel.funnel_summary(made, stages[:n])._jdf.queryExecution().executedPlan().toString()
            assert summary.count("SortMergeJoin") == n and summary.count("SortAggregate") >= n
            assert made.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
