"""The library's tables, made by fixed rules from general ones: customers, orders and an event stream.

Ids are strings, timestamps instants (the session zone is UTC). A: customers and stream events. B: customers and orders,
day precision. C: a seven-arm ledger over B's customers with order events of two clocks. R: counts of order lines, replicated by priority and half-year.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_trials.operators.assignment import ARMS, BLOCKS, CADENCES, CONTENTS, HOLDOUT, arm_of, assign, ranks
from spark_trials.operators.prospective import OUTCOMES

SEED = 20260908
A_WINDOW, B_WINDOW, C_FOLLOWUP = timedelta(days=7), timedelta(days=180), timedelta(days=365)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str) -> Column:
    return F.lit(f"{text} UTC").cast("timestamp")


A_END, B_END, C_FREEZE = "2024-01-28 00:00:00", "2001-08-02 00:00:00", "1999-01-15 00:00:00"


def _person(key: str) -> Column:
    return F.concat(F.lit("p"), F.col(key).cast("string"))


def _spread(start: str, days: int) -> Column:
    return instant(f"{start} 00:00:00") + F.make_dt_interval(((F.col("c_custkey") * 7) % days).cast("int"))


def _people(spark: SparkSession, sf_dir: str, assigned: Column) -> DataFrame:
    arm = F.when(F.col("c_custkey") % 2 == 0, "control").otherwise("treatment")
    return table(spark, sf_dir, "customer").select(_person("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("experiment"), arm.alias("arm"), assigned.alias("assigned_at"), "c_custkey", "c_acctbal")


def a_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir, _spread("2024-01-03", 20))


def a_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": "opened", "click": "linked", "purchase": "converted", "error": "unsubscribed", "signup": "delivered"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").where((F.col("event_type") != "purchase") | (F.col("value") >= 20))
    return rows.select(_person("user_id").alias("participant_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("event_at"))


def a_exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's cohort with messages_delivered."""
    sent = a_events(spark, sf_dir).where("event_type = 'delivered'").groupBy("participant_id").agg(F.count(F.lit(1)).alias("messages_delivered"))
    return a_cohort(spark, sf_dir).join(sent, "participant_id", "left").fillna(0, ["messages_delivered"])


def a_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream rows with subject and k, the number in ``props``."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(_person("user_id").alias("subject"), k.alias("message"), "event_type", F.col("ts").cast("timestamp").alias("event_at"))


def b_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir, _spread("1998-01-01", 365))


def b_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("O", "opened", "P", "linked", "F", "converted")])[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select(_person("o_custkey").alias("participant_id"), kind.alias("event_type"), F.col("o_orderdate").cast("timestamp").alias("event_at"))


def b_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B's cohort with linked_before_entry and converted_before_entry."""
    cohort, events = b_cohort(spark, sf_dir), b_events(spark, sf_dir)
    early = events.join(cohort.select("participant_id", "assigned_at"), "participant_id").where(F.col("event_at") < F.col("assigned_at"))
    flags = early.groupBy("participant_id").agg(
        F.bool_or(F.col("event_type") == "linked").alias("linked_before_entry"), F.bool_or(F.col("event_type") == "converted").alias("converted_before_entry")
    )
    return cohort.join(flags, "participant_id", "left").fillna(False, ["linked_before_entry", "converted_before_entry"])


def c_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with C's block columns, not trimmed."""
    odd = F.col("c_custkey") % 2
    assigned = F.when(odd == 0, instant("1998-01-01 00:00:00")).otherwise(instant("1998-01-08 00:00:00"))
    return table(spark, sf_dir, "customer").select(
        _person("c_custkey").alias("participant_id"), F.lower("c_mktsegment").alias("lifecycle_segment"),
        F.when(F.col("c_acctbal") < 4500, "0_30d").otherwise("31_90d").alias("tenure_band"),
        F.when(odd == 0, "wave_01").otherwise("wave_02").alias("assignment_wave"), (assigned - F.lit(timedelta(days=1))).alias("eligible_at"), assigned.alias("assigned_at"),
    )


def c_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C's customers, blocks trimmed to a multiple of seven by hash order; blocks under 14 rows are left out."""
    people = c_people(spark, sf_dir)
    sizes = people.groupBy(*BLOCKS).agg((F.floor(F.count(F.lit(1)) / 7) * 7).alias("_keep")).where("_keep >= 14")
    ranked = ranks(people, BLOCKS, F.sha2(F.concat(F.lit("trim|"), "participant_id"), 256))
    return ranked.join(sizes, list(BLOCKS)).where("_rank < _keep").select(*people.columns)


def c_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(c_eligible(spark, sf_dir), seed=SEED, check=False)


def c_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of C's customers, armed by rank over everybody, so that blocks are unequal."""
    people = c_people(spark, sf_dir).withColumn("_all", F.lit(1))
    return ranks(people, ["_all"], F.sha2(F.concat(F.lit("srm|"), "participant_id"), 256), prefix=3).withColumn("arm", arm_of(F.col("_rank")))


def _c_rows(spark: SparkSession, sf_dir: str, ledger: DataFrame) -> DataFrame:
    """C's events with their unit's ``assigned_at``. The join is one of both sides by id at every size, so that what follows, the
    search for repeats and all that is asked by unit, finds the events where they are."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    kind = (
        F.when(F.col("o_orderstatus") == "F", "funded").when((F.col("o_orderstatus") == "O") & urgent, "unsubscribed")
        .when((F.col("o_orderstatus") == "P") & urgent, "complained").when(F.col("o_orderstatus") == "O", "delivered").otherwise("pre_period_engaged")
    )
    at = F.col("o_orderdate").cast("timestamp")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"), _person("o_custkey").alias("participant_id"), kind.alias("event_type"), at.alias("event_at"),
        (at + F.make_dt_interval(hours=(F.col("o_orderkey") % 36).cast("int"))).alias("available_at"), "o_orderkey",
    )
    met = orders.join(ledger.select("participant_id", "arm", "content", "cadence", "assigned_at").hint("merge"), "participant_id")
    delivered, held = F.col("event_type") == "delivered", F.col("arm") == HOLDOUT
    met = met.where(~(delivered & held) | (F.col("o_orderkey") % 40 == 0))
    content = F.when(held, CONTENTS[0]).when(F.col("o_orderkey") % 50 == 0, "challenger_b").otherwise(F.col("content"))
    return met.select(
        "event_id", "participant_id", "event_type", "event_at", "available_at",
        F.when(delivered, content).alias("delivered_content"), F.when(delivered, F.when(held, CADENCES[0]).otherwise(F.col("cadence"))).alias("delivered_cadence"),
        "assigned_at",
    )


def c_events(spark: SparkSession, sf_dir: str, ledger: DataFrame) -> DataFrame:
    """Order events with two clocks, as dirty as they come."""
    return _c_rows(spark, sf_dir, ledger).drop("assigned_at")


def c_clean_events(spark: SparkSession, sf_dir: str, ledger: DataFrame) -> DataFrame:
    """C's events without early outcomes, late rows, mistimed pre-period rows and repeats."""
    e = _c_rows(spark, sf_dir, ledger)
    columns = [c for c in e.columns if c != "assigned_at"]
    before = F.col("event_at") < F.col("assigned_at")
    pre = F.col("event_type") == "pre_period_engaged"
    late = ~before & (F.col("event_at") < F.col("assigned_at") + F.lit(C_FOLLOWUP)) & (F.col("available_at") > instant(C_FREEZE))
    bad = (F.col("event_type").isin(*OUTCOMES.values()) & before) | late | (pre & (~before | (F.col("available_at") > F.col("assigned_at"))))
    kept = e.where(~bad).select(*columns)
    payload = [c for c in columns if c not in ("event_id", "available_at")]
    once = kept.groupBy(*payload).agg(F.min(F.struct("event_id", "available_at")).alias("_first"))
    return once.select(*payload, "_first.*").select(*columns)


def r_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicated counts of order lines: each priority is a scenario, each half-year of shipping a replication, odd and even
    lines are blocks, suppliers are dealt to arms, and four flags of a line are the outcomes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scenario"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    half = F.year("l_shipdate") * 2 + (F.month("l_shipdate") > 6).cast("int")
    flags = (F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.05, F.col("l_quantity") > 45, F.col("l_returnflag") == "R")
    cells = lines.groupBy("scenario", half.cast("long").alias("replication"), (F.col("l_linenumber") % 2).cast("long").alias("block"), (F.col("l_suppkey") % len(ARMS)).alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f"s{k}") for k, f in enumerate(flags)]
    )
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("outcome"), F.col(f"s{k}").alias("successes")) for k in range(len(flags))])
    return cells.select("scenario", "replication", "block", "arm", "n", F.inline(rows))


def r_truth(counts: DataFrame) -> DataFrame:
    """(scenario, arm, true_effect) for outcome 0: the difference of the rates over the units of all replications, a stand-in for a
    known truth."""
    own = counts.where("outcome = 0").groupBy("scenario", "arm").agg((F.sum("successes") / F.sum("n")).alias("rate"))
    base = own.where("arm = 0").select("scenario", F.col("rate").alias("base"))
    return own.where("arm > 0").join(base, "scenario").select("scenario", "arm", (F.col("rate") - F.col("base")).alias("true_effect"))
