import random
from datetime import timedelta

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spark_trials.operators import funnel, outcomes, units
from spark_trials.operators.contracts import ContractError

WEEK = timedelta(days=7)
#: What a job that fails raises; the second where more than one stage did.
FAILURES = (PySparkException, Py4JJavaError)


def at(text):
    return F.lit(f"{text} 00:00:00 UTC").cast("timestamp")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(
        *[F.to_timestamp(n).alias(n) if t == "timestamp" else F.col(n) for n, t in (c.strip().split(" ") for c in schema.split(","))]
    )


def test_window_and_censoring(spark):
    a = table(spark, [("01", "treatment", "2026-01-01"), ("02", "control", "2026-01-01"), ("03", "treatment", "2026-01-02")], "participant_id string, arm string, assigned_at timestamp")
    e = table(
        spark,
        [("01", "converted", "2025-12-31"), ("01", "converted", "2026-01-03"), ("02", "converted", "2026-01-08"), ("02", "opened", "2026-01-02"), ("03", "converted", "2026-01-03")],
        "participant_id string, event_type string, event_at timestamp",
    )
    for parts in (1, 7):
        out = outcomes.windowed_outcome(a.repartition(parts), e.repartition(parts), window=WEEK, observation_end=at("2026-01-08"))
        rows = {r["participant_id"]: r for r in out.collect()}
        assert (rows["01"]["outcome"], rows["01"]["has_pre_assignment_outcome"]) == (True, True)
        assert rows["02"]["outcome"] is False  # exactly at the end of the half-open window
        assert rows["03"]["outcome"] is None and rows["03"]["first_outcome_at"] is not None and not rows["03"]["followup_complete"]
    rates = {r["arm"]: r["complete_rate"] for r in outcomes.censoring_summary(out).collect()}
    assert rates == {"treatment": 0.5, "control": 1.0}
    flow = outcomes.population_flow(out.withColumn("x", F.lit(False)), excluded="x").first()
    assert (flow["assigned"], flow["pre_existing"], flow["pre_assignment"], flow["censored"], flow["analyzed"]) == (3, 0, 1, 1, 1)
    assert outcomes.analysis_set(out.withColumn("x", F.lit(False)), excluded="x").count() == 1
    with pytest.raises(ContractError):
        outcomes.windowed_outcome(a, e, window=timedelta(0), observation_end=at("2026-01-08"))


EVENTS = [
    ("01", "opened", "2026-01-01 01:00"), ("01", "linked", "2026-01-01 00:30"), ("01", "linked", "2026-01-01 03:00"), ("01", "converted", "2026-01-01 04:00"),
    ("02", "linked", "2026-01-01 02:00"), ("03", "opened", "2026-01-01 01:00"), ("03", "linked", "2026-01-01 01:00"), ("04", "opened", "2025-12-31 23:00"),
]
STAGES = ("opened", "linked", "converted")


def test_strict_funnel(spark):
    e = table(spark, EVENTS, "participant_id string, event_type string, event_at timestamp")
    cohort = table(spark, [(k, "2026-01-01 00:00") for k in ("01", "02", "03", "04", "05")], "participant_id string, assigned_at timestamp")
    out = funnel.funnel_membership(e, STAGES, cohort=cohort)
    rows = {r["participant_id"]: r for r in out.collect()}
    assert rows["01"]["linked_at"].hour == 3 and rows["01"]["converted_reached"]
    assert not rows["02"]["opened_reached"] and not rows["02"]["linked_reached"]
    assert rows["03"]["opened_reached"] and not rows["03"]["linked_reached"]  # the same time is not after
    assert not rows["04"]["opened_reached"] and not rows["05"]["opened_reached"]  # before entry; no events
    got = [(r["users"], r["rate_from_previous"]) for r in funnel.funnel_summary(out, STAGES).orderBy("position").collect()]
    assert got == [(2, 0.4), (1, 0.5), (1, 1.0)]
    assert funnel.funnel_membership(e, STAGES).count() == 4
    assert funnel.funnel_summary(out.limit(0), STAGES).where("rate_from_population is not null").count() == 0
    assert not {r["participant_id"]: r for r in funnel.funnel_membership(e, STAGES, cohort=cohort, day_gap=1).collect()}["01"]["linked_reached"]
    with pytest.raises(ContractError):
        funnel.funnel_membership(e, ("opened", "opened"))


def test_new_link_funnel(spark):
    e = table(spark, EVENTS, "participant_id string, event_type string, event_at timestamp").where("participant_id in ('01', '02', '03')")
    cohort = table(spark, [("01", "2026-01-01", False, False), ("02", "2026-01-01", True, False), ("03", "2026-01-01", False, True)], "participant_id string, assigned_at timestamp, linked_before_entry boolean, converted_before_entry boolean")
    assert [r["participant_id"] for r in funnel.new_link_funnel(e, cohort, STAGES).collect()] == ["01"]
    with pytest.raises(ContractError):
        funnel.new_link_funnel(e, cohort.withColumn("linked_before_entry", F.lit(None).cast("boolean")), STAGES)


def test_exposure_risk(spark):
    cohort = spark.createDataFrame([("a", "control", 3), ("b", "control", 2), ("c", "treatment", 4), ("d", "treatment", 0)], "participant_id string, arm string, messages_delivered long")
    e = spark.createDataFrame([("a", "unsubscribed"), ("a", "unsubscribed"), ("b", "opened")], "participant_id string, event_type string")
    rows = {r["arm"]: r for r in funnel.exposure_risk(cohort, e).collect()}
    assert (rows["control"]["unique_user_risk"], rows["control"]["events_per_1000_deliveries"]) == (0.5, 400.0)
    assert (rows["treatment"]["actual_recipients"], rows["treatment"]["unique_user_risk"]) == (1, 0.0)
    for bad, says in (
        (lambda: funnel.exposure_risk(cohort, e.union(spark.createDataFrame([("d", "unsubscribed")], e.schema))), "event_without_exposure: 1"),
        (lambda: funnel.exposure_risk(cohort.withColumn("messages_delivered", F.lit(-1)), e), "messages_delivered_negative"),
        (lambda: funnel.exposure_risk(cohort.union(cohort.where("participant_id = 'a'")), e), "repeated_id: 2"),
        (lambda: funnel.exposure_risk(cohort.withColumn("participant_id", F.nullif("participant_id", F.lit("b"))), e), "missing participant_id"),
        (lambda: funnel.exposure_risk(cohort.withColumn("arm", F.lit(None).cast("string")), e), "group_missing"),
    ):
        with pytest.raises(FAILURES, match=says):
            bad().collect()


def test_gap_outcomes(spark):
    a = table(spark, [("a", "t", "2026-01-01"), ("b", "t", "2026-01-01")], "participant_id string, arm string, eligible_at timestamp")
    e = table(spark, [("a", "converted", "2026-01-02"), ("a", "delivered", "2026-01-03"), ("b", "converted", "2026-01-02"), ("b", "delivered", "2026-01-02")], "participant_id string, event_type string, event_at timestamp")
    row = outcomes.gap_outcomes(a, e).first()
    assert (row["participants"], row["participants_with_gap_outcome"], row["gap_outcome_events"]) == (2, 1, 1)


def test_unknown_ids_and_naive_times_fail(spark):
    people = spark.sql("select 'a' as participant_id, 't' as arm, 1 as messages_delivered, timestamp '2024-01-01 00:00:00' as assigned_at")
    events = spark.sql("select * from values ('a', 'converted', timestamp '2024-01-02 00:00:00'), ('z', 'converted', timestamp '2024-01-02 00:00:00') as t(participant_id, event_type, event_at)")
    known = events.where("participant_id = 'a'")
    end = F.lit("2024-02-01 00:00:00 UTC").cast("timestamp")
    window = {"window": timedelta(days=7), "observation_end": end}
    assert outcomes.windowed_outcome(people, known, **window).first()["outcome"]
    assert outcomes.windowed_outcome(people, events, fail_on_orphan_events=False, **window).count() == 1
    assert funnel.funnel_membership(events, ["converted"], cohort=people, fail_on_orphan_events=False).count() == 1
    assert funnel.exposure_risk(people, known, event="converted").first()["unique_people"] == 1
    for made in (lambda: outcomes.windowed_outcome(people, events, **window), lambda: funnel.funnel_membership(events, ["converted"], cohort=people)):
        with pytest.raises(FAILURES, match="rows_of_unknown_participants: 1"):
            made().collect()
    with pytest.raises(FAILURES, match="unknown_participant: 1"):
        funnel.exposure_risk(people, events, event="converted").collect()
    naive = known.withColumn("event_at", F.col("event_at").cast("timestamp_ntz"))
    for made in (lambda: outcomes.windowed_outcome(people, naive, **window), lambda: funnel.funnel_membership(naive, ["converted"], cohort=people)):
        with pytest.raises(ContractError, match="timezone"):
            made()


ASSIGNED = "participant_id string, arm string, assigned_at timestamp"
SEEN = "participant_id string, event_type string, event_at timestamp"


def test_repeated_and_missing_ids_fail(spark):
    """An id assigned on two days, with or without events, and ids that lack, on either side."""
    twice = table(spark, [("a", "t", "2026-01-01"), ("a", "t", "2026-01-20"), ("b", "t", "2026-01-01")], ASSIGNED)
    gone = table(spark, [("a", "t", "2026-01-01"), (None, "t", "2026-01-02")], ASSIGNED)
    once = table(spark, [("a", "t", "2026-01-01"), ("b", "t", "2026-01-01")], ASSIGNED)
    e = table(spark, [("a", "converted", "2026-01-02")], SEEN)
    lost = e.union(table(spark, [(None, "converted", "2026-01-03")], SEEN))
    jobs = (
        lambda people, events: outcomes.windowed_outcome(people, events, window=WEEK, observation_end=at("2026-03-01")),
        lambda people, events: funnel.funnel_membership(events, ["converted", "linked"], cohort=people),
        lambda people, events: funnel.new_link_funnel(events, people.withColumns({c: F.lit(False) for c in ("linked_before_entry", "converted_before_entry")}), ["converted"]),
        lambda people, events: funnel.exposure_risk(people.withColumn("messages_delivered", F.lit(1)), events, event="converted"),
    )
    for job in jobs:
        assert job(once, e).count() > 0
        for people, events, says in ((twice, e, "repeated_id: 2"), (twice, e.limit(0), "repeated_id: 2"), (gone, e, "missing participant_id"), (once, lost, "missing participant_id")):
            with pytest.raises(FAILURES, match=says):
                job(people, events).collect()
    passed = outcomes.windowed_outcome(once, lost, window=WEEK, observation_end=at("2026-03-01"), fail_on_orphan_events=False)
    assert passed.where("outcome").count() == 1


def test_checks_read_the_events_once(spark, tmp_path):
    """The plan has one scan of the events for each join with them, and funnels have no window."""
    e = table(spark, [("a", "converted", "2026-01-02"), ("a", "linked", "2026-01-03")], SEEN)
    e.write.parquet(str(tmp_path / "e"))
    people = table(spark, [("a", "t", "2026-01-01")], ASSIGNED)
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = outcomes.windowed_outcome(people, events, window=WEEK, observation_end=at("2026-03-01"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    plan = funnel.funnel_membership(events, ["converted", "linked"], cohort=people)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_a_hot_id_is_spread(spark):
    """One id has a third of all events; its events meet its unit where they lie, and results are those of plain loops."""
    rng = random.Random(4)
    people = [(f"p{k}", "t", f"2026-01-{1 + k % 9:02d} 00:00") for k in range(30)]
    rows = [(rng.choice(people)[0] if k % 3 else "p7", rng.choice(STAGES), f"2026-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00") for k in range(900)]
    cohort, e = table(spark, people, ASSIGNED), table(spark, rows, SEEN)
    want = {}
    for who, _, entry in people:
        own, last = sorted((t, s) for p, s, t in rows if p == who and t >= entry), ""
        for s in STAGES:
            last = next((t for t, kind in own if kind == s and t > last), None) if last is not None else None
            want[who, s] = last
    assert units.hot_ids(e, "participant_id", rows=250) == ["p7"] and units.hot_ids(e, "participant_id", rows=None) == []
    for hot_rows in (250, 10, None):  # the one id; all of them; none
        made = funnel.funnel_membership(e, STAGES, cohort=cohort, hot_rows=hot_rows).collect()
        assert {(r["participant_id"], s): r[f"{s}_at"] and f"{r[f'{s}_at']:%Y-%m-%d %H:%M}" for r in made for s in STAGES} == want
        found = outcomes.windowed_outcome(cohort, e, window=WEEK, observation_end=at("2026-03-01"), hot_rows=hot_rows).collect()
        for r in found:
            entry = next(t for p, _, t in people if p == r["participant_id"])
            stop = f"2026-01-{int(entry[8:10]) + 7:02d} 00:00"
            assert r["outcome"] == any(p == r["participant_id"] and s == "converted" and entry <= t < stop for p, s, t in rows)
    plan = outcomes.windowed_outcome(cohort, e, window=WEEK, observation_end=at("2026-03-01"), hot_rows=60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan
    naive = funnel.funnel_membership(e, STAGES, hot_rows=250)
    assert naive.count() == len({p for p, _, _ in rows})
