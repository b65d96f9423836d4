from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spark_trials.operators import outcomes
from spark_trials.operators.contracts import ContractError
from spark_trials.sources import report, shared, tables

T = tables.T


def test_typed_files_are_held_to_the_declared_types(spark, tmp_path):
    rows = spark.sql("select 'a' as participant_id, 'converted' as event_type, timestamp '2026-01-01 00:00:00' as event_at")
    kept = {"string": rows.withColumn("event_at", F.col("event_at").cast("string")), "naive": rows.withColumn("event_at", F.col("event_at").cast("timestamp_ntz")), "good": rows}
    for name, df in kept.items():
        df.write.parquet(str(tmp_path / name))
    assert tables.read(spark, str(tmp_path / "good"), tables.EVENTS).count() == 1
    for name, says in (("string", "event_at: string, not timestamp"), ("naive", "event_at: timestamp_ntz, not timestamp")):
        with pytest.raises(ContractError, match=says):
            tables.read(spark, str(tmp_path / name), tables.EVENTS)
    spark.sql("select 's' as scenario, 1 as replication, 2 as outcome, 3 as block, 4 as arm, 5 as n, cast(6 as short) as successes").write.parquet(str(tmp_path / "narrow"))
    made = tables.read(spark, str(tmp_path / "narrow"), tables.REPLICATED_COUNTS)
    assert {f.name: f.dataType for f in made.schema} == {f.name: f.dataType for f in tables.REPLICATED_COUNTS}
    assert made.first()["successes"] == 6


CSV = """participant_id,event_type,event_at
a,opened,2026-01-01T00:00:00Z
b,opened,2026-01-01T00:00:00
c,opened,soon
,opened,2026-01-01T02:00:00+02:00
e,opened
f,opened,2026-01-01T02:00:00+02:00
"""


def test_rejects_of_text(spark, tmp_path):
    (tmp_path / "e.csv").write_text(CSV)
    rows, rejects = tables.read_with_rejects(spark, str(tmp_path / "e.csv"), tables.EVENTS, "csv")
    assert {r["participant_id"]: r["event_at"].hour for r in rows.collect()} == {"a": 0, "f": 0} and [f.dataType for f in rows.schema] == [f.dataType for f in tables.EVENTS]
    assert {r["reason"]: r["rows"] for r in tables.reject_counts(rejects).collect()} == {"event_at_naive": 1, "event_at_invalid": 1, "participant_id_missing": 1, "malformed": 1}
    lax, _ = tables.read_with_rejects(spark, str(tmp_path / "e.csv"), tables.EVENTS, "csv", required=[])
    assert lax.count() == 3
    lines = ['{"scenario": "s", "replication": 1, "outcome": "x", "block": 1, "arm": 1, "n": 2.5, "successes": 1}', '{"scenario": "s", "replication": 1, "outcome": 0, "block": 1, "arm": 1, "n": 2, "successes": 1}', "{broken"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    rows, rejects = tables.read_with_rejects(spark, str(tmp_path / "r.json"), tables.REPLICATED_COUNTS, "json")
    assert rows.first()["n"] == 2 and rows.count() == 1
    found = {(*sorted(r["reasons"]),) for r in rejects.collect()}
    assert ("malformed",) in found and any("outcome_invalid" in r for r in found)
    with pytest.raises(ContractError):
        tables.read_with_rejects(spark, str(tmp_path / "r.json"), tables.EVENTS, "parquet")


def test_a_time_range_opens_its_days_alone(spark, tmp_path):
    start = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    events = spark.createDataFrame([(f"p{k}", "opened", start + timedelta(days=k)) for k in range(20)], "participant_id string, event_type string, event_at timestamp")
    tables.write_events(events, str(tmp_path / "e"))
    people = spark.createDataFrame([("p1", start + timedelta(days=4)), ("p2", start + timedelta(days=6))], "participant_id string, assigned_at timestamp")
    bounds = tables.window_bounds(people, timedelta(days=3), before=timedelta(days=1))
    assert bounds == {"since": start + timedelta(days=3), "until": start + timedelta(days=9)}
    made = tables.read_events(spark, str(tmp_path / "e"), tables.EVENTS, **bounds)
    assert sorted(r["participant_id"] for r in made.collect()) == [f"p{k}" for k in range(3, 9)]  # the end itself is outside
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "2026-01-04" in plan and "2026-01-10" in plan
    opened = {r[0] for r in made.select(F.input_file_name()).distinct().collect()}
    assert len(opened) == 6 and all("event_date=2026-01-" in name for name in opened)
    assert tables.read_events(spark, str(tmp_path / "e"), tables.EVENTS).count() == 20
    assert tables.window_bounds(people.limit(0), timedelta(days=3)) == {"since": None, "until": None}
    events.withColumn("event_date", F.lit("x")).write.parquet(str(tmp_path / "odd"))
    with pytest.raises(ContractError, match="event_date: string"):
        tables.read_events(spark, str(tmp_path / "odd"), tables.EVENTS)


def test_canonical_documents(spark):
    df = spark.createDataFrame([("b", 0.1 + 0.2, 2, True, None), ('a"\\', -1e-12, 10, None, ["x", "y"]), ("c", float("inf"), 1, False, [])], "k string, v double, n int, ok boolean, l array<string>")
    assert report.document({"z": df, "a": df.limit(0)}, digits=9).first()["report"] == (
        '{"a":[],"z":[{"k":"a\\"\\\\","l":["x","y"],"n":10,"ok":null,"v":0.000000000},{"k":"b","l":null,"n":2,"ok":true,"v":0.300000000},{"k":"c","l":[],"n":1,"ok":false,"v":null}]}'
    )
    assert report.document({"z": df.repartition(7).orderBy(F.desc("k"))}, digits=9).first() == report.document({"z": df}, digits=9).first()
    assert '"v":0.30000000000000004' in report.records(df).where("record like '%\"b\"%'").first()["record"]


def test_a_new_shared_folder_each_time(spark):
    a, b = (shared.folder(spark, "x") for _ in range(2))
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_gap_sensitivity(spark):
    day = lambda d: datetime(2026, 1, d, tzinfo=timezone.utc)
    people = spark.createDataFrame([(p, "t", day(1), day(3)) for p in "abcd"], "participant_id string, arm string, eligible_at timestamp, assigned_at timestamp")
    rows = [
        ("a", "converted", day(4)), ("a", "delivered", day(5)),  # in the gap alone
        ("b", "converted", day(4)), ("b", "delivered", day(5)), ("b", "converted", day(6)),  # in the gap, and once more after it
        ("c", "converted", day(4)),  # never delivered: no gap
        ("d", "converted", day(2)), ("d", "delivered", day(2)), ("d", "delivered", day(9)),  # at the first delivery, and before assignment
    ]
    events = spark.createDataFrame(rows, "participant_id string, event_type string, event_at timestamp")
    for hot_rows in (None, 1):
        made = outcomes.gap_sensitivity(people, events, window=timedelta(days=7), observation_end=F.lit(day(20)), hot_rows=hot_rows).collect()
        got = {(r["participant_id"], r["analysis"]): (r["outcome"], r["gap_outcome_events"]) for r in made}
        assert got == {
            ("a", "all_outcomes"): (True, 1), ("a", "without_gap"): (False, 1), ("b", "all_outcomes"): (True, 1), ("b", "without_gap"): (True, 1),
            ("c", "all_outcomes"): (True, 0), ("c", "without_gap"): (True, 0), ("d", "all_outcomes"): (False, 0), ("d", "without_gap"): (False, 0),
        }
    censored = outcomes.gap_sensitivity(people, events, window=timedelta(days=7), observation_end=F.lit(day(8)))
    assert censored.where("outcome is not null or followup_complete").count() == 0
