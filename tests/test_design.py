from datetime import datetime, timedelta
from math import erfc, sqrt

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spark_trials.operators import assignment as asg
from spark_trials.operators import decision as dec
from spark_trials.operators import effects as eff
from spark_trials.operators import prospective as pro
from spark_trials.operators import replication as rep
from spark_trials.operators.contracts import ContractError
from spark_trials.sources import report, tables

T0 = datetime(2026, 1, 5)
def freeze():
    return F.lit("2026-03-01 00:00:00 UTC").cast("timestamp")



@pytest.fixture(scope="module")
def eligible(spark):
    rows = []
    for b in range(8):
        for k in range(28):
            rows.append((f"u{b}_{k:03d}", f"s{b % 2}", f"t{b // 2 % 2}", f"w{b // 4}", T0 - timedelta(days=1), T0 + timedelta(days=b // 4)))
    return spark.createDataFrame(rows, tables.ELIGIBLE).cache()


@pytest.fixture(scope="module")
def ledger(eligible):
    return asg.assign(eligible, seed=7).cache()


def labels(df):
    return {r["participant_id"]: r["arm"] for r in df.select("participant_id", "arm").collect()}


def test_assignment_is_exact_and_free_of_row_order(eligible, ledger):
    asg.validate_ledger(ledger)
    assert asg.exact_allocation(ledger).where("least = 4 and greatest = 4 and exact").count() == 8
    mixed = asg.assign(eligible.orderBy(F.desc("participant_id")).repartition(13), seed=7)
    assert labels(mixed) == labels(ledger) != labels(asg.assign(eligible, seed=8))
    assert asg.ledger_digest(mixed).first() == asg.ledger_digest(ledger).first() != asg.ledger_digest(asg.assign(eligible, seed=8)).first()
    ratio = asg.sample_ratio(ledger).collect()
    assert len(ratio) == 9 and all(r["p_value_holm"] == 1.0 and r["passed"] for r in ratio)
    with pytest.raises(ContractError, match="1 blocks"):
        asg.assign(eligible.where("participant_id <> 'u0_000'"), seed=7)


def test_ledger_faults(ledger):
    swap = F.when(F.col("participant_id").startswith("u0") & (F.col("arm") == "holdout"), "current__daily").otherwise(F.col("arm"))
    moved = asg.with_factors(ledger.withColumn("arm", swap)).select(*asg.LEDGER)
    with pytest.raises(ContractError, match="1 blocks"):
        asg.validate_ledger(moved)
    bad = ledger.withColumn("expected_probability", F.lit(0.2))
    with pytest.raises(ContractError, match="probability_not_equal_share: 224"):
        asg.validate_ledger(bad)
    with pytest.raises(ContractError, match="holdout_with_factors: 32"):
        asg.validate_ledger(ledger.withColumns({"content": F.coalesce("content", F.lit("current"))}))


def events_of(spark, rows):
    out = []
    for k, (who, kind, days, late, content, cadence) in enumerate(rows):
        at = T0 + timedelta(days=days)
        out.append((f"e{k}", who, kind, at, at + timedelta(days=late), content, cadence))
    return spark.createDataFrame(out, tables.PROSPECTIVE_EVENTS)


def test_event_contract(spark, ledger):
    good = events_of(spark, [("u0_000", "funded", 1, 0.1, None, None)])
    assert pro.event_violations(ledger, good).where("violations > 0").count() == 0
    rows = [("u0_000", "funded", 1, -1, None, None), ("u0_001", "other", 1, 0, None, None), ("nobody", "funded", 1, 0, None, None), ("u0_002", "delivered", 1, 0, None, "daily"), ("u0_003", "funded", 1, 0, "current", None)]
    rows += [("u0_004", "funded", 2, 0, None, None)] * 2
    found = {r["rule"]: r["violations"] for r in pro.event_violations(ledger, events_of(spark, rows)).where("violations > 0").collect()}
    assert found == {"arrives_before_it_happens": 1, "unknown_type": 1, "orphan_participant": 1, "delivery_without_factors": 1, "factors_without_delivery": 1, "duplicate_payload": 2}


def test_audits_and_frame(spark, ledger):
    arms = labels(ledger)
    held = next(k for k, a in sorted(arms.items()) if a == "holdout" and k.startswith("u0"))
    active = [k for k, a in sorted(arms.items()) if a == "current__daily" and k.startswith("u0")]
    edge = timedelta(days=14).total_seconds() / 86400
    rows = [
        (held, "delivered", 1, 0, "current", "daily"), (active[0], "delivered", 1, 0, "challenger_a", "daily"), (active[1], "delivered", -1, 0, "current", "daily"),
        (active[2], "delivered", edge, 0, "current", "daily"), (active[3], "delivered", 1, 0, "current", "daily"), (active[0], "funded", 0, 0, None, None),
        (active[1], "funded", edge - 1e-6 / 86400, 0, None, None), (active[2], "funded", edge, 0, None, None), (active[3], "unsubscribed", 3, 100, None, None),
        (active[0], "pre_period_engaged", -2, 0, None, None), (active[1], "pre_period_engaged", -2, 5, None, None),
    ]
    e = events_of(spark, rows)
    audit = pro.contamination(ledger, e).first()
    assert (audit["delivery_rows"], audit["holdout_delivery_rows"], audit["cross_content_delivery_rows"], audit["pre_assignment_delivery_rows"], audit["affected_participants"]) == (5, 1, 1, 1, 3)
    assert (audit["active_participants_without_delivery"], audit["active_participants_without_in_window_delivery"], audit["passed"]) == (192 - 4, 192 - 1, False)
    follow = pro.followup_audit(ledger, e, data_freeze=freeze()).first()
    assert (follow["censored_units"], follow["late_arriving_in_window_rows"], follow["negative_control_not_available_at_assignment_rows"], follow["passed"]) == (0, 1, 1, False)
    frame = {r["participant_id"]: r for r in pro.itt_frame(ledger, e, data_freeze=freeze()).collect()}
    assert len(frame) == 224
    assert [frame[k]["funded_14d"] for k in active[:3]] == [1, 1, 0]
    assert frame[active[3]]["unsubscribe_14d"] == 0 and [frame[k]["pre_period_engaged"] for k in active[:2]] == [1, 0]
    assert pro.followup_audit(ledger, e.limit(0), data_freeze=F.lit("2026-01-20 00:00:00 UTC").cast("timestamp")).first()["censored_units"] == 224


def cube_of(spark, hits, n=5000):
    rows = []
    for arm in asg.ARMS:
        for b in range(2):
            rows.append((f"s{b}", "t", "w", arm, n // 2, *[h.get(arm, h["*"]) // 2 for h in hits]))
    return spark.createDataFrame(rows, "lifecycle_segment string, tenure_band string, assignment_wave string, arm string, n long, funded_14d long, unsubscribe_14d long, complaint_14d long")


def test_families_and_decision(spark):
    best = "challenger_a__daily"
    cube = cube_of(spark, [{"*": 250, best: 500}, {"*": 50}, {"*": 20}])
    primary = dec.primary_family(cube).cache()
    row = primary.where(F.col("active_arm") == best).first()
    assert row["risk_difference"] == pytest.approx(0.05) and row["relative_risk"] == pytest.approx(2.0) and row["superiority_pass"] and row["family_size"] == 6
    v = sum(p * (1 - p) * 2500 / 2499 / 2500 for p in (0.1, 0.05)) * 2 / 4
    assert row["risk_difference_standard_error"] == pytest.approx(sqrt(v)) and row["p_value_two_sided"] == pytest.approx(erfc(0.05 / sqrt(v) / sqrt(2)), rel=1e-9)
    guards = dec.guardrail_family(cube, {"unsubscribe_14d": 0.01, "complaint_14d": 0.01}).cache()
    assert guards.count() == 12 and guards.where("noninferiority_pass and abs(bonferroni_alpha_each - 0.05D / 12D) < 1e-15D").count() == 12
    bound = guards.first()["simultaneous_one_sided_upper_bound"]
    exact = dec.guardrail_family(cube, {guards.first()["outcome"]: bound, next(o for o in dec.GUARDRAILS if o != guards.first()["outcome"]): 0.01})
    assert exact.where((F.col("simultaneous_one_sided_upper_bound") == F.col("noninferiority_margin")) & F.col("noninferiority_pass")).count() == 0
    harm = dec.guardrail_family(cube_of(spark, [{"*": 250}, {"*": 150, "holdout": 50}, {"*": 20}]), {"unsubscribe_14d": 0.01, "complaint_14d": 0.01})
    assert harm.where("conclusion = 'harmful_or_over_margin' and outcome = 'unsubscribe_14d'").count() == 6
    gates = spark.createDataFrame([(g, True) for g in dec.GATES], "gate string, passed boolean")
    assert dec.launch_decision(primary, guards, gates, candidate=best).first()["status"] == "criteria_met"
    assert dec.launch_decision(primary, guards, gates, candidate=None).first()["reasons"] == ["pre_specified_candidate_required"]
    failed = gates.withColumn("passed", F.col("gate") != "sample_ratio")
    out = dec.launch_decision(primary, guards, failed, candidate="current__daily").first()
    assert out["reasons"] == ["quality_gate_failed:sample_ratio", "primary_superiority_not_established"] and out["status"] == "continue_testing"
    for bad in (
        (primary.withColumn("p_value_two_sided", F.lit(0.5)), guards, gates), (primary, guards.withColumn("noninferiority_pass", F.lit(False)), gates),
        (primary, guards, gates.where("gate <> 'sample_ratio'")), (primary.limit(5), guards, gates), (dec.primary_family(cube, blocks=None), guards, gates),
    ):
        with pytest.raises(ContractError):
            dec.launch_decision(*bad, candidate=best)
    assert dec.decision_violations(primary, guards, gates).where("violations > 0").count() == 0

    def one(name, value, arm="current__daily"):
        return F.when(F.col("active_arm") == arm, value).otherwise(F.col(name))

    tampered = {
        "p": ((primary.withColumn("p_value_two_sided", one("p_value_two_sided", F.lit(0.123))), guards, gates), {"primary_raw_p": 1}),
        "holm": ((primary.withColumn("p_value_holm", one("p_value_holm", F.lit(0.0))), guards, gates), {"primary_holm_p": 1}),
        "range": ((primary.withColumn("risk_difference_standard_error", one("risk_difference_standard_error", F.lit(float("inf")))), guards, gates), {"primary_number_missing": 1}),
        "alpha": ((primary.withColumn("family_alpha", F.lit(0.1)), guards, gates), {"primary_family": 6}),
        "blocks": ((primary.withColumn("block_count", one("block_count", F.lit(7))), guards, gates), {"primary_block_counts_differ": 1}),
        "twice": ((primary.union(primary.where("active_arm = 'current__daily'")), guards, gates), {"primary_rows_not_six": 1, "primary_arms_repeat": 1}),
        "margin": ((primary, guards.withColumn("noninferiority_margin", one("noninferiority_margin", F.lit(1.0))), gates), {"guardrail_margin": 2}),
        "method": ((primary, guards.withColumn("block_adjusted_uncertainty", F.lit(True)), gates), {"guardrail_method": 12}),
        "stranger": ((primary, guards.withColumn("active_arm", one("active_arm", F.lit("other"))), gates), {"guardrail_arm_unknown": 2}),
        "gate": ((primary, guards, gates.withColumn("passed", F.when(F.col("gate") != "sample_ratio", F.col("passed")))), {"gates_missing": 1}),
    }
    for what, (tables_, want) in tampered.items():
        found = {r["rule"]: r["violations"] for r in dec.decision_violations(*tables_).where("violations > 0").collect()}
        assert want.items() <= found.items(), (what, found)
    with pytest.raises(ContractError):
        dec.launch_decision(primary, guards, gates, candidate="nothing")


def test_block_standardized_by_hand(spark):
    rows = [("small", "t", 1), ("small", "t", 0), ("small", "c", 1), ("small", "c", 0)] + [("large", "t", x) for x in (0, 0, 0, 1)] + [("large", "c", x) for x in (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "block string, arm string, outcome int")
    r = eff.compare_blocks(df, treatment="t", control="c", outcome="outcome", blocks=["block"]).first()
    assert r["treatment_rate"] == pytest.approx(1 / 3) and r["absolute_effect"] == 0 and r["p_value_two_sided"] == 1 and r["block_count"] == 2
    v = (1 / 3) ** 2 * (0.5 / 2 + 0.5 / 2) + (2 / 3) ** 2 * (0.25 / 4 + 0.25 / 4)
    assert r["standard_error"] == pytest.approx(sqrt(v))
    for bad in (df.where("not (block = 'large' and outcome = 1 and arm = 't')"), df.withColumn("outcome", F.lit(0)), df.withColumn("arm", F.lit("x")), df.withColumn("block", F.lit(None).cast("string"))):
        with pytest.raises((PySparkException, Py4JJavaError), match="comparison breaks its contract"):
            eff.compare_blocks(bad, treatment="t", control="c", outcome="outcome", blocks=["block"]).collect()
    for value, says in ((None, "outcome_missing: 1"), (2, "outcome_not_binary: 1")):
        with pytest.raises((PySparkException, Py4JJavaError), match=says):
            eff.compare_blocks(df.union(spark.createDataFrame([("large", "t", value)], df.schema)), treatment="t", control="c", outcome="outcome", blocks=["block"]).collect()
    with pytest.raises((PySparkException, Py4JJavaError), match="arm_without_rows"):
        eff.compare_blocks(df.limit(0), treatment="t", control="c", outcome="outcome", blocks=["block"]).collect()


def test_replications_agree_with_the_family(spark):
    """The count kernel over one replication is the primary family over the same counts."""
    hits = {arm: [7 + 3 * k, 11 + k] for k, arm in enumerate(asg.ARMS)}
    cube = spark.createDataFrame([(f"s{b}", "t", "w", arm, 100, hits[arm][b]) for arm in asg.ARMS for b in (0, 1)], "lifecycle_segment string, tenure_band string, assignment_wave string, arm string, n long, funded_14d long")
    family = {r["active_arm"]: r for r in dec.primary_family(cube).collect()}
    counts = spark.createDataFrame([("x", 1, "0", b, arm, 100, hits[arm][b]) for arm in asg.ARMS for b in (0, 1)] + [("x", 2, "0", b, arm, 2, 1 if arm == "holdout" and b else 0) for arm in asg.ARMS for b in (0, 1)], "scenario string, replication long, outcome string, block long, arm string, n long, successes long")
    made = rep.replicated_family(rep.contrasts(counts, holdout="holdout"), outcome="0").collect()
    for r in made:
        if r["replication"] == 1:
            want = family[r["arm"]]
            assert r["risk_difference"] == pytest.approx(want["risk_difference"], abs=1e-12) and r["standard_error"] == pytest.approx(want["risk_difference_standard_error"], abs=1e-12)
            assert r["p_value_holm"] == pytest.approx(want["p_value_holm"], abs=1e-12) and r["superiority_pass"] == want["superiority_pass"]
    flat = counts.withColumn("successes", F.lit(0).cast("long"))
    none = rep.replicated_family(rep.contrasts(flat, holdout="holdout"), outcome="0").collect()
    assert len(none) == 12 and all(not r["valid"] and r["p_value"] == 1.0 and not r["holm_reject"] for r in none)


def test_factorial_contract(spark):
    rows = [(f"p{k}", arm, *(arm.split("__") if "__" in arm else (None, None)), k % 2) for k, arm in enumerate(asg.ARMS * 2)]
    df = spark.createDataFrame(rows, "participant_id string, arm string, content string, cadence string, y int")
    assert dec.factorial_violations(df, ["y"]).where("violations > 0").count() == 0
    less = dec.factorial_violations(df.where("arm <> 'current__daily' and arm <> 'holdout'"), ["y"])
    assert {r["rule"] for r in less.where("violations > 0").collect()} == {"active_arms_not_six", "grid_cells_not_six", "holdout_absent"}


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a", float("nan"))], "k string, v double")
    assert [r["record"] for r in report.records(df).orderBy("record").collect()] == ['{"k":"a","v":null}', '{"k":"b","v":1.5}']
    doc = report.document({"z": df, "a": df.limit(0)})
    assert doc.first()["report"] == '{"a":[],"z":[{"k":"a","v":null},{"k":"b","v":1.5}]}'
    with pytest.raises(ContractError):
        report.write_document(doc, str(tmp_path / "out"), label="synthetic")
    report.write_document(doc, str(tmp_path / "synthetic-report"), label="synthetic")
    assert spark.read.text(str(tmp_path / "synthetic-report")).count() == 1


def test_readers(spark, tmp_path, ledger):
    ledger.write.parquet(str(tmp_path / "ledger"))
    assert tables.read(spark, str(tmp_path / "ledger"), tables.LEDGER).count() == 224
    with pytest.raises(ContractError):
        tables.read(spark, str(tmp_path / "ledger"), tables.ELIGIBLE)
    (tmp_path / "e.csv").write_text("participant_id,event_type,event_at\na,opened,2026-01-01T00:00:00Z\n")
    e = tables.read(spark, str(tmp_path / "e.csv"), tables.EVENTS, "csv")
    tables.write_events(e, str(tmp_path / "events"))
    assert tables.read(spark, str(tmp_path / "events"), tables.T.StructType([*tables.EVENTS.fields, tables.T.StructField("event_date", tables.T.DateType())])).count() == 1


def test_other_effects(spark):
    df = spark.createDataFrame([("treatment", 1.0), ("treatment", 3.0), ("control", 0.0), ("control", 2.0)], "arm string, x double")
    assert eff.standardized_differences(df, ["x"]).first()["smd"] == pytest.approx(1 / sqrt(2))
    groups = spark.createDataFrame([(e, a, k % 2) for e in "xy" for a in ("treatment", "control") for k in range(10)], "experiment string, arm string, outcome int")
    assert eff.compare_groups(groups).where("p_value_holm = 1 and p_value_bh = 1").count() == 2
    for bad, says in (
        (groups.where("not (experiment = 'x' and arm = 'control')"), "arm_without_rows"), (groups.withColumn("arm", F.lit("other")), "arm_not_declared: 20"),
        (groups.withColumn("outcome", F.col("outcome") * 2), "outcome_not_binary: 10"), (groups.withColumn("outcome", F.nullif("outcome", F.lit(0))), "outcome_missing: 10"),
    ):
        with pytest.raises((PySparkException, Py4JJavaError), match=says):
            eff.compare_groups(bad).collect()


def test_families_fail_closed(spark):
    schema = "lifecycle_segment string, tenure_band string, assignment_wave string, arm string, n long, funded_14d long, unsubscribe_14d long, complaint_14d long"
    rows = [(f"s{b}", "t", "w", arm, 10, 3 + k % 2, 1, 2) for k, arm in enumerate(asg.ARMS) for b in (0, 1)]
    cube = spark.createDataFrame(rows, schema)
    margins = {"unsubscribe_14d": 0.05, "complaint_14d": 0.05}
    assert dec.primary_family(cube).where("active_total = 20 and block_count = 2").count() == 6
    assert dec.guardrail_family(cube, margins).count() == 12
    here = (F.col("lifecycle_segment") == "s1") & (F.col("arm") == "holdout")
    broken = {
        "holdout gone from a block": cube.where(~here), "no holdout": cube.where("arm <> 'holdout'"), "five arms": cube.where("arm <> 'current__daily'"),
        "eight arms": cube.unionByName(cube.where("arm = 'holdout'").withColumn("arm", F.lit("other"))), "unequal": cube.withColumn("n", F.when(here, 11).otherwise(F.col("n"))),
        "more hits than units": cube.withColumn("funded_14d", F.lit(11).cast("long")), "no rows": cube.limit(0), "an arm twice": cube.unionByName(cube.where(here)),
    }
    for what, bad in broken.items():
        with pytest.raises(ContractError):
            dec.primary_family(bad)
            pytest.fail(what)
    for what in ("no holdout", "five arms", "no rows"):
        with pytest.raises(ContractError):
            dec.guardrail_family(broken[what], margins)
    for alpha in (0, 1.0, True, float("nan"), "x"):
        with pytest.raises(ContractError):
            dec.primary_family(cube, alpha=alpha)
    # unchecked, the block stays and says so
    lax = dec.primary_family(broken["holdout gone from a block"], check=False).collect()
    assert {(r["active_total"], r["block_count"], r["p_value_two_sided"]) for r in lax} == {(20, 2, 1.0)}
    assert {(r["bad_blocks"], r["valid"]) for r in eff.block_effects(broken["holdout gone from a block"].withColumnRenamed("funded_14d", "successes"), "holdout", blocks=asg.BLOCKS).collect()} == {(1, False)}


def test_frames_and_events_fail_closed(spark):
    rows = [(f"p{k}", "s", "t", "w", arm, *(arm.split("__") if "__" in arm else (None, None)), k % 2) for k, arm in enumerate(asg.ARMS * 4)]
    df = spark.createDataFrame(rows, "participant_id string, lifecycle_segment string, tenure_band string, assignment_wave string, arm string, content string, cadence string, y int")
    assert dec.validate_factorial_frame(df, ["y"]).count() == 28 and dec.arm_cube(df, ["y"]).count() == 7
    for bad in (df.unionByName(df.limit(1)), df.limit(0), df.withColumn("y", F.lit(2)), df.where("arm <> 'holdout'"), df.withColumn("tenure_band", F.lit(" "))):
        with pytest.raises(ContractError):
            dec.arm_cube(bad, ["y"])


def test_replications_without_a_cell(spark):
    """A replication that lacks the holdout of a block, or a whole family, is invalid and stays."""
    rows = [("x", r, o, b, a, 50, 5 + a + b) for r in (1, 2, 3) for o in range(4) for b in (0, 1) for a in range(7)]
    counts = spark.createDataFrame(rows, "scenario string, replication long, outcome long, block long, arm long, n long, successes long")
    counts = counts.where("not (replication = 2 and outcome = 0 and block = 1 and arm = 0) and not (replication = 3 and outcome = 1)")
    policy = {r["replication"]: r for r in rep.replicated_policy(rep.contrasts(counts), {2: 0.5, 3: 0.5}, candidate=4).collect()}
    assert {k: r["invalid"] for k, r in policy.items()} == {1: False, 2: True, 3: True}
    assert policy[1]["candidate_guardrails_pass"] and not policy[2]["candidate_guardrails_pass"] and policy[2]["policy_continue_testing"]


def test_reused_blocks_reads_whole_sequences(spark):
    rows = [(g, k, "b" if g == "odd" and k == 9_999 else "ab"[k % 2]) for g in ("one", "two", "odd", "short") for k in range(10_000 if g != "short" else 9_999)]
    rows = [(g, k, a if (g, k) != ("odd", 9_998) else "b") for g, k, a in rows]
    found = {r["block"]: (r["groups"], r["reused"]) for r in asg.reused_blocks(spark.createDataFrame(rows, "block string, position long, arm string").repartition(5), "block").collect()}
    assert found == {"one": (2, True), "two": (2, True), "odd": (1, False), "short": (1, False)}
