"""The registered queries: every operator over whole tables, through the adapters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_trials.functions.stats import rounded
from spark_trials.operators import assignment as asg
from spark_trials.operators import contracts as con
from spark_trials.operators import decision as dec
from spark_trials.operators import effects as eff
from spark_trials.operators import funnel as fun
from spark_trials.operators import outcomes as out
from spark_trials.operators import prospective as pro
from spark_trials.operators import replication as rep
from spark_trials.oracles import ORACLE_SQL  # noqa: F401
from spark_trials.plans import adapters as ad
from spark_trials.sources import report, shared, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STAGES = ("opened", "linked", "converted")
MARGINS = {"unsubscribe_14d": 0.05, "complaint_14d": 0.03}
R_GUARDS = {2: 0.05, 3: 0.03}
CANDIDATE, R_CANDIDATE = "challenger_a__twice_weekly", 4
NULL, STRONG, BOUNDARY = "5-LOW", "1-URGENT", "3-MEDIUM"


_kept: dict[tuple, DataFrame] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for part in _kept.values():  # what the query before kept is released; a frame of it that is still read is made again
            part.unpersist()
        _kept.clear()
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def part(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table that a query reads in several places: made once, and kept in the executors' memory and disks until the next query."""

    @wraps(f)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (f.__name__, sf_dir, spark.sparkContext.applicationId)
        if key not in _kept:
            _kept[key] = f(spark, sf_dir).persist()
        return _kept[key]

    return once


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, instants as microseconds."""
    changed = {}
    for n, t in df.dtypes:
        if t == "double":
            changed[n] = rounded(F.col(n))
        elif t == "timestamp":
            changed[n] = F.unix_micros(n)
    return df.withColumns(changed) if changed else df


def _number():
    return F.substring("participant_id", 2, 20).cast("long")


def b_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return out.windowed_outcome(ad.b_cohort(spark, d), ad.b_events(spark, d), window=ad.B_WINDOW, observation_end=ad.instant(ad.B_END))


def a_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return out.windowed_outcome(ad.a_cohort(spark, d), ad.a_events(spark, d), window=ad.A_WINDOW, observation_end=ad.instant(ad.A_END))


@part
def c_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger, kept by id in as many parts as its size asks for; the ranks leave it in as many as a shuffle may have."""
    return ad.c_ledger(spark, d).repartition("participant_id")


@part
def c_events(spark: SparkSession, d: str) -> DataFrame:
    return ad.c_events(spark, d, c_ledger(spark, d))


@part
def c_clean_events(spark: SparkSession, d: str) -> DataFrame:
    return ad.c_clean_events(spark, d, c_ledger(spark, d))


@part
def c_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the audits and the frame ask of the clean events; unchecked, for queries that check what they make of it."""
    return pro.unit_facts(c_ledger(spark, d), c_clean_events(spark, d), data_freeze=ad.instant(ad.C_FREEZE), followup=ad.C_FOLLOWUP)


def c_frame(spark: SparkSession, d: str) -> DataFrame:
    return pro.frame_of(c_facts(spark, d))


def c_followup(spark: SparkSession, d: str) -> DataFrame:
    return pro.followup_of(c_facts(spark, d), data_freeze=ad.instant(ad.C_FREEZE), followup=ad.C_FOLLOWUP, declared=ad.C_FOLLOWUP)


@part
def r_counts(spark: SparkSession, d: str) -> DataFrame:
    return ad.r_counts(spark, d)


@query
def q_experiment_effects(spark, d):
    return plain(eff.compare_groups(b_outcomes(spark, d).where("outcome is not null")))


@query
def q_binary_effect(spark, d):
    people = b_outcomes(spark, d).where("outcome is not null").withColumn("custkey_group", F.floor(F.col("c_custkey") / 2) % 20)
    return plain(eff.with_binary_effect(eff.arm_counts(people, ["custkey_group"])))


@query
def q_mde(spark, d):
    return plain(eff.with_mde(eff.arm_counts(b_outcomes(spark, d).where("outcome is not null"), ["experiment"])))


@query
def q_holm_bh(spark, d):
    rows = b_outcomes(spark, d).where("outcome is not null").withColumn("family", F.when(F.col("c_acctbal") < 4500, "low").otherwise("high"))
    made = eff.compare_groups(rows, family=["family"])
    return plain(made.select("family", "experiment", "p_value_two_sided", "p_value_holm", "p_value_bh"))


@query
def q_windowed_outcome(spark, d):
    return plain(a_outcomes(spark, d).drop("c_custkey", "c_acctbal"))


@query
def q_orphans(spark, d):
    half = ad.table(spark, d, "customer").agg((F.max("c_custkey") / 2).alias("half"))
    lost = F.when(F.col("c_custkey") < F.col("half"), F.col("participant_id")).otherwise(F.concat(F.lit("gone-"), "participant_id"))
    known = ad.b_cohort(spark, d).join(half, F.lit(True)).withColumn("participant_id", lost)
    return con.orphans(ad.b_events(spark, d), known, "participant_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("orphan_rows"))


@query
def q_censoring(spark, d):
    return plain(out.censoring_summary(a_outcomes(spark, d)))


@query
def q_censoring_by_experiment(spark, d):
    return plain(out.censoring_summary(a_outcomes(spark, d), ["experiment", "arm"]))


@query
def q_population_flow(spark, d):
    cohort, events = ad.b_cohort(spark, d), ad.b_events(spark, d)
    e = events.join(cohort.select("participant_id", "assigned_at"), "participant_id")
    recent = e.where(F.col("event_at") >= F.col("assigned_at") - F.lit(timedelta(days=30))).drop("assigned_at")
    old = e.where((F.col("event_type") == "converted") & (F.col("event_at") >= F.col("assigned_at") - F.lit(timedelta(days=90))) & (F.col("event_at") < F.col("assigned_at") - F.lit(timedelta(days=30))))
    marked = cohort.join(old.select("participant_id").distinct().withColumn("_old", F.lit(True)), "participant_id", "left")
    marked = marked.withColumn("converted_before_entry", F.coalesce("_old", F.lit(False))).drop("_old")
    made = out.windowed_outcome(marked, recent, window=ad.B_WINDOW, observation_end=ad.instant(ad.C_FREEZE))
    return out.population_flow(made, excluded="converted_before_entry", by=["experiment", "arm"])


@query
def q_last_observed(spark, d):
    return plain(out.last_observed(ad.a_events(spark, d)))


@query
def q_funnel_membership(spark, d):
    return plain(fun.funnel_membership(ad.b_events(spark, d), STAGES, cohort=ad.b_cohort(spark, d).select("participant_id", "assigned_at")))


@query
def q_funnel_summary(spark, d):
    cohort = ad.b_cohort(spark, d).select("participant_id", "assigned_at")
    return plain(fun.funnel_summary(fun.funnel_membership(ad.b_events(spark, d), STAGES, cohort=cohort), STAGES))


@query
def q_new_link_funnel(spark, d):
    cohort = ad.b_flagged(spark, d).select("participant_id", "assigned_at", "linked_before_entry", "converted_before_entry")
    return plain(fun.new_link_funnel(ad.b_events(spark, d), cohort, STAGES))


@query
def q_funnel_day_gap(spark, d):
    cohort = ad.a_cohort(spark, d).select("participant_id", "assigned_at")
    return plain(fun.funnel_membership(ad.a_events(spark, d), STAGES, cohort=cohort, day_gap=1))


@query
def q_gap_outcomes(spark, d):
    return out.gap_outcomes(ad.a_cohort(spark, d).withColumn("eligible_at", F.col("assigned_at")), ad.a_events(spark, d))


@query
def q_gap_sensitivity(spark, d):
    """Effects with all outcomes and without those between eligibility and the first delivery, side by side."""
    people = ad.a_cohort(spark, d).withColumn("eligible_at", F.col("assigned_at") - F.lit(timedelta(days=2)))
    rows = out.gap_sensitivity(people, ad.a_events(spark, d), window=ad.A_WINDOW, observation_end=ad.instant(ad.A_END)).where("outcome is not null")
    return plain(eff.compare_groups(rows, family=["analysis"]))


@query
def q_unsub(spark, d):
    return plain(fun.exposure_risk(ad.a_exposed(spark, d), ad.a_events(spark, d)))


@query
def q_failure_risk(spark, d):
    """The same risk job for another event, by experiment."""
    return plain(fun.exposure_risk(ad.a_exposed(spark, d), ad.a_events(spark, d), event="linked", by="experiment"))


def _messages(spark, d):
    kind = F.col("event_type")
    return fun.subject_messages(ad.a_messages(spark, d), subject="subject", message="message", time_col="event_at", flags={"delivered": kind == "signup", "viewed": kind == "view", "failed": kind == "error"})


@query
def q_subject_message(spark, d):
    return plain(_messages(spark, d))


@query
def q_template_open(spark, d):
    pairs = _messages(spark, d).where("delivered").withColumn("template", F.concat(F.lit("T"), (F.col("message") % 10).cast("string")))
    return plain(fun.open_rates(pairs.withColumn("opened", F.when(~F.col("failed"), F.col("viewed")))))


@query
def q_key_contract(spark, d):
    orders = ad.table(spark, d, "orders").withColumn("flag", F.col("o_orderkey") % 3)
    return con.key_violations(orders, ["o_custkey"]).unionByName(con.count_rules(orders, con.binary_rules(orders, "flag")))


@query
def q_tz_contract(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(day, F.lit("T00:00:00Z"))).when(k == 1, F.concat(day, F.lit("T02:00+0200"))).when(k == 2, F.concat(day, F.lit("T00:00:00"))).otherwise("9999-01-01T00:00:00Z")
    rows = ad.table(spark, d, "orders").select(text.alias("at"))
    instant, state = con.instant_states(rows, "at")
    made = rows.select(state.alias("state"), F.when(state == "ok", instant).alias("t"))
    return plain(made.groupBy("state").agg(F.count(F.lit(1)).alias("values"), F.min("t").alias("first_at"), F.max("t").alias("last_at")))


@query
def q_one_to_one(spark, d):
    spent = ad.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("c_nationkey"))
    lost = F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey"))
    people = ad.table(spark, d, "customer").withColumn("c_custkey", lost)
    met, _ = con.one_to_one_join(people, spent, ["c_custkey"], how="outer", require_match="none")
    return met.select("c_custkey", "c_nationkey_left", "c_nationkey_right")


@query
def q_join_amplification(spark, d):
    cohort = ad.b_cohort(spark, d)
    return plain(con.amplification(cohort, cohort.join(ad.b_events(spark, d), "participant_id", "left"), "participant_id"))


@query
def q_assignment(spark, d):
    return plain(c_ledger(spark, d))


@query
def q_ledger_contract(spark, d):
    """The ledger with faults planted by the number in the id, so that every rule has work."""
    fault = _number() % 12
    rows = c_ledger(spark, d)
    bad = rows.withColumns(
        {
            "arm": F.when(fault == 0, " ").when(fault == 1, "other").otherwise(F.col("arm")), "content": F.when(fault == 2, "current").when(fault == 3, "nothing").otherwise(F.col("content")),
            "cadence": F.when(fault == 4, F.lit(None).cast("string")).otherwise(F.col("cadence")), "eligible_at": F.when(fault == 5, F.col("assigned_at") + F.lit(timedelta(days=1))).otherwise(F.col("eligible_at")),
            "expected_probability": F.when(fault == 6, F.lit(float("nan"))).when(fault == 7, F.lit(0.2)).otherwise(F.col("expected_probability")),
            "randomization_version": F.when(fault == 8, "v0").otherwise(F.col("randomization_version")),
        }
    )
    return asg.ledger_violations(bad)


@query
def q_exact_allocation(spark, d):
    return asg.exact_allocation(c_ledger(spark, d))


@query
def q_srm(spark, d):
    return plain(asg.sample_ratio(ad.c_unbalanced(spark, d)))


@query
def q_ledger_digest(spark, d):
    return asg.ledger_digest(c_ledger(spark, d))


def _positions(spark, d):
    """Whole blocks as they are dealt, which blocks of one size share, and as a rank over everybody arms them, which they don't."""
    key, segment = asg.block_key(ad.SEED), F.concat_ws("|", *asg.BLOCKS)
    dealt = asg.ranks(ad.c_eligible(spark, d), asg.BLOCKS, key).withColumn("arm", asg.arm_of(F.col("_rank"))).withColumn("kind", F.lit("dealt"))
    ranked = asg.ranks(ad.c_unbalanced(spark, d).drop("_rank"), asg.BLOCKS, key).withColumn("kind", F.lit("ranked"))
    columns = [F.concat_ws("|", "kind", segment).alias("block"), F.col("_rank").alias("position"), "arm"]
    return dealt.select(*columns).unionByName(ranked.select(*columns))


@query
def q_block_reuse(spark, d):
    return asg.reused_blocks(_positions(spark, d), "block")


@query
def q_position_balance(spark, d):
    people = ad.c_unbalanced(spark, d)
    ranked = asg.ranks(people.drop("_rank"), asg.BLOCKS, asg.block_key(ad.SEED)).withColumn("position", (F.col("_rank") % 5).cast("string"))
    return plain(asg.sample_ratio(ranked, blocks=["position"]))


@query
def q_event_contract(spark, d):
    ledger = c_ledger(spark, d)
    lost = F.when(_number() % 10 > 0, F.col("participant_id")).otherwise(F.concat(F.lit("gone-"), "participant_id"))
    return pro.event_violations(ledger.withColumn("participant_id", lost), c_events(spark, d))


@query
def q_contamination(spark, d):
    ledger = c_ledger(spark, d)
    return pro.contamination(ledger, c_events(spark, d), followup=ad.C_FOLLOWUP)


@query
def q_followup(spark, d):
    ledger = c_ledger(spark, d)
    return pro.followup_audit(ledger, c_events(spark, d), data_freeze=ad.instant(ad.C_FREEZE), followup=ad.C_FOLLOWUP, declared=ad.C_FOLLOWUP)


@query
def q_itt_frame(spark, d):
    return pro.itt_frame(c_ledger(spark, d), c_clean_events(spark, d), data_freeze=ad.instant(ad.C_FREEZE), followup=ad.C_FOLLOWUP)


@query
def q_event_type_counts(spark, d):
    return pro.event_type_counts(c_events(spark, d))


def _gates(spark, d, negative: DataFrame) -> DataFrame:
    ledger = c_ledger(spark, d)
    audit, follow = pro.contamination_of(c_facts(spark, d)), c_followup(spark, d)
    frame, n = c_frame(spark, d), F.count(F.lit(1))
    kept = frame.agg(n.alias("a"), F.countDistinct("participant_id").alias("b")).join(ledger.agg(n.alias("c")), F.lit(True))
    return dec.gate_rows(
        {
            "assignment_contract": asg.ledger_violations(ledger).agg((F.sum("violations") == 0).alias("passed")),
            "exact_block_allocation": asg.exact_allocation(ledger).agg(F.bool_and("exact").alias("passed")),
            "sample_ratio": asg.sample_ratio(ledger).agg(F.bool_and("passed").alias("passed")),
            "concurrent_holdout": pro.concurrent_blocks(ledger).agg(F.bool_and(F.col("assignment_times") == 1).alias("passed")),
            "aligned_14_day_followup": follow.select(F.col("aligned_followup").alias("passed")),
            "complete_followup_and_latency_buffer": follow.select("passed"), "no_contamination": audit.select("passed"),
            "active_delivery_coverage": audit.select(F.col("active_delivery_coverage_passed").alias("passed")), "pre_period_negative_control": negative.select("passed"),
            "itt_population_preserved": kept.select(((F.col("a") == F.col("c")) & (F.col("b") == F.col("c"))).alias("passed")),
        }
    )


@part
def _cube(spark, d) -> DataFrame:
    return dec.arm_cube(c_frame(spark, d), ["funded_14d", "unsubscribe_14d", "complaint_14d", "pre_period_engaged"])


def _negative(spark, d) -> DataFrame:
    return con.settled(dec.negative_control(dec.primary_family(_cube(spark, d), outcome="pre_period_engaged")))


def _judged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Primary family, guardrails and gates: six, twelve and ten rows, which the decision reads many times."""
    cube = _cube(spark, d)
    negative = con.settled(dec.negative_control(dec.primary_family(cube, outcome="pre_period_engaged")))
    return con.settled(dec.primary_family(cube)), con.settled(dec.guardrail_family(cube, MARGINS)), con.settled(_gates(spark, d, negative))


@query
def q_gates(spark, d):
    return _gates(spark, d, _negative(spark, d))


@query
def q_source_completeness(spark, d):
    """Endpoints of the event types; the watermark is the last arrival, and one type has none."""
    events = c_events(spark, d)
    seen = events.groupBy(F.col("event_type").alias("endpoint")).agg(F.max("available_at").alias("complete_through")).where("endpoint <> 'complained'")
    endpoints = pro.event_type_counts(events).select(F.col("event_type").alias("endpoint"))
    return plain(pro.source_completeness(endpoints, seen, ad.instant("2001-07-25 00:00:00")))


@query
def q_factorial_contract(spark, d):
    frame = c_frame(spark, d)
    fault = _number() % 50
    bad = frame.withColumn("cadence", F.when(fault == 1, F.lit(None).cast("string")).otherwise(F.col("cadence"))).withColumn("funded_14d", F.when(fault == 2, F.lit(7)).otherwise(F.col("funded_14d")))
    return dec.factorial_violations(bad, ["funded_14d", "unsubscribe_14d", "complaint_14d"])


@query
def q_block_effect(spark, d):
    both = c_frame(spark, d).where(F.col("arm").isin(CANDIDATE, asg.HOLDOUT))
    return plain(eff.compare_blocks(both, treatment=CANDIDATE, control=asg.HOLDOUT, outcome="funded_14d", blocks=asg.BLOCKS))


@query
def q_primary_family(spark, d):
    return plain(dec.primary_family(_cube(spark, d)))


@query
def q_primary_pooled(spark, d):
    return plain(dec.primary_family(_cube(spark, d), blocks=None).drop("risk_difference_standard_error", "block_columns"))


@query
def q_guardrail_family(spark, d):
    return plain(dec.guardrail_family(_cube(spark, d), MARGINS))


@query
def q_negative_control(spark, d):
    return _negative(spark, d)


@query
def q_negative_control_two_arm(spark, d):
    rows = ad.b_flagged(spark, d)
    made = eff.compare_groups(rows, outcome="linked_before_entry").withColumn("rejected", F.col("p_value_holm") < 0.05)
    return dec.negative_control(made, "rejected")


@query
def q_decision(spark, d):
    made = dec.launch_decision(*_judged(spark, d), candidate=CANDIDATE)
    return made.withColumns({c: F.array_join(c, ",") for c in ("reasons", "failed_gates")})


@query
def q_decision_violations(spark, d):
    return dec.decision_violations(*_judged(spark, d))


def _report_figures(spark, d) -> DataFrame:
    ledger, frame, events = c_ledger(spark, d), c_frame(spark, d), c_clean_events(spark, d)
    return pro.report_figures(ledger, frame, events)


@query
def q_report_figures(spark, d):
    """The whole numbers of the prospective report and its planned detectable effect."""
    return plain(_report_figures(spark, d))


@query
def q_prospective_report(spark, d):
    """The report of the seven-arm trial as one JSON document: population, plan, audits, families, gates and decision."""
    ledger = c_ledger(spark, d)
    primary, guards, gates = _judged(spark, d)
    sections = {
        "figures": _report_figures(spark, d), "randomization": asg.ledger_digest(ledger), "sample_ratio": asg.sample_ratio(ledger),
        "contamination_audit": pro.contamination_of(c_facts(spark, d)), "followup_audit": c_followup(spark, d),
        "primary_funding_family": primary, "guardrail_noninferiority_family": guards, "pre_period_negative_control": _negative(spark, d), "quality_gates": gates,
        "decision": dec.launch_decision(primary, guards, gates, candidate=CANDIDATE, check=False),
    }
    return report.document(sections, digits=9)


def _count_of(contract: Callable[[], object]) -> int:
    try:
        contract()
    except con.ContractError:
        return 1
    return 0


@query
def q_column_contracts(spark, d):
    """Customers against the column contracts: (rule, broken), with tables that lack, repeat or add a column, and the number of
    rows that each rule was asked of."""
    people = ad.table(spark, d, "customer")
    twice = people.select("*", F.col("c_name"))
    rules = {
        "unique": lambda: con.require_unique_columns(people), "unique_of_repeated": lambda: con.require_unique_columns(twice),
        "required": lambda: con.require_columns(people, ["c_custkey", "c_name"]), "required_of_missing": lambda: con.require_columns(people, ["c_custkey", "no_such"]),
        "exact": lambda: con.require_exact_columns(people, people.columns), "exact_of_more": lambda: con.require_exact_columns(people, people.columns[1:]),
        "instant": lambda: con.instant_literal("2024-01-01T00:00:00+02:00"), "instant_without_zone": lambda: con.instant_literal("2024-01-01T00:00:00"),
    }
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(_count_of(f)).alias("broken")) for n, f in rules.items()])
    return people.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(found))


def _as_text(df: DataFrame) -> DataFrame:
    """Rows as a text export has them: instants with their offset, all else as it is printed."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select(*[(stamp(c) if t == "timestamp" else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])


def _faulty_exports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assignments and events as text, with faults by the customer's number and by the day."""
    k = F.substring("participant_id", 2, 20).cast("long") % 10
    people = ad.a_exposed(spark, d).withColumns({"linked_before_entry": F.col("c_custkey") % 3 == 0, "converted_before_entry": F.lit(False)})
    texts = _as_text(people.select(*tables.ASSIGNMENTS.names))
    texts = texts.withColumns(
        {
            "assigned_at": F.when(k == 1, F.regexp_replace("assigned_at", "Z$", "")).when(k == 2, F.lit("soon")).otherwise(F.col("assigned_at")),
            "messages_delivered": F.when(k == 3, F.lit("many")).otherwise(F.col("messages_delivered")), "linked_before_entry": F.when(k == 4, F.lit("perhaps")).otherwise(F.col("linked_before_entry")),
            "participant_id": F.when(k == 5, F.lit(None).cast("string")).otherwise(F.col("participant_id")),
        }
    )
    events = _as_text(ad.a_events(spark, d).select(*tables.EVENTS.names))
    naive = F.dayofmonth(F.to_date(F.substring("event_at", 1, 10))) == 9
    return texts, events.withColumn("event_at", F.when(naive, F.regexp_replace("event_at", "Z$", "")).otherwise(F.col("event_at")))


@query
def q_reader(spark, d):
    """Assignments (CSV) and events (JSON lines) with faults, exported and read again by their declared schemas: how many rows
    are taken, and how many are not, by reason."""
    made = None
    top = shared.folder(spark, "exports")
    for name, fmt, texts, schema in zip(("assignments", "events"), ("csv", "json"), _faulty_exports(spark, d), (tables.ASSIGNMENTS, tables.EVENTS), strict=True):
        texts.write.format(fmt).option("header", True).save(f"{top}/{name}")
        rows, rejects = tables.read_with_rejects(spark, f"{top}/{name}", schema, fmt)
        taken = rows.groupBy(F.lit("taken").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
        own = taken.unionByName(tables.reject_counts(rejects)).select(F.lit(name).alias("table"), "reason", "rows")
        made = own if made is None else made.unionByName(own)
    return made


@query
def q_pruned_events(spark, d):
    """Events stored by day, of which only the days that the assignment windows span are read: outcomes in each window."""
    top = shared.folder(spark, "events-by-day")
    tables.write_events(ad.a_events(spark, d), f"{top}/events")
    people = ad.a_cohort(spark, d).where(F.col("assigned_at") < ad.instant("2024-01-15 00:00:00"))
    events = tables.read_events(spark, f"{top}/events", tables.EVENTS, **tables.window_bounds(people, ad.A_WINDOW))
    made = out.windowed_outcome(people, events, window=ad.A_WINDOW, observation_end=ad.instant(ad.A_END), fail_on_orphan_events=False)
    return plain(made.select("participant_id", "arm", "first_outcome_at", "outcome"))


@query
def q_event_days(spark, d):
    """Days of the stored events that windows of two early cohorts need, and how many rows each has."""
    top = shared.folder(spark, "events-by-day")
    tables.write_events(ad.a_events(spark, d), f"{top}/events")
    people = ad.a_cohort(spark, d).where(F.col("assigned_at") < ad.instant("2024-01-06 00:00:00"))
    events = tables.read_events(spark, f"{top}/events", tables.EVENTS, **tables.window_bounds(people, ad.A_WINDOW))
    return events.groupBy(F.to_date("event_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def q_balance_smd(spark, d):
    spent = ad.table(spark, d, "orders").where("o_orderdate < timestamp_ntz '1998-01-01'").groupBy(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("participant_id")).agg(F.count(F.lit(1)).alias("orders_before"))
    rows = ad.b_cohort(spark, d).join(spent, "participant_id", "left").fillna(0, ["orders_before"])
    return plain(eff.standardized_differences(rows, ["c_acctbal", "orders_before"], by=["experiment"]))


@query
def q_cadence(spark, d):
    rows = c_frame(spark, d).where("cadence is not null").withColumn("stratum", F.concat_ws("|", "lifecycle_segment", "tenure_band"))
    return plain(eff.cadence_contrast(rows, stratum="stratum", outcomes=["funded_14d", "pre_period_engaged"]))


@query
def q_aggregate_control(spark, d):
    rows = b_outcomes(spark, d).where("outcome is not null")
    hit = F.count_if("outcome")
    controls = rows.where("arm = 'control'").groupBy("experiment").agg(hit.alias("control_successes"), F.count(F.lit(1)).alias("control_total"))
    treated = rows.where("arm = 'treatment'").groupBy("experiment", (F.col("c_custkey") % 8).alias("cell")).agg(hit.alias("treatment_successes"), F.count(F.lit(1)).alias("treatment_total"))
    return plain(eff.aggregate_control(treated, controls, key="experiment", cell="cell"))


@part
def _contrasts(spark, d):
    return rep.contrasts(r_counts(spark, d))


def _policy(table, truth):
    return rep.replicated_policy(table, R_GUARDS, candidate=R_CANDIDATE, truth=truth)


@query
def q_rep_family(spark, d):
    return plain(rep.replicated_family(_contrasts(spark, d), outcome=0))


@query
def q_rep_guardrail(spark, d):
    return plain(rep.replicated_guardrails(_contrasts(spark, d), R_GUARDS))


@query
def q_rep_policy(spark, d):
    return plain(_policy(_contrasts(spark, d), ad.r_truth(r_counts(spark, d))))


def _rates(spark, d):
    table, truth = _contrasts(spark, d), ad.r_truth(r_counts(spark, d))
    return rep.replicated_rates(_policy(table, truth), table, R_GUARDS, candidate=R_CANDIDATE, truth=truth)


@query
def q_rep_rates(spark, d):
    return plain(_rates(spark, d))


@query
def q_rep_diagnostics(spark, d):
    truth = ad.r_truth(r_counts(spark, d))
    return plain(rep.replicated_diagnostics(_policy(_contrasts(spark, d), truth), truth, candidate=R_CANDIDATE))


@query
def q_rep_gates(spark, d):
    return plain(rep.calibration_gates(_rates(spark, d), null=NULL, strong=STRONG, boundary=BOUNDARY))


@query
def q_report(spark, d):
    """The two-arm report: effects, censoring, funnel and exposure risk as one JSON document."""
    sections = {"effects": q_experiment_effects, "censoring": q_censoring_by_experiment, "funnel": q_funnel_summary, "unsubscribe": q_unsub, "population": q_population_flow}
    return report.document({n: f(spark, d) for n, f in sections.items()}, digits=9)


@query
def q_records(spark, d):
    return report.records(q_experiment_effects(spark, d).withColumn("not_finite", F.lit(float("nan"))), digits=9)
