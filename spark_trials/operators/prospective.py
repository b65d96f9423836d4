"""Events with two clocks, occurrence and arrival: contracts, audits and the intention-to-treat frame."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.functions import stats
from spark_trials.operators.assignment import ARMS, BLOCKS, CADENCES, CONTENTS, HOLDOUT, validate_ledger
from spark_trials.operators.contracts import LAST_INSTANT, ContractError, count_rules, insist, require_exact_columns, require_none
from spark_trials.operators.units import HOT_ROWS, hot_ids, per_unit

# Event types, the outcomes they make, and the design's clocks.
EVENT_TYPES = ("delivered", "funded", "unsubscribed", "complained", "pre_period_engaged")
OUTCOMES = {"funded_14d": "funded", "unsubscribe_14d": "unsubscribed", "complaint_14d": "complained"}
EVENT_COLUMNS = ("event_id", "participant_id", "event_type", "event_at", "available_at", "delivered_content", "delivered_cadence")
#: So many repeated hashes of events are sent to the events; beyond it they are joined.
SUSPECTS = 100_000
FOLLOWUP, BUFFER = timedelta(days=14), timedelta(hours=48)


def event_rules() -> dict[str, Column]:
    """Rules of a single event, true where it breaks one."""
    delivered = F.col("event_type") == "delivered"
    c, d = F.col("delivered_content"), F.col("delivered_cadence")
    return {f"{k}_blank": F.col(k).isNull() | (F.trim(k) == "") for k in ("event_id", "participant_id", "event_type")} | {
        "unknown_type": ~F.col("event_type").isin(*EVENT_TYPES),
        "time_missing": F.col("event_at").isNull() | F.col("available_at").isNull(),
        "arrives_before_it_happens": F.col("available_at") < F.col("event_at"),
        "delivery_without_factors": delivered & (c.isNull() | d.isNull()),
        "factors_without_delivery": ~delivered & (c.isNotNull() | d.isNotNull()),
        "unknown_content": c.isNotNull() & ~c.isin(*CONTENTS),
        "unknown_cadence": d.isNotNull() & ~d.isin(*CADENCES),
    }


def duplicate_violations(events: DataFrame, *, most: int = SUSPECTS) -> DataFrame:
    """(rule, violations): events that share their id, or their whole payload, with another.

    Only 64-bit hashes of both keys move first, summed up in tasks. Keys are compared whole where a hash repeats, which on
    clean input is nowhere: then nothing moves again. Up to ``most`` such hashes are sent to the events, more are joined.
    """
    payload = [k for k in EVENT_COLUMNS if k not in ("event_id", "available_at")]
    keys = {"duplicate_event_id": ["event_id"], "duplicate_payload": payload}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.xxhash64(*key).alias("hash")) for k, key in enumerate(keys.values())])
    suspects = events.select(F.inline(pairs)).groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("kind", "hash")
    found = suspects.limit(most + 1).collect()
    few = len(found) <= most
    suspects = F.broadcast(events.sparkSession.createDataFrame(found, suspects.schema)) if few else suspects
    out = None
    for k, (name, key) in enumerate(keys.items()):
        own = events.select(*key).withColumn("hash", F.xxhash64(*key)).join(suspects.where(F.col("kind") == k).select("hash"), "hash", "left_semi")
        n = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("long").alias("violations")
        one = own.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(n).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def event_violations(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """(rule, violations): row rules in one pass, repeated payloads and ids, and orphans."""
    require_exact_columns(events, EVENT_COLUMNS)
    lost = events.join(ledger.select("participant_id"), "participant_id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return count_rules(events, event_rules()).unionByName(duplicate_violations(events)).unionByName(lost.select(F.lit("orphan_participant").alias("rule"), "violations"))


def validate_events(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` as they are, or an error with the counts of the rules that they, or the ledger, break."""
    validate_ledger(ledger)
    require_none(event_violations(ledger, events), "event table")
    return events


def unit_facts(
    ledger: DataFrame, events: DataFrame, *, data_freeze: Column, followup: timedelta = FOLLOWUP, check: bool = False, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The ledger's units with all that the audits and the frame ask of their events: one conditional aggregate by unit.

    Events move by unit once, whatever is read from the facts, and what is not read is not summed up. Events of unknown
    ids are passed over, or fail with the rules of single events in the same pass (``check``).
    """
    assigned, at, arrived = F.col("assigned_at"), F.col("event_at"), F.col("available_at")
    delivered, pre, outcome = F.col("event_type") == "delivered", F.col("event_type") == "pre_period_engaged", F.col("event_type").isin(*OUTCOMES.values())
    holdout, before, within = F.col("arm") == HOLDOUT, at < assigned, (at >= assigned) & (at < assigned + F.lit(followup))
    content = ~holdout & ~F.col("delivered_content").eqNullSafe(F.col("content"))
    cadence = ~holdout & ~F.col("delivered_cadence").eqNullSafe(F.col("cadence"))
    forbidden = holdout | content | cadence | before
    seen = (arrived <= data_freeze) & (at <= data_freeze)
    flags = {name: (F.col("event_type") == kind) & within & seen for name, kind in OUTCOMES.items()}
    flags["pre_period_engaged"] = pre & before & (arrived <= assigned) & (arrived <= data_freeze)
    facts = {
        "deliveries": delivered, "cross_content": delivered & content, "cross_cadence": delivered & cadence, "early_deliveries": delivered & before,
        "forbidden_deliveries": delivered & forbidden, "valid_deliveries": delivered & ~forbidden & (at < assigned + F.lit(followup)),
        "late_rows": within & (arrived > data_freeze), "early_outcomes": outcome & before, "controls_after": pre & ~before, "controls_late": pre & (arrived > assigned),
    }
    counts = {name: F.count_if(c) for name, c in facts.items()} | {name: F.max(c.cast("int")) for name, c in flags.items()}
    if check:
        events = insist(events, event_rules(), "event table")
    own = events.select("participant_id", "event_type", "event_at", "available_at", "delivered_content", "delivered_cadence")
    units = ledger.select("participant_id", "arm", "content", "cadence", "assigned_at")
    made = per_unit(own, units, "participant_id", counts, fail_on_orphans=check, hot=hot_ids(own, "participant_id", rows=hot_rows))
    return ledger.select("participant_id", *BLOCKS, "arm", "content", "cadence", "assigned_at").join(made, "participant_id", "left").fillna(0, list(counts))


def contamination_of(facts: DataFrame) -> DataFrame:
    """One row: deliveries that the design forbids, by kind, and active units without (valid, in-window) delivery."""
    active = F.col("arm") != HOLDOUT
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    bare, without = F.count_if(active & (F.col("deliveries") == 0)), F.count_if(active & (F.col("valid_deliveries") == 0))
    out = facts.agg(
        total("deliveries").alias("delivery_rows"), total(F.when(~active, F.col("deliveries"))).alias("holdout_delivery_rows"),
        total("cross_content").alias("cross_content_delivery_rows"), total("cross_cadence").alias("cross_cadence_delivery_rows"),
        total("early_deliveries").alias("pre_assignment_delivery_rows"), F.count_if(F.col("forbidden_deliveries") > 0).alias("affected_participants"),
        bare.alias("active_participants_without_delivery"), without.alias("active_participants_without_in_window_delivery"),
    )
    return out.withColumns({"active_delivery_coverage_passed": F.col("active_participants_without_in_window_delivery") == 0, "passed": F.col("affected_participants") == 0})


def contamination(ledger: DataFrame, events: DataFrame, *, followup: timedelta = FOLLOWUP) -> DataFrame:
    own = events.where(F.col("event_type") == "delivered")
    return contamination_of(unit_facts(ledger, own, data_freeze=F.lit(LAST_INSTANT).cast("timestamp"), followup=followup))


def followup_of(facts: DataFrame, *, data_freeze: Column, followup: timedelta = FOLLOWUP, buffer: timedelta = BUFFER, declared: timedelta = FOLLOWUP) -> DataFrame:
    """One row: censored units, late rows, outcomes before assignment and mistimed negative controls."""
    if buffer < timedelta(0):
        raise ContractError("buffer must not be negative")
    rows = {
        "late_arriving_in_window_rows": "late_rows", "pre_assignment_outcome_rows": "early_outcomes", "negative_control_after_assignment_rows": "controls_after",
        "negative_control_not_available_at_assignment_rows": "controls_late",
    }
    censored = F.count_if(F.col("assigned_at") + F.lit(followup) + F.lit(buffer) > data_freeze)
    out = facts.agg(F.count(F.lit(1)).alias("randomized_units"), censored.alias("censored_units"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in rows.items()])
    out = out.withColumn("aligned_followup", F.lit(followup == declared))
    clean = F.col("aligned_followup")
    for c in ("censored_units", *rows):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("passed", clean)


def followup_audit(ledger: DataFrame, events: DataFrame, *, data_freeze: Column, followup: timedelta = FOLLOWUP, buffer: timedelta = BUFFER, declared: timedelta = FOLLOWUP) -> DataFrame:
    facts = unit_facts(ledger, events, data_freeze=data_freeze, followup=followup)
    return followup_of(facts, data_freeze=data_freeze, followup=followup, buffer=buffer, declared=declared)


def frame_of(facts: DataFrame) -> DataFrame:
    return facts.select("participant_id", *BLOCKS, "arm", "content", "cadence", *OUTCOMES, "pre_period_engaged")


def itt_frame(ledger: DataFrame, events: DataFrame, *, data_freeze: Column, followup: timedelta = FOLLOWUP, check: bool = True) -> DataFrame:
    """One row for each randomized unit: three windowed outcomes and the pre-period flag, from events that had arrived.

    Units without events are kept as zeros. Ledger and events are validated (``check``): the ledger and repeated events before,
    single events and unknown ids in the pass that makes the frame.
    """
    if check:
        require_exact_columns(events, EVENT_COLUMNS)
        validate_ledger(ledger)
        require_none(duplicate_violations(events), "event table")
    return frame_of(unit_facts(ledger, events, data_freeze=data_freeze, followup=followup, check=check))


def event_type_counts(events: DataFrame) -> DataFrame:
    """Rows of every declared type, zeros included."""
    one = events.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("events")) for t in EVENT_TYPES])))


def concurrent_blocks(ledger: DataFrame) -> DataFrame:
    """Blocks and the number of their assignment times; a concurrent holdout has one in each."""
    return ledger.groupBy(*BLOCKS).agg(F.countDistinct("assigned_at").alias("assignment_times"))


def source_completeness(endpoints: DataFrame, watermarks: DataFrame, required: Column) -> DataFrame:
    """Each declared endpoint with its watermark; complete only if there is one, and not before ``required``."""
    met = endpoints.join(watermarks, "endpoint", "left")
    return met.withColumn("complete", F.coalesce(F.col("complete_through") >= required, F.lit(False)))


def report_figures(ledger: DataFrame, frame: DataFrame, events: DataFrame, *, baseline: float = 0.04, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(section, name, value) of the report: population, event counts and the plan, whose detectable difference comes from a
    declared baseline, the smallest arm and alpha over the six comparisons, and never from an observed rate."""
    n, arms = F.count(F.lit(1)), ledger.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))

    def rows(df: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
        one = df.agg(*[c.cast("double").alias(name) for name, c in values.items()])
        pairs = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.col(name).alias("value")) for name in values])
        return one.select(F.inline(pairs))

    people = rows(ledger, "population", {"eligible": n, "randomized": n, "assignment_blocks": F.countDistinct(F.struct(*BLOCKS))})
    people = people.unionByName(rows(frame, "population", {"itt_analyzed": n}))
    counts = rows(events, "event_counts", {"total": n, **{t: F.count_if(F.col("event_type") == t) for t in EVENT_TYPES}})
    size = F.min("n")
    each = alpha / (len(ARMS) - 1)
    plan = {"baseline_funding_rate": F.lit(baseline), "planned_units_per_arm": size, "planning_alpha_per_comparison": F.lit(each), "power": F.lit(power)}
    effect = stats.mde(F.lit(baseline), F.col("planned_units_per_arm"), F.col("planned_units_per_arm"), alpha=each, power=power)
    smallest = arms.agg(size.alias("planned_units_per_arm")).withColumn("e", effect)
    planned = rows(arms, "prospective_power_plan", plan).unionByName(rows(smallest, "prospective_power_plan", {"approximate_mde_absolute": F.max("e")}))
    return people.unionByName(counts).unionByName(planned)
