"""Windowed outcomes with explicit censoring."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.operators.contracts import ContractError, require_columns, require_instants, required
from spark_trials.operators.units import HOT_ROWS, hot_ids, narrow_units, per_unit


def interval(duration: timedelta) -> Column:
    if duration <= timedelta(0):
        raise ContractError("window must be positive")
    return F.lit(duration)


def windowed_outcome(
    assignments: DataFrame, events: DataFrame, *, window: timedelta, observation_end: Column, id_col: str = "participant_id",
    time_col: str = "assigned_at", event_time_col: str = "event_at", event_type_col: str = "event_type", outcome_event: str = "converted",
    fail_on_orphan_events: bool = True, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each assignment with window_end, followup_complete, first_outcome_at, has_pre_assignment_outcome and outcome.

    The window is half-open, [assigned, assigned + window), and events after ``observation_end`` never count. An outcome
    is null, not false, where the follow-up is not complete. Events are cut to the outcome type and two columns before
    they meet the assignments, once, and an id of very many events is spread (``units``). Ids that lack or repeat fail in the
    join's own exchange, and so do outcome events of unknown ids; without ``fail_on_orphan_events`` those are passed
    over. Times must be instants.
    """
    require_columns(assignments, [id_col, time_col])
    require_columns(events, [id_col, event_time_col, event_type_col])
    require_instants(assignments, [time_col])
    require_instants(events, [event_time_col])
    ends = required(assignments, [id_col, time_col], "assignment table").withColumn("window_end", F.col(time_col) + interval(window))
    own = events.where(F.col(event_type_col) == outcome_event).select(id_col, F.col(event_time_col).alias("_t"))
    inside = (F.col("_t") >= F.col("_from")) & (F.col("_t") < F.col("_from") + interval(window)) & (F.col("_t") <= observation_end)
    found = {"first_outcome_at": F.min(F.when(inside, F.col("_t"))), "_before": F.bool_or(F.col("_t") < F.col("_from"))}
    units = narrow_units(assignments.select(id_col, F.col(time_col).alias("_from")), id_col, ["_from"])
    # a row for every unit, so that a repeated id is found with or without events
    seen = units.join(per_unit(own, units, id_col, found, fail_on_orphans=fail_on_orphan_events, hot=hot_ids(own, id_col, rows=hot_rows)), id_col, "left").drop("_from")
    out = ends.join(seen, id_col, "left").withColumn("followup_complete", F.col("window_end") <= observation_end)
    out = out.withColumn("has_pre_assignment_outcome", F.coalesce("_before", F.lit(False)))
    out = out.withColumn("outcome", F.when(F.col("followup_complete"), F.col("first_outcome_at").isNotNull()))
    return out.select(*assignments.columns, "window_end", "followup_complete", "first_outcome_at", "has_pre_assignment_outcome", "outcome")


def censoring_summary(outcomes: DataFrame, by: Sequence[str] = ("arm",), complete_col: str = "followup_complete") -> DataFrame:
    total, complete = F.count(F.lit(1)), F.count_if(complete_col)
    return outcomes.groupBy(*by).agg(
        total.alias("total"), complete.alias("complete"), (total - complete).alias("censored"), (complete / total).alias("complete_rate")
    )


def population_flow(outcomes: DataFrame, *, excluded: str, by: Sequence[str] = ()) -> DataFrame:
    """assigned = pre-existing + pre-assignment + censored + analyzed; a row counts in the first that holds."""
    before, early = F.col(excluded), F.col("has_pre_assignment_outcome")
    state = F.when(before, "pre_existing").when(early, "pre_assignment").when(~F.col("followup_complete"), "censored").otherwise("analyzed")
    parts = [F.count_if(F.col("_s") == s).alias(s) for s in ("pre_existing", "pre_assignment", "censored", "analyzed")]
    return outcomes.withColumn("_s", state).groupBy(*by).agg(F.count(F.lit(1)).alias("assigned"), *parts)


def analysis_set(outcomes: DataFrame, *, excluded: str) -> DataFrame:
    return outcomes.where(~F.col(excluded) & ~F.col("has_pre_assignment_outcome") & F.col("followup_complete"))


def last_observed(events: DataFrame, event_type_col: str = "event_type", event_time_col: str = "event_at") -> DataFrame:
    return events.groupBy(event_type_col).agg(F.max(event_time_col).alias("last_observed_at"))


def gap_outcomes(
    assignments: DataFrame, events: DataFrame, *, outcome_event: str = "converted", delivery_event: str = "delivered", eligible_col: str = "eligible_at",
    id_col: str = "participant_id", arm_col: str = "arm",
) -> DataFrame:
    """By arm: participants, those with an outcome from eligibility up to before the first delivery, and those events."""
    own = events.where(F.col("event_type").isin(outcome_event, delivery_event)).select(id_col, "event_type", "event_at")
    met = own.join(assignments.select(id_col, eligible_col), id_col)
    first = met.where(F.col("event_type") == delivery_event).groupBy(id_col).agg(F.min("event_at").alias("_first"))
    late = met.where((F.col("event_type") == outcome_event) & (F.col("event_at") >= F.col(eligible_col))).join(first, id_col)
    gaps = late.where(F.col("event_at") < F.col("_first")).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return assignments.join(gaps, id_col, "left").groupBy(arm_col).agg(
        F.count(F.lit(1)).alias("participants"), F.count("_n").alias("participants_with_gap_outcome"), F.coalesce(F.sum("_n"), F.lit(0)).alias("gap_outcome_events")
    )


def gap_sensitivity(
    assignments: DataFrame, events: DataFrame, *, window: timedelta, observation_end: Column, outcome_event: str = "converted", delivery_event: str = "delivered",
    eligible_col: str = "eligible_at", id_col: str = "participant_id", time_col: str = "assigned_at", event_col: str = "event_type", event_time_col: str = "event_at",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each assignment under two analyses, ``all_outcomes`` and ``without_gap``: (assignment columns, analysis, followup_complete,
    outcome, gap_outcome_events).

    An outcome event is in the gap if it falls at or after eligibility and before the unit's first delivery; the second analysis
    removes it and takes the next one that is left. Both come from one pass over the outcome events, which meet the
    unit's bounds once. Ids and times are held to what ``windowed_outcome`` asks.
    """
    require_columns(assignments, [id_col, time_col, eligible_col])
    require_columns(events, [id_col, event_col, event_time_col])
    require_instants(assignments, [time_col, eligible_col])
    require_instants(events, [event_time_col])
    base = required(assignments, [id_col, time_col, eligible_col], "assignment table")
    own = events.where(F.col(event_col).isin(outcome_event, delivery_event)).select(id_col, F.col(event_col).alias("_e"), F.col(event_time_col).alias("_t"))
    hot = hot_ids(own, id_col, rows=hot_rows)
    units = narrow_units(base.select(id_col, F.col(time_col).alias("_from"), F.col(eligible_col).alias("_eligible")), id_col, ["_from", "_eligible"])
    first = per_unit(own.where(F.col("_e") == delivery_event).drop("_e"), units, id_col, {"_first": F.min("_t")}, hot=hot)
    bounds = units.join(first, id_col, "left")
    gap = F.coalesce((F.col("_t") >= F.col("_eligible")) & (F.col("_t") < F.col("_first")), F.lit(False))
    inside = (F.col("_t") >= F.col("_from")) & (F.col("_t") < F.col("_from") + interval(window)) & (F.col("_t") <= observation_end)
    found = {"_all": F.bool_or(inside), "_kept": F.bool_or(inside & ~gap), "_gaps": F.count_if(gap)}
    seen = units.join(per_unit(own.where(F.col("_e") == outcome_event).drop("_e"), bounds, id_col, found, hot=hot), id_col, "left").drop("_from", "_eligible")
    complete = F.col(time_col) + interval(window) <= observation_end
    both = F.array(*[F.struct(F.lit(name).alias("analysis"), F.when(complete, F.coalesce(c, F.lit(False))).alias("outcome")) for name, c in (("all_outcomes", "_all"), ("without_gap", "_kept"))])
    out = base.join(seen, id_col, "left").withColumn("followup_complete", complete).withColumn("gap_outcome_events", F.coalesce("_gaps", F.lit(0)))
    return out.select(*assignments.columns, "followup_complete", "gap_outcome_events", F.inline(both))
