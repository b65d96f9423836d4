"""Strictly ordered funnels and delivery-exposure risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.functions.stats import wilson, z_two_sided
from spark_trials.operators.contracts import FIRST_INSTANT, ContractError, count_rules, exposure_rules, insist, require_columns, require_instants, require_none, required, settled
from spark_trials.operators.units import HOT_ROWS, apart, hot_ids, narrow_units


def funnel_membership(
    events: DataFrame, stages: Sequence[str], *, cohort: DataFrame | None = None, id_col: str = "participant_id", event_col: str = "event_type",
    time_col: str = "event_at", entry_time_col: str = "assigned_at", day_gap: int | None = None, fail_on_orphan_events: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each member with ``<stage>_at`` and ``<stage>_reached``: the first time of a stage strictly after the one before.

    A stage is a round: its events, with a row for each member beside them, meet the members' entry and earlier stages, and the
    least time after those is kept, a minimum with partial sums and no window or list. A round is one join and one aggregate in
    the order of that join, and its result is the next one's table of members, so a task sorts each stage's events once and holds
    no table of ids; what it holds does not grow with the square of the stages. Ids of very many events (``units.hot_ids``) have
    rounds of their own, in which their few times go to the events and the events stay where they are.

    With ``day_gap`` a stage must fall that many calendar days after the one before. Members without events are kept; without a
    cohort, members are the ids of stage events. With one, its ids must be there and differ, and stage events of unknown ids
    fail, or are passed over without ``fail_on_orphan_events``; all of that is found in the same pass.
    """
    require_columns(events, [id_col, event_col, time_col])
    require_instants(events, [time_col])
    if not stages or len({*stages}) != len(stages):
        raise ContractError("stages must be distinct and not empty")
    work = events.where(F.col(event_col).isin(*stages)).select(id_col, F.col(event_col).alias("_e"), F.col(time_col).alias("_t"))
    hot = hot_ids(work, id_col, rows=hot_rows)
    if cohort is None:
        base = required(work.select(id_col), [id_col], "event table").distinct()
        units = base.withColumn("_entry", F.lit(FIRST_INSTANT).cast("timestamp"))
    else:
        require_instants(cohort, [entry_time_col])
        base = required(cohort, [id_col, entry_time_col], "cohort")
        units = narrow_units(cohort.select(id_col, F.col(entry_time_col).alias("_entry")), id_col, ["_entry"])
    known = cohort is not None and fail_on_orphan_events

    def after(k: int) -> Column:
        """Whether an event counts for stage k of a member at ``_entry`` and, in the stage before, ``_last``."""
        late = F.col("_t") >= F.col("_entry")
        if k == 0:
            return late
        apart_ = F.col("_t") > F.col("_last") if day_gap is None else F.to_date("_t") >= F.date_add(F.to_date("_last"), day_gap)
        return late & apart_

    (some, many), (of_some, of_many), (members, of_hot) = apart(work, id_col, hot), apart(units, id_col, hot), apart(base, id_col, hot)
    own = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    state, done = of_some, []
    for k, stage in enumerate(stages):
        rows, beside = some.where(F.col("_e") == stage).select(id_col, "_t"), members.select(id_col, F.lit(None).cast("timestamp").alias("_t"))
        rows = required(rows, [id_col], "event table") if known else rows
        if k == 0:  # later rounds have the member's own columns from the one before
            rows, beside = rows.withColumn("_own", F.lit(None)), members.select(id_col, F.lit(None).cast("timestamp").alias("_t"), own.alias("_own"))
        met = rows.unionByName(beside).join(state.withColumn("_known", F.lit(True)), id_col, "left" if known else "inner")
        before = [F.min(c).alias(c) for c in ("_entry", *done)]
        at = f"{stage}_at"
        state = met.groupBy(id_col).agg(*before, F.first("_own", ignorenulls=True).alias("_own"), F.min(F.when(after(k), F.col("_t"))).alias(at), F.count_if(F.col("_known").isNull()).alias("_lost"))
        # the member's own row is read whatever is asked of the result, so that the aggregate is one in the order of the join
        rules = {"rows_of_unknown_participants": F.col("_lost"), "member_without_entry": F.col("_entry").isNull(), "member_without_row": F.col("_own").isNull()}
        done.append(at)
        state = insist(state, rules, "event table").drop("_lost").withColumn("_last", F.col(at))
    out = state.select("_own.*", *done)
    if many is not None:
        for k, stage in enumerate(stages):
            of_many = settled_rounds(many.where(F.col("_e") == stage), of_many, id_col, after(k), f"{stage}_at")
        out = out.unionByName(of_hot.join(F.broadcast(of_many.select(id_col, *done)), id_col).select(*base.columns, *done))
    out = out.withColumns({f"{s}_reached": F.col(f"{s}_at").isNotNull() for s in stages})
    return out.select(*base.columns, *[c for s in stages for c in (f"{s}_at", f"{s}_reached")])


def settled_rounds(events: DataFrame, state: DataFrame, id_col: str, after: Column, at: str) -> DataFrame:
    """``state`` with the time of one more stage for the few hot ids, held as a local table that the next round sends out."""
    state = settled(state)
    hits = events.join(F.broadcast(state), id_col).where(after).groupBy(id_col).agg(F.min("_t").alias(at))
    return settled(state.drop("_last").join(hits, id_col, "left").withColumn("_last", F.col(at)))


def new_link_funnel(
    events: DataFrame, cohort: DataFrame, stages: Sequence[str], *, linked_before: str = "linked_before_entry", converted_before: str = "converted_before_entry", **options
) -> DataFrame:
    """The funnel of the whole cohort, checked first, then only members neither linked nor converted before entry."""
    require_columns(cohort, [linked_before, converted_before])
    require_none(count_rules(cohort, {c: F.col(c).isNull() for c in (linked_before, converted_before)}), "cohort")
    return funnel_membership(events, stages, cohort=cohort, **options).where(~F.col(linked_before) & ~F.col(converted_before))


def funnel_summary(membership: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(position, stage, users, rate_from_population, rate_from_previous); a rate on no users is null."""
    one = membership.agg(F.count(F.lit(1)).alias("_p"), *[F.count_if(f"{s}_reached").alias(f"_{k}") for k, s in enumerate(stages)])
    rows = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("position"), F.lit(s).alias("stage"), F.col(f"_{k}").alias("users"),
                (F.col(f"_{k}") / F.nullif(F.col("_p"), F.lit(0))).alias("rate_from_population"),
                (F.col(f"_{k}") / F.nullif(F.col(f"_{k - 1}" if k else "_p"), F.lit(0))).alias("rate_from_previous"),
            )
            for k, s in enumerate(stages)
        ]
    )
    return one.select(F.inline(rows))


def exposure_risk(
    cohort: DataFrame, events: DataFrame, *, event: str = "unsubscribed", by: str = "arm", exposure_col: str = "messages_delivered",
    id_col: str = "participant_id", event_col: str = "event_type", check: bool = True,
) -> DataFrame:
    """By group, among actual recipients only: recipients, people with the event, events, deliveries and both rates.

    An id that lacks or repeats, an event of a participant with no delivery or of an unknown one, a group that lacks and an
    exposure that is no count fail (``check``): they are counted in the aggregate that makes the figures. The name of the
    event is a parameter, so the same job reports bounces and delivery failures.
    """
    require_columns(cohort, [id_col, by, exposure_col])
    own = events.where(F.col(event_col) == event).select(id_col)
    units = cohort.select(id_col, by, exposure_col, F.lit(True).alias("_known"))
    if check:
        own, units = required(own, [id_col], "event table"), required(units, [id_col], "cohort")
        # the window shares the partitioning and the order of the join
        units = units.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    counts = own.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    work = units.join(counts, id_col, "full_outer" if check else "left").fillna(0, ["_n"])
    sent = F.col(exposure_col) > 0
    people, ones, total, exposed = F.count_if(sent), F.count_if(sent & (F.col("_n") > 0)), F.sum(F.when(sent, F.col("_n"))), F.sum(F.when(sent, F.col(exposure_col).cast("double")))
    figures = [
        people.alias("actual_recipients"), ones.alias("unique_people"), total.alias("events"), exposed.alias("delivered_exposures"),
        (ones / F.nullif(people, F.lit(0))).alias("unique_user_risk"), (1000.0 * total / exposed).alias("events_per_1000_deliveries"),
    ]
    rules = {}
    if check:
        known = F.col("_known").isNotNull()
        rules = {"event_of_unknown_participant": ~known, "repeated_id": F.col("_copies") > 1, "group_missing": known & F.col(by).isNull()}
        rules |= {name: known & c for name, c in exposure_rules(cohort, exposure_col).items()} | {"event_without_exposure": (F.col(exposure_col) == 0) & (F.col("_n") > 0)}
    made = work.groupBy(by).agg(*figures, *[F.count_if(c).alias(f"_{name}") for name, c in rules.items()])
    made = insist(made, {name: F.col(f"_{name}") for name in rules}, "exposure table") if check else made
    return made.where("actual_recipients > 0").drop(*[f"_{name}" for name in rules])


def subject_messages(events: DataFrame, *, subject: str, message: str, time_col: str, flags: dict[str, F.Column]) -> DataFrame:
    """Provider events brought to one row for each subject and message: first time, number of events, flags."""
    return events.groupBy(subject, message).agg(
        F.min(time_col).alias("first_at"), F.count(F.lit(1)).alias("provider_events"), *[F.bool_or(c).alias(n) for n, c in flags.items()]
    )


def open_rates(pairs: DataFrame, *, template: str = "template", opened: str = "opened", confidence: float = 0.95) -> DataFrame:
    """By template over subject-template pairs: observed, missing, opened, rate and Wilson limits of the observed ones."""
    z = z_two_sided(confidence)
    counts = pairs.groupBy(template).agg(
        F.count(opened).alias("observed"), F.count_if(F.col(opened).isNull()).alias("missing"), F.count_if(F.col(opened)).alias("opens")
    )
    n = F.nullif(F.col("observed"), F.lit(0))
    low, high = wilson(F.col("opens"), n, z)
    return counts.withColumns({"open_rate": F.col("opens") / n, "ci_low": low, "ci_high": high})
