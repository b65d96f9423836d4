"""Families of active arms against a shared holdout, guardrails, quality gates and the launch decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.functions import stats
from spark_trials.operators.assignment import BLOCKS, HOLDOUT
from spark_trials.operators.contracts import ContractError, binary_rules, require_columns, require_none
from spark_trials.operators.effects import block_effects, paired_with_control, with_binary_effect

# The decision rule's gates, guardrails and method names.
GATES = (
    "assignment_contract", "exact_block_allocation", "sample_ratio", "concurrent_holdout", "aligned_14_day_followup", "complete_followup_and_latency_buffer",
    "no_contamination", "active_delivery_coverage", "pre_period_negative_control", "itt_population_preserved",
)
GUARDRAILS = ("unsubscribe_14d", "complaint_14d")
BLOCK_METHOD = ("block_standardized_difference_in_means", "stratified_neyman_conservative", "nominal_normal_not_simultaneous")
POOLED_METHOD = ("pooled_difference_in_proportions", "pooled_score_and_newcombe_not_block_adjusted", "nominal_newcombe_not_simultaneous")
GUARDRAIL_METHOD = ("pooled_difference_in_proportions", "pooled_newcombe_style_bonferroni_not_block_adjusted")
CELLS = 6


def _listed(one: DataFrame) -> DataFrame:
    """(rule, violations) of a row of counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in one.columns])
    return one.select(F.inline(pairs))


def _different(values: Column) -> Column:
    """How many different values, nulls aside, an array has."""
    return F.size(F.array_distinct(F.array_compact(values)))


def factorial_violations(df: DataFrame, outcomes: Sequence[str], *, id_col: str = "participant_id", holdout: str = HOLDOUT, blocks: Sequence[str] = ()) -> DataFrame:
    """(rule, violations) of a factorial frame: ids, arms, the complete 3 x 2 grid, holdout without factors, outcomes, block labels.

    Rows are counted by cell, a handful of rows that the shape of the grid is read from too; only ids meet besides.
    """
    held = F.col("arm") == holdout
    rules = {
        "id_missing": F.col(id_col).isNull(), "arm_blank": F.col("arm").isNull() | (F.trim("arm") == ""),
        "holdout_with_factors": held & (F.col("content").isNotNull() | F.col("cadence").isNotNull()),
        "active_without_factors": ~held & (F.col("content").isNull() | F.col("cadence").isNull()),
    }
    for o in outcomes:
        rules |= binary_rules(df, o)
    rules |= {f"{b}_missing": F.col(b).isNull() | (F.trim(F.col(b).cast("string")) == "") for b in blocks}
    cells = df.groupBy("arm", "content", "cadence").agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    active = F.when(F.col("arm") != holdout, F.col("arm"))
    grid = F.when(F.col("arm") != holdout, F.struct("content", "cadence"))
    shape = {
        "active_arms_not_six": F.abs(F.countDistinct(active) - CELLS), "grid_cells_not_six": F.abs(F.size(F.collect_set(grid)) - CELLS),
        "arm_in_more_cells": F.abs(F.count(active) - F.countDistinct(active)), "holdout_absent": F.when(F.count_if(F.col("arm") == holdout) > 0, 0).otherwise(1),
        "contents_not_three": F.abs(F.size(F.collect_set(F.when(F.col("arm") != holdout, F.col("content")))) - 3),
    }
    one = cells.agg(*[F.sum(name).alias(name) for name in rules], *[c.alias(name) for name, c in shape.items()])
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("duplicate_id"))
    return _listed(one).unionByName(_listed(repeated))


def validate_factorial_frame(df: DataFrame, outcomes: Sequence[str], *, id_col: str = "participant_id", holdout: str = HOLDOUT, blocks: Sequence[str] = ()) -> DataFrame:
    """``df`` as it is, or an error with the counts of the rules it breaks; a frame without rows breaks them too."""
    require_columns(df, [id_col, "arm", "content", "cadence", *outcomes, *blocks])
    require_none(factorial_violations(df, outcomes, id_col=id_col, holdout=holdout, blocks=blocks), "factorial frame")
    return df


def arm_cube(df: DataFrame, outcomes: Sequence[str], blocks: Sequence[str] = BLOCKS, *, holdout: str = HOLDOUT, check: bool = True) -> DataFrame:
    """(blocks, arm, n, one sum for each outcome): the one pass over rows that all families start from.

    The frame is validated first (``check``): what a repeated unit or an outcome of 2 did cannot be seen in the sums.
    """
    if check:
        validate_factorial_frame(df, outcomes, holdout=holdout, blocks=blocks)
    return df.groupBy(*blocks, "arm").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(o).cast("long")).alias(o) for o in outcomes])


def cube_violations(cube: DataFrame, outcomes: Sequence[str], *, holdout: str = HOLDOUT, blocks: Sequence[str] | None = BLOCKS) -> DataFrame:
    """(rule, violations) of a count cube: six active arms and the holdout, whole counts, and in every block the same number
    of units, two at least, in all seven arms (where ``blocks`` are named)."""
    n, rows = F.col("n"), F.count(F.lit(1))
    rules = {"arm_missing": F.col("arm").isNull(), "count_not_positive": n.isNull() | (n < 1)}
    rules |= {f"{o}_not_a_count": F.coalesce((F.col(o) < 0) | (F.col(o) > n), F.lit(True)) for o in outcomes}
    sums = [F.count_if(c).alias(name) for name, c in rules.items()]
    by = cube.groupBy(*(blocks or [])).agg(*sums, F.collect_set("arm").alias("_arms"), rows.alias("_rows"), F.min("n").alias("_low"), F.max("n").alias("_high"))
    arms = F.array_distinct(F.flatten(F.collect_list("_arms")))
    shape = {"active_arms_not_six": F.abs(F.size(F.array_except(arms, F.array(F.lit(holdout)))) - CELLS), "holdout_absent": (~F.array_contains(arms, holdout)).cast("int")}
    if blocks:
        odd = (F.size("_arms") != CELLS + 1) | (F.col("_rows") != CELLS + 1) | (F.col("_low") != F.col("_high")) | (F.col("_low") < 2)
        shape["blocks_not_balanced"] = F.count_if(odd)
    return _listed(by.agg(*[F.sum(name).alias(name) for name in rules], *[c.alias(name) for name, c in shape.items()]))


def _alpha(alpha: float) -> float:
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)) or not 0.0 < alpha < 1.0:
        raise ContractError("alpha must be between 0 and 1")
    return float(alpha)


def primary_family(
    cube: DataFrame, *, outcome: str = "funded_14d", holdout: str = HOLDOUT, alpha: float = 0.05, blocks: Sequence[str] | None = BLOCKS, check: bool = True
) -> DataFrame:
    """Six active arms against the holdout: block-standardized, or pooled where ``blocks`` is None; Holm over the six.

    A cube that lacks the holdout or an arm, in a block or in all of them, or whose blocks are unequal fails (``check``).
    """
    alpha = _alpha(alpha)
    if check:
        require_columns(cube, [*(blocks or []), "arm", "n", outcome])
        require_none(cube_violations(cube, [outcome], holdout=holdout, blocks=blocks), "count cube")
    by_arm = cube.groupBy("arm").agg(F.sum("n").alias("n"), F.sum(outcome).alias("successes"))
    pooled = paired_with_control(by_arm, holdout, [])
    pooled = pooled.select(
        "arm", F.col("successes").alias("treatment_successes"), F.col("n").alias("treatment_total"),
        F.col("control_successes"), F.col("control_n").alias("control_total"),
    )
    pooled = with_binary_effect(pooled)
    rr = ["relative_risk", "relative_risk_ci_low", "relative_risk_ci_high"]
    if blocks is None:
        method = POOLED_METHOD
        rows = pooled.withColumns({"standard_error": F.lit(None).cast("double"), "block_count": F.lit(0).cast("long"), "block_columns": F.lit(None).cast("string")})
    else:
        method = BLOCK_METHOD
        made = block_effects(cube.select(*blocks, "arm", "n", F.col(outcome).alias("successes")), holdout, blocks=blocks)
        rows = made.join(pooled.select("arm", *rr), "arm").withColumn("block_columns", F.lit("|".join(blocks)))
    named = rows.select(
        F.lit("primary_funding_itt").alias("family"), F.concat(F.col("arm"), F.lit(f"_vs_{holdout}")).alias("comparison_id"), F.lit(outcome).alias("outcome"),
        F.col("arm").alias("active_arm"), F.lit(holdout).alias("comparator_arm"), F.col("treatment_successes").alias("active_successes"),
        F.col("treatment_total").alias("active_total"), F.col("control_successes").alias("holdout_successes"), F.col("control_total").alias("holdout_total"),
        F.col("treatment_rate").alias("active_rate"), F.col("control_rate").alias("holdout_rate"), F.col("absolute_effect").alias("risk_difference"),
        F.col("standard_error").alias("risk_difference_standard_error"), F.col("absolute_ci_low").alias("risk_difference_ci_low_nominal"),
        F.col("absolute_ci_high").alias("risk_difference_ci_high_nominal"), *rr, "p_value_two_sided", F.lit(method[0]).alias("estimator"),
        F.lit(method[1]).alias("variance_estimator"), F.lit(method[2]).alias("interval_method"), "block_columns", "block_count",
    )
    out = stats.with_holm(named, "p_value_two_sided", "p_value_holm", ["family"], ["active_arm"])
    out = out.withColumns({"family_size": F.lit(CELLS), "family_alpha": F.lit(float(alpha)), "holm_significant": F.col("p_value_holm") < alpha})
    return out.withColumn("superiority_pass", F.col("holm_significant") & (F.col("risk_difference") > 0.0))


def guardrail_family(cube: DataFrame, margins: Mapping[str, float], *, holdout: str = HOLDOUT, alpha: float = 0.05, check: bool = True) -> DataFrame:
    """Each guardrail and active arm, over all randomized units: an upper bound at alpha / 12, strictly under the margin.

    A cube that lacks the holdout or an arm, or whose sums are no counts, fails (``check``).
    """
    outcomes, alpha = list(margins), _alpha(alpha)
    if len(outcomes) != 2 or any(isinstance(m, bool) or not 0.0 <= float(m) < 1.0 for m in margins.values()):
        raise ContractError("two guardrails with margins in [0, 1) are needed")
    if check:
        require_columns(cube, ["arm", "n", *outcomes])
        require_none(cube_violations(cube, outcomes, holdout=holdout, blocks=None), "count cube")
    size = CELLS * len(outcomes)
    by_arm = cube.groupBy("arm").agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in outcomes])
    long = by_arm.select("arm", "n", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(float(m)).alias("noninferiority_margin"), F.col(o).alias("successes")) for o, m in margins.items()])))
    rows = paired_with_control(long.select("arm", "outcome", "n", "successes", "noninferiority_margin"), holdout, ["outcome"])
    rows = rows.withColumnsRenamed({"arm": "active_arm", "n": "active_total", "successes": "active_successes", "control_n": "holdout_total", "control_successes": "holdout_successes"})
    four = [F.col(c) for c in ("active_successes", "active_total", "holdout_successes", "holdout_total")]
    rows = rows.withColumns(
        {
            "active_rate": four[0] / four[1], "holdout_rate": four[2] / four[3], "risk_difference": four[0] / four[1] - four[2] / four[3],
            "relative_risk_supplementary": stats.relative_risk(*four, stats.z_two_sided(0.95))[0],
            "simultaneous_one_sided_upper_bound": stats.upper_bound(*four, alpha / size),
        }
    )
    rows = rows.withColumn("noninferiority_pass", F.col("simultaneous_one_sided_upper_bound") < F.col("noninferiority_margin"))
    harmful = F.col("risk_difference") >= F.col("noninferiority_margin")
    return rows.withColumns(
        {
            "conclusion": F.when(F.col("noninferiority_pass"), "noninferior").when(harmful, "harmful_or_over_margin").otherwise("inconclusive"),
            "family": F.lit("rollout_blocking_guardrails_itt"), "comparator_arm": F.lit(holdout), "point_estimator": F.lit(GUARDRAIL_METHOD[0]),
            "uncertainty_method": F.lit(GUARDRAIL_METHOD[1]), "block_adjusted_uncertainty": F.lit(False), "family_size": F.lit(size),
            "family_alpha": F.lit(float(alpha)), "bonferroni_alpha_each": F.lit(alpha / size),
            "comparison_id": F.concat_ws("", F.col("outcome"), F.lit(":"), F.col("active_arm"), F.lit(f"_vs_{holdout}")),
        }
    )


def negative_control(family: DataFrame, significant: str = "holm_significant") -> DataFrame:
    """One row: passed if no comparison of the family is rejected."""
    return family.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(significant).alias("rejections"), (~F.bool_or(significant)).alias("passed"))


def gate_rows(gates: dict[str, DataFrame | bool]) -> DataFrame:
    """(gate, passed) rows of one-row tables with a boolean ``passed``, or of plain booleans."""
    frames = [g.select(F.lit(n).alias("gate"), "passed") for n, g in gates.items() if isinstance(g, DataFrame)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    fixed = [F.struct(F.lit(n).alias("gate"), F.lit(v).alias("passed")) for n, v in gates.items() if not isinstance(v, DataFrame)]
    return out.unionByName(out.sparkSession.range(1).select(F.inline(F.array(*fixed)))) if fixed else out


def _near(a: Column, b: Column, relative: float = 0.0, absolute: float = 1e-15) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def _gathered(primary: DataFrame, guardrails: DataFrame, gates: DataFrame) -> DataFrame:
    """One row of three arrays: six, twelve and ten rows by contract, so all rules are expressions over one row."""
    tables = {"primary": primary, "guards": guardrails, "gates": gates}
    one = [df.agg(F.collect_list(F.struct(*df.columns)).alias(name)) for name, df in tables.items()]
    return one[0].join(one[1], F.lit(True)).join(one[2], F.lit(True))


def _holm_of(rows: Column) -> Column:
    """The rows' (p, arm, adjusted p before the running maximum), by p and then arm."""
    ordered = F.array_sort(F.transform(rows, lambda r: F.struct(r["p_value_two_sided"].alias("p"), r["active_arm"].alias("arm"))))
    return F.transform(ordered, lambda r, k: F.struct(r.alias("key"), F.least(F.lit(1.0), r["p"] * (F.size(rows) - k)).alias("adjusted")))


def _primary_rules(r: Column, holm: Column) -> dict[str, Column]:
    p, h, d, se, low, high = (r[c] for c in ("p_value_two_sided", "p_value_holm", "risk_difference", "risk_difference_standard_error", "risk_difference_ci_low_nominal", "risk_difference_ci_high_nominal"))
    z, lost = stats.z_two_sided(0.95), F.lit(False)
    for c in (d, se, p, h, low, high):
        lost = lost | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    key = F.struct(p.alias("p"), r["active_arm"].alias("arm"))
    again = F.array_max(F.transform(F.filter(holm, lambda x: x["key"] <= key), lambda x: x["adjusted"]))
    method = [r[c] == v for c, v in zip(("estimator", "variance_estimator", "interval_method"), BLOCK_METHOD, strict=True)]
    return {
        "primary_number_missing": lost | r["superiority_pass"].isNull() | r["block_count"].isNull(),
        "primary_method": ~F.coalesce(method[0] & method[1] & method[2], F.lit(False)),
        "primary_blocks": ~F.coalesce((r["block_columns"] == "|".join(BLOCKS)) & (r["block_count"] > 0), F.lit(False)),
        "primary_family": (r["family_size"] != CELLS) | ~_near(r["family_alpha"], F.lit(0.05)),
        "primary_range": ~(p.between(0.0, 1.0) & h.between(0.0, 1.0) & (se > 0)),
        "primary_raw_p": ~_near(p, stats.erfc(F.abs(d / se) / 2**0.5), 1e-12),
        "primary_holm_p": ~_near(h, again, 1e-12),
        "primary_interval": ~(_near(low, F.greatest(F.lit(-1.0), d - z * se), 1e-12) & _near(high, F.least(F.lit(1.0), d + z * se), 1e-12)),
        "primary_pass": r["superiority_pass"] != ((h < r["family_alpha"]) & (d > 0)),
    }


def _guard_rules(r: Column) -> dict[str, Column]:
    size = CELLS * len(GUARDRAILS)
    method = (r["point_estimator"] == GUARDRAIL_METHOD[0]) & (r["uncertainty_method"] == GUARDRAIL_METHOD[1]) & ~r["block_adjusted_uncertainty"]
    return {
        "guardrail_outcome": ~r["outcome"].isin(*GUARDRAILS),
        "guardrail_method": ~F.coalesce(method, F.lit(False)),
        "guardrail_family": (r["family_size"] != size) | ~_near(r["family_alpha"], F.lit(0.05)) | ~_near(r["bonferroni_alpha_each"], r["family_alpha"] / size),
        "guardrail_margin": ~F.coalesce((r["noninferiority_margin"] >= 0) & (r["noninferiority_margin"] < 1), F.lit(False)),
        "guardrail_pass": ~r["noninferiority_pass"].eqNullSafe(r["simultaneous_one_sided_upper_bound"] < r["noninferiority_margin"]),
    }


def decision_violations(primary: DataFrame, guardrails: DataFrame, gates: DataFrame) -> DataFrame:
    """(rule, violations): counts, methods and ranges, and all numbers that can be recomputed from the others.

    The three tables become arrays of one row, and each row's broken rules are named by one pass over its array, so the
    plan has three aggregates whatever the number of rules.
    """
    p, g, q, size = F.col("primary"), F.col("guards"), F.col("gates"), CELLS * len(GUARDRAILS)

    def named(rules: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))

    met = _gathered(primary, guardrails, gates).withColumn("holm", _holm_of(p))
    met = met.withColumn("broken", F.flatten(F.concat(F.transform(p, lambda r: named(_primary_rules(r, F.col("holm")))), F.transform(g, lambda r: named(_guard_rules(r))))))
    arms = F.transform(p, lambda r: r["active_arm"])

    def times(name: str) -> Column:
        return F.size(F.filter("broken", lambda b: b == name))

    counts = {name: times(name) for name in [*_primary_rules(p[0], F.col("holm")), *_guard_rules(g[0])]}
    counts |= {
        "primary_rows_not_six": F.abs(F.size(p) - CELLS), "primary_arms_repeat": F.size(p) - _different(arms),
        "primary_block_counts_differ": F.abs(_different(F.transform(p, lambda r: r["block_count"])) - 1), "guardrail_rows_not_twelve": F.abs(F.size(g) - size),
        "guardrail_rows_repeat": F.size(g) - _different(F.transform(g, lambda r: F.struct(r["active_arm"], r["outcome"]))),
        "guardrail_arm_unknown": F.size(F.filter(g, lambda r: ~F.coalesce(F.array_contains(arms, r["active_arm"]), F.lit(False)))),
        "gates_missing": len(GATES) - _different(F.transform(F.filter(q, lambda r: r["gate"].isin(*GATES) & r["passed"].isNotNull()), lambda r: r["gate"])),
    }
    return _listed(met.select(*[c.alias(name) for name, c in counts.items()]))


def launch_decision(primary: DataFrame, guardrails: DataFrame, gates: DataFrame, *, candidate: str | None, check: bool = True) -> DataFrame:
    """One row: status, candidate, ordered reasons and failed gates, for an arm named before, never the largest effect.

    Reasons: failed gates by name, then the primary comparison, then guardrails by name. Without reasons the criteria are
    met. Inconsistent input fails (``check``).
    """
    if check:
        require_none(decision_violations(primary, guardrails, gates), "decision input")
        if candidate is not None and not primary.where(F.col("active_arm") == candidate).limit(1).count():
            raise ContractError("candidate is not one of the active arms")
    own = lambda r: r["active_arm"] == candidate
    out = _gathered(primary, guardrails, gates).withColumn("failed_gates", F.array_sort(F.transform(F.filter("gates", lambda r: ~r["passed"]), lambda r: r["gate"])))
    if candidate is None:
        out = out.withColumn("_more", F.array(F.lit("pre_specified_candidate_required")))
    else:
        won = F.exists("primary", lambda r: F.coalesce(own(r) & r["superiority_pass"], F.lit(False)))
        weak = F.array_sort(F.transform(F.filter("guards", lambda r: own(r) & ~r["noninferiority_pass"]), lambda r: r["outcome"]))
        named = F.transform(weak, lambda o: F.concat(F.lit("guardrail_noninferiority_not_established:"), o))
        out = out.withColumn("_more", F.concat(F.when(won, F.array().cast("array<string>")).otherwise(F.array(F.lit("primary_superiority_not_established"))), named))
    reasons = F.concat(F.transform("failed_gates", lambda g: F.concat(F.lit("quality_gate_failed:"), g)), F.col("_more"))
    out = out.withColumn("reasons", reasons)
    status = F.when(F.size("reasons") == 0, "criteria_met").otherwise("continue_testing")
    return out.select(status.alias("status"), F.lit(candidate).cast("string").alias("candidate_arm"), "reasons", "failed_gates")
