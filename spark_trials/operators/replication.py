"""A decision rule evaluated over a table of replicated counts.

Rows: (scenario, replication, outcome, block, arm, n, successes); arm 0 is the shared holdout. ``contrasts`` brings all
outcomes to one row for each arm; families, guardrails and the policy read that table. Everything is grouped within
(scenario, replication), so one exchange on these two serves the pairing, the contrasts, Holm and the policy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.functions import stats
from spark_trials.operators.contracts import settled
from spark_trials.operators.effects import sample_variance

REP = ("scenario", "replication")


def contrasts(counts: DataFrame, *, holdout: int | str = 0, alpha: float = 0.05) -> DataFrame:
    """For each replication, outcome and active arm: the block-standardized contrast, its error, interval, raw and Holm p, and
    the pooled counts of both arms.

    Blocks weigh alike. A block without the holdout or with fewer than two units in an arm, or a variance that is not
    positive, gives p = 1 and ``valid`` false; the row stays.
    """
    held = Window.partitionBy(*REP, "outcome", "block")
    control = F.max(F.when(F.col("arm") == holdout, F.struct("n", "successes"))).over(held)
    pairs = counts.repartition(*REP).withColumn("_c", control).where(F.col("arm") != holdout)
    n, m, s, c = F.col("n"), F.col("_c.n"), F.col("successes"), F.col("_c.successes")
    blocks = F.count(F.lit(1))
    made = pairs.groupBy(*REP, "outcome", "arm").agg(
        F.avg(s / F.nullif(n, F.lit(0)) - c / F.nullif(m, F.lit(0))).alias("risk_difference"),
        (F.sum(sample_variance(s, n) / F.nullif(n, F.lit(0)) + sample_variance(c, m) / F.nullif(m, F.lit(0))) / (blocks * blocks)).alias("_v"),
        blocks.alias("blocks"), F.count_if(m.isNull() | (m < 2) | (n < 2)).alias("_bad"),
        F.sum(n).alias("n"), F.sum(s).alias("successes"), F.sum(m).alias("control_n"), F.sum(c).alias("control_successes"),
    )
    made = made.withColumn("valid", F.coalesce((F.col("_bad") == 0) & (F.col("_v") > 0) & (F.col("_v") < float("inf")), F.lit(False)))
    made = made.withColumn("standard_error", F.when(F.col("valid"), F.sqrt("_v"))).drop("_v", "_bad")
    gap = F.lit(stats.z_two_sided(0.95)) * F.col("standard_error")
    made = made.withColumns({"ci_low": F.greatest(F.lit(-1.0), F.col("risk_difference") - gap), "ci_high": F.least(F.lit(1.0), F.col("risk_difference") + gap)})
    made = made.withColumns({k: F.when(F.col("valid"), F.col(k)) for k in ("ci_low", "ci_high")})
    made = made.withColumn("p_value", F.when(F.col("valid"), stats.normal_p(F.col("risk_difference") / F.col("standard_error"))).otherwise(F.lit(1.0)))
    made = stats.with_holm(made, "p_value", "p_value_holm", [*REP, "outcome"], ["arm"])
    made = made.withColumn("holm_reject", F.col("valid") & (F.col("p_value_holm") < alpha))
    return made.withColumn("superiority_pass", F.col("holm_reject") & (F.col("risk_difference") > 0))


def replicated_family(table: DataFrame, *, outcome: int | str) -> DataFrame:
    """The rows of one outcome of ``contrasts``: a family of its own."""
    return table.where(F.col("outcome") == outcome).drop("outcome", "n", "successes", "control_n", "control_successes")


def _bounds(margins: Mapping[int | str, float], alpha: float, comparisons: int) -> dict:
    margin = F.create_map(*[F.lit(x) for o, m in margins.items() for x in (o, float(m))])[F.col("outcome")]
    four = (F.col("successes"), F.nullif(F.col("n"), F.lit(0)), F.col("control_successes"), F.nullif(F.col("control_n"), F.lit(0)))
    return {"risk_difference": four[0] / four[1] - four[2] / four[3], "upper_bound": stats.upper_bound(*four, alpha / comparisons), "margin": margin}


def replicated_guardrails(table: DataFrame, margins: Mapping[int | str, float], *, alpha: float = 0.05, comparisons: int = 12) -> DataFrame:
    """For each replication, guardrail outcome and active arm: pooled difference, upper bound at alpha / 12, pass."""
    made = table.where(F.col("outcome").isin(*margins)).withColumns(_bounds(margins, alpha, comparisons))
    made = made.withColumn("noninferiority_pass", F.coalesce(F.col("upper_bound") < F.col("margin"), F.lit(False)))
    return made.select(*REP, "outcome", "arm", "n", "successes", "risk_difference", "upper_bound", "margin", "noninferiority_pass")


def replicated_policy(
    table: DataFrame, margins: Mapping[int | str, float], *, candidate: int | str, primary: int | str = 0, negative: int | str = 1,
    truth: DataFrame | None = None, alpha: float = 0.05, comparisons: int = 12,
) -> DataFrame:
    """One row for each replication with every flag of the policy, by one conditional aggregate over ``contrasts``.

    ``truth``: (scenario, arm, true_effect) of the primary outcome, for coverage.
    """
    own, first, control = F.col("arm") == candidate, F.col("outcome") == primary, F.col("outcome") == negative
    guard = F.col("outcome").isin(*margins)
    bound = _bounds(margins, alpha, comparisons)
    safe = F.coalesce(guard & (bound["upper_bound"] < bound["margin"]), F.lit(False))
    if truth is not None:
        table = table.join(F.broadcast(settled(truth)), ["scenario", "arm"], "left")  # a row for each scenario and arm, a thousand at most
        covers = F.coalesce(F.col("valid") & (F.col("ci_low") <= F.col("true_effect")) & (F.col("ci_high") >= F.col("true_effect")), F.lit(False))
    else:
        covers = F.lit(None).cast("boolean")
    made = table.groupBy(*REP).agg(
        F.bool_and(F.when(first | control, F.col("valid"))).alias("_valid"), F.count_if(first).alias("_first"), F.count_if(control).alias("_control"), F.count_if(guard & own).alias("_guards"),
        F.bool_or(first & F.col("holm_reject")).alias("_any_reject"), F.bool_or(first & F.col("superiority_pass")).alias("_any_superior"),
        F.bool_or(first & own & F.col("superiority_pass")).alias("_superior"), F.bool_or(F.when(first & own, covers)).alias("_covered"),
        F.bool_or(control & F.col("holm_reject")).alias("_neg"), F.bool_and(F.when(guard & own, safe)).alias("_safe"), F.bool_or(safe).alias("_any_safe"),
        F.max(F.when(first & own, F.col("risk_difference"))).alias("candidate_effect"),
    )
    # A family that is missing from a replication makes it invalid, as a contrast that cannot be made does.
    whole = (F.col("_first") > 0) & (F.col("_control") > 0) & (F.col("_guards") == len(margins))
    made = made.withColumn("invalid", ~F.coalesce(F.col("_valid") & whole, F.lit(False)))
    ok = ~F.col("invalid")
    out = made.select(
        *REP, "invalid", (ok & F.col("_any_reject")).alias("primary_family_any_holm_rejection"), (ok & F.col("_any_superior")).alias("primary_family_any_superiority"),
        (ok & F.col("_superior")).alias("candidate_superiority"), (ok & F.col("_covered")).alias("candidate_nominal_95_ci_coverage"),
        (ok & F.col("_neg")).alias("negative_control_family_any_holm_rejection"), (ok & ~F.col("_neg")).alias("negative_control_gate_pass"),
        (ok & F.col("_any_safe")).alias("guardrail_family_any_noninferiority_pass"), (ok & F.col("_safe")).alias("candidate_guardrails_pass"),
        (ok & ~F.col("_superior")).alias("primary_superiority_not_established"), "candidate_effect",
    )
    met = ok & F.col("negative_control_gate_pass") & F.col("candidate_superiority") & F.col("candidate_guardrails_pass")
    return out.withColumn("policy_criteria_met", met).withColumn("policy_continue_testing", ~F.col("policy_criteria_met"))


FLAGS = (
    "invalid", "primary_family_any_holm_rejection", "primary_family_any_superiority", "candidate_superiority", "candidate_nominal_95_ci_coverage",
    "negative_control_family_any_holm_rejection", "negative_control_gate_pass", "guardrail_family_any_noninferiority_pass", "candidate_guardrails_pass",
    "primary_superiority_not_established", "policy_criteria_met", "policy_continue_testing",
)


def _summary(rows: DataFrame, by: list[str], confidence: float) -> DataFrame:
    """Rows (by, flag): successes over all replications with a Wilson interval; a missing flag counts as false."""
    counts = rows.groupBy(*by).agg(F.count_if("flag").alias("successes"), F.count(F.lit(1)).alias("replications"))
    low, high = stats.wilson_around(F.col("successes"), F.col("replications"), stats.z_two_sided(confidence))
    return counts.withColumns({"rate": F.col("successes") / F.col("replications"), "ci_low": low, "ci_high": high})


def replicated_rates(
    policy: DataFrame, table: DataFrame, margins: Mapping[int | str, float], *, candidate: int | str, truth: DataFrame, primary: int | str = 0, confidence: float = 0.99
) -> DataFrame:
    """(scenario, metric, successes, replications, rate, interval): every policy flag, each arm's coverage and each
    guardrail of the candidate. Invalid replications stay in every denominator."""
    flags = policy.select("scenario", F.inline(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).alias("flag")) for f in FLAGS])))
    first, guard = F.col("outcome") == primary, F.col("outcome").isin(*margins) & (F.col("arm") == candidate)
    bound = _bounds(margins, 0.05, 12)
    covers = F.col("valid") & (F.col("ci_low") <= F.col("true_effect")) & (F.col("ci_high") >= F.col("true_effect"))
    rows = table.where(first | guard).join(F.broadcast(settled(truth)), ["scenario", "arm"], "left").join(policy.select(*REP, "invalid"), list(REP))
    metric = F.when(first, F.concat(F.lit("nominal_95_ci_coverage:"), F.col("arm").cast("string"))).otherwise(F.concat(F.lit("candidate_guardrail:"), F.col("outcome").cast("string")))
    hit = ~F.col("invalid") & F.coalesce(F.when(first, covers).otherwise(bound["upper_bound"] < bound["margin"]), F.lit(False))
    return _summary(flags.unionByName(rows.select("scenario", metric.alias("metric"), hit.alias("flag"))), ["scenario", "metric"], confidence)


def replicated_diagnostics(policy: DataFrame, truth: DataFrame, *, candidate: int | str) -> DataFrame:
    """By scenario: mean estimate of the candidate, its bias against the true effect, and empirical deviation."""
    own = truth.where(F.col("arm") == candidate).select("scenario", "true_effect")
    made = policy.groupBy("scenario").agg(F.avg("candidate_effect").alias("mean_estimate"), F.stddev_samp("candidate_effect").alias("empirical_sd"))
    return made.join(own, "scenario", "left").withColumn("monte_carlo_bias", F.col("mean_estimate") - F.col("true_effect"))


def calibration_gates(rates: DataFrame, *, null: str, strong: str, boundary: str) -> DataFrame:
    """(gate, observed, passed) from the rate rows: bounds against fixed thresholds over scenarios and arms."""

    def of(metric: str, scenario: str | None = None):
        hit = F.col("metric") == metric
        return hit if scenario is None else hit & (F.col("scenario") == scenario)

    coverage = F.col("metric").startswith("nominal_95_ci_coverage:") & (F.col("scenario") == null)
    one = rates.agg(
        F.max(F.when(of("primary_family_any_holm_rejection", null), F.col("ci_high"))).alias("null_primary_fwer"),
        F.max(F.when(of("negative_control_family_any_holm_rejection"), F.col("ci_high"))).alias("negative_control_fwer"),
        F.min(F.when(coverage, F.col("ci_low"))).alias("null_interval_coverage"),
        F.max(F.when(of("candidate_superiority", strong), F.col("ci_low"))).alias("strong_effect_detection"),
        F.max(F.when(of("guardrail_family_any_noninferiority_pass", boundary), F.col("ci_high"))).alias("boundary_false_noninferiority"),
        F.coalesce(F.sum(F.when(of("invalid"), F.col("successes"))), F.lit(0)).cast("double").alias("invalid_replications"),
    )
    limits = {
        "null_primary_fwer": lambda c: c <= 0.06, "negative_control_fwer": lambda c: c <= 0.06, "null_interval_coverage": lambda c: c >= 0.93,
        "strong_effect_detection": lambda c: c >= 0.99, "boundary_false_noninferiority": lambda c: c <= 0.06, "invalid_replications": lambda c: c == 0,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("observed"), F.coalesce(f(F.col(n)), F.lit(False)).alias("passed")) for n, f in limits.items()])
    return one.select(F.inline(rows))
