"""Effects of arms on binary outcomes, from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.functions import stats
from spark_trials.operators.contracts import insist, missing

COUNTS = ("treatment_successes", "treatment_total", "control_successes", "control_total")


def with_binary_effect(counts: DataFrame, *, confidence: float = 0.95) -> DataFrame:
    """Counts of two arms (``COUNTS``) with rates, risk difference, relative risk, z and p; null where an arm is empty."""
    z = stats.z_two_sided(confidence)
    four = [F.nullif(F.col(c), F.lit(0)) if c.endswith("total") else F.col(c) for c in COUNTS]
    ts, tn, cs, cn = four
    low, high = stats.newcombe(*four, z)
    rr, rr_low, rr_high = stats.relative_risk(*four, z)
    out = counts.withColumns(
        {
            "treatment_rate": ts / tn, "control_rate": cs / cn, "absolute_effect": ts / tn - cs / cn, "absolute_ci_low": low, "absolute_ci_high": high,
            "relative_risk": rr, "relative_risk_ci_low": rr_low, "relative_risk_ci_high": rr_high, "z_statistic": stats.pooled_z(*four),
        }
    )
    return out.withColumn("p_value_two_sided", stats.normal_p(F.col("z_statistic")))


def arm_counts(
    df: DataFrame, by: Sequence[str], *, arm: str = "arm", outcome: str = "outcome", treatment: str = "treatment", control: str = "control", check: bool = True
) -> DataFrame:
    """The four counts of each group in one pass. A row of any other arm, an outcome that is missing (censored rows are to be
    left out before) or not 0 or 1 fails in the same pass (``check``)."""
    t, c = F.col(arm) == treatment, F.col(arm) == control
    gone, value = missing(df, outcome), F.col(outcome).cast("double")
    four = [F.count_if(t & (value == 1)), F.count_if(t), F.count_if(c & (value == 1)), F.count_if(c)]
    rules = {"arm_not_declared": ~(t | c) | F.col(arm).isNull(), "outcome_missing": gone, "outcome_not_binary": ~gone & ~value.isin(0.0, 1.0)} if check else {}
    made = df.groupBy(*by).agg(*[x.alias(n) for x, n in zip(four, COUNTS, strict=True)], *[F.count_if(r).alias(f"_{n}") for n, r in rules.items()])
    return insist(made, {n: F.col(f"_{n}") for n in rules}, "comparison").drop(*[f"_{n}" for n in rules]) if check else made


def compare_groups(
    df: DataFrame, *, experiment: str = "experiment", family: Sequence[str] = (), arm: str = "arm", outcome: str = "outcome", treatment: str = "treatment",
    control: str = "control", confidence: float = 0.95, check: bool = True,
) -> DataFrame:
    """Treatment against control in every experiment, with Holm and Benjamini-Hochberg over all of a family.

    A group that lacks an arm or has another one, and an outcome that is missing or not binary, fail in the same pass (``check``).
    """
    counts = arm_counts(df, [*family, experiment], arm=arm, outcome=outcome, treatment=treatment, control=control, check=check)
    if check:
        counts = insist(counts, {"arm_without_rows": ((F.col("treatment_total") == 0) | (F.col("control_total") == 0)).cast("int")}, "comparison")
    return adjust(with_binary_effect(counts, confidence=confidence), list(family), [experiment])


def adjust(effects: DataFrame, family: list[str], keys: list[str], p: str = "p_value_two_sided") -> DataFrame:
    """Holm and Benjamini-Hochberg columns. Without a family column all rows, one for each comparison, are one family."""
    named = effects if family else effects.withColumn("_family", F.lit(1))
    out = stats.with_holm(named, p, "p_value_holm", family or ["_family"], keys)
    return stats.with_bh(out, p, "p_value_bh", family or ["_family"], keys).drop("_family")


def with_mde(counts: DataFrame, *, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Counts with the smoothed control rate and the detectable lift at it."""
    base = (F.col("control_successes") + 0.5) / (F.col("control_total") + 1.0)
    return counts.withColumn("smoothed_control_rate", base).withColumn(
        "approximate_mde", stats.mde(F.col("smoothed_control_rate"), F.col("control_total"), F.col("treatment_total"), alpha=alpha, power=power)
    )


def paired_with_control(counts: DataFrame, control: str, keys: Sequence[str], *, arm: str = "arm", values: Sequence[str] = ("n", "successes")) -> DataFrame:
    """Rows of the active arms of a count table with the control's values of the same key as ``control_<value>``; null where
    a key lacks the control, so that no row goes.

    The table is aggregated: a handful of rows for each key, joined to itself on the key.
    """
    own = counts.where(F.col(arm) == control).select(*keys, *[F.col(v).alias(f"control_{v}") for v in values])
    active = counts.where(F.col(arm) != control)
    return active.join(own, list(keys), "left") if keys else active.join(own, F.lit(True), "left")


def sample_variance(successes: Column, n: Column) -> Column:
    """Variance (n - 1) of n binary values, from counts; null of fewer than two."""
    rate = successes / F.nullif(n, F.lit(0))
    return rate * (1.0 - rate) * n / F.nullif(n - 1, F.lit(0))


def block_effects(counts: DataFrame, control: str, *, blocks: Sequence[str], family: Sequence[str] = (), arm: str = "arm", confidence: float = 0.95) -> DataFrame:
    """Block-standardized risk differences of all arms against ``control``, from counts (family, blocks, arm, n, successes).

    A block weighs its share of the two arms' rows; the variance is the stratified Neyman one. Blocks that lack one of the two
    arms, or have unequal or fewer than two rows in them, are counted in ``bad_blocks``; a variance that is not positive, or
    a bad block, sets ``valid`` false, and then p is 1: rows are never dropped.
    """
    z = stats.z_two_sided(confidence)
    pairs = paired_with_control(counts, control, [*family, *blocks], arm=arm)
    n, m = F.col("n"), F.col("control_n")
    pairs = pairs.withColumns(
        {
            "_w": n + F.coalesce(m, F.lit(0)), "_t": F.col("successes") / F.nullif(n, F.lit(0)), "_c": F.col("control_successes") / F.nullif(m, F.lit(0)),
            "_v": sample_variance(F.col("successes"), n) / F.nullif(n, F.lit(0)) + sample_variance(F.col("control_successes"), m) / F.nullif(m, F.lit(0)),
            "_bad": F.coalesce((n != m) | (n < 2), F.lit(True)),
        }
    )
    total = F.sum("_w")
    out = pairs.groupBy(*family, arm).agg(
        F.sum("successes").alias("treatment_successes"), F.sum("n").alias("treatment_total"), F.sum("control_successes").alias("control_successes"),
        F.sum("control_n").alias("control_total"), (F.sum(F.col("_w") * F.col("_t")) / total).alias("treatment_rate"),
        (F.sum(F.col("_w") * F.col("_c")) / total).alias("control_rate"), (F.sum(F.col("_w") * F.col("_w") * F.col("_v")) / total / total).alias("_var"),
        F.count(F.lit(1)).alias("block_count"), F.count_if("_bad").alias("bad_blocks"),
    )
    # Blocks of any arm that this one is not in are bad as well.
    all_ = counts.groupBy(*family).agg(F.countDistinct(F.struct(*blocks)).alias("_all"))
    out = out.join(all_, list(family)) if family else out.join(all_, F.lit(True))
    out = out.withColumn("bad_blocks", F.col("bad_blocks") + F.col("_all") - F.col("block_count")).drop("_all")
    valid = F.coalesce((F.col("bad_blocks") == 0) & (F.col("_var") > 0.0) & (F.col("_var") < float("inf")) & ~F.isnan("_var"), F.lit(False))
    out = out.withColumn("valid", valid).withColumn("absolute_effect", F.col("treatment_rate") - F.col("control_rate"))
    out = out.withColumn("standard_error", F.when(F.col("valid"), F.sqrt("_var"))).drop("_var")
    gap = F.lit(z) * F.col("standard_error")
    out = out.withColumns(
        {
            "absolute_ci_low": F.greatest(F.lit(-1.0), F.col("absolute_effect") - gap), "absolute_ci_high": F.least(F.lit(1.0), F.col("absolute_effect") + gap),
            "z_statistic": F.when(F.col("valid"), F.col("absolute_effect") / F.col("standard_error")).otherwise(F.lit(0.0)),
        }
    )
    out = out.withColumn("p_value_two_sided", F.when(F.col("valid"), stats.normal_p(F.col("z_statistic"))).otherwise(F.lit(1.0)))
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("absolute_ci_low", "absolute_ci_high")})


def compare_blocks(df: DataFrame, *, treatment: str, control: str, outcome: str, blocks: Sequence[str], arm: str = "arm", check: bool = True) -> DataFrame:
    """One block-standardized comparison from rows, which are read once.

    Other arms, block labels that lack, outcomes that are missing or not binary, blocks without equal arms of two rows or more and a
    variance that is not positive fail in the same pass (``check``): all of it shows in the counts of blocks and arms.
    """
    if not check:
        own = df.where(F.col(arm).isin(treatment, control))
        return block_effects(own.groupBy(*blocks, arm).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("int")).alias("successes")), control, blocks=blocks, arm=arm)
    gone, value = missing(df, outcome), F.col(outcome).cast("double")
    rows = F.count(F.lit(1))
    counts = df.groupBy(*blocks, arm).agg(
        rows.alias("n"), F.count_if(value == 1).alias("successes"), F.count_if(gone).alias("_gone"), F.count_if(~gone & ~value.isin(0.0, 1.0)).alias("_odd")
    )
    unnamed = F.lit(False)
    for b in blocks:
        unnamed = unnamed | F.col(b).isNull() | (F.trim(F.col(b).cast("string")) == "")
    t, c = F.col(arm) == treatment, F.col(arm) == control
    # one row, whatever the input, so that an empty one fails too
    whole = counts.agg(
        F.sum(F.when(F.col(arm).isNull() | ~(t | c), F.col("n"))).alias("arm_not_declared"), F.sum(F.when(unnamed, F.col("n"))).alias("block_label_missing"),
        F.sum("_gone").alias("outcome_missing"), F.sum("_odd").alias("outcome_not_binary"),
        F.when((F.count_if(t) == 0) | (F.count_if(c) == 0), 1).alias("arm_without_rows"),
    )
    rules = whole.columns
    made = block_effects(counts.drop("_gone", "_odd"), control, blocks=blocks, arm=arm)
    met = insist(whole, {r: F.col(r) for r in rules}, "comparison").join(made, F.lit(True), "left").drop(*rules)
    return insist(met, {"block_without_equal_arms": F.col("bad_blocks"), "variance_not_positive": (~F.col("valid")).cast("int")}, "comparison")


def standardized_differences(df: DataFrame, covariates: Sequence[str], *, by: Sequence[str] = (), arm: str = "arm", treatment: str = "treatment", control: str = "control") -> DataFrame:
    """(by, covariate, means, smd): difference of means over the root of the mean variance, before treatment."""
    aggs, rows = [], []
    for k, c in enumerate(covariates):
        for side, value in (("t", treatment), ("c", control)):
            own = F.when(F.col(arm) == value, F.col(c).cast("double"))
            aggs += [F.avg(own).alias(f"_{side}m{k}"), F.var_samp(own).alias(f"_{side}v{k}")]
        spread = F.sqrt((F.col(f"_tv{k}") + F.col(f"_cv{k}")) / 2.0)
        gap = F.col(f"_tm{k}") - F.col(f"_cm{k}")
        rows.append(F.struct(F.lit(c).alias("covariate"), F.col(f"_tm{k}").alias("treatment_mean"), F.col(f"_cm{k}").alias("control_mean"), (gap / F.nullif(spread, F.lit(0.0))).alias("smd")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def cadence_contrast(df: DataFrame, *, stratum: str, outcomes: Sequence[str], cadence: str = "cadence", treatment: str = "twice_weekly", control: str = "daily") -> DataFrame:
    """One cadence against the other within strata; each outcome is its own Holm and BH family."""
    long = df.select(stratum, cadence, F.inline(F.array(*[F.struct(F.lit(o).alias("outcome_name"), F.col(o).cast("int").alias("_y")) for o in outcomes])))
    counts = arm_counts(long, ["outcome_name", stratum], arm=cadence, outcome="_y", treatment=treatment, control=control)
    return adjust(with_binary_effect(counts), ["outcome_name"], [stratum])


def aggregate_control(treated: DataFrame, controls: DataFrame, *, key: str, cell: str) -> DataFrame:
    """Rows (key, cell, treatment counts) against the key's shared control snapshot: one family, Holm and BH."""
    met = treated.join(controls.select(key, "control_successes", "control_total"), key)
    return adjust(with_binary_effect(met), [], [key, cell])
