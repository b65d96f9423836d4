"""Stratified assignment to seven arms, the ledger contract, sample-ratio audits and the ledger digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.functions.stats import chi_square_tail, with_holm
from spark_trials.operators.contracts import ContractError, blank_rules, count_rules, require_exact_columns, require_none

# The design's levels, block columns and version.
CONTENTS = ("current", "challenger_a", "challenger_b")
CADENCES = ("daily", "twice_weekly")
HOLDOUT = "holdout"
ACTIVE_ARMS = tuple(f"{content}__{cadence}" for content in CONTENTS for cadence in CADENCES)
ARMS = (HOLDOUT, *ACTIVE_ARMS)
BLOCKS = ("lifecycle_segment", "tenure_band", "assignment_wave")
ELIGIBLE = ("participant_id", *BLOCKS, "eligible_at", "assigned_at")
LEDGER = (*ELIGIBLE, "arm", "content", "cadence", "expected_probability", "randomization_version")
VERSION = "stratified-permuted-block-v1"
PROBABILITY = 1.0 / len(ARMS)


def block_key(seed: int | str, id_col: str = "participant_id", blocks: Sequence[str] = BLOCKS) -> Column:
    """The hash that orders a block: of seed, block and id, so of nothing about row order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *blocks, id_col), 256)


def ranks(df: DataFrame, blocks: Sequence[str], key: Column, *, prefix: int = 2) -> DataFrame:
    """``df`` with ``_rank``, from 0, of each row in its block by ``key`` (a hexadecimal hash).

    A hash is uniform, so its first digits split a block evenly: rows are numbered within (block, prefix), and the counts
    of the smaller prefixes, a table of a few hundred rows for each block, say where each part starts. A plain row
    number would put a whole block, millions of rows, in one task.
    """
    keyed = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, prefix))
    counts = keyed.groupBy(*blocks, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*blocks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*blocks, "_part").orderBy("_key")
    met = keyed.withColumn("_k", F.row_number().over(within) - 1).join(starts, [*blocks, "_part"])
    return met.withColumn("_rank", F.col("_start") + F.col("_k")).drop("_key", "_part", "_start", "_k")


def with_factors(df: DataFrame) -> DataFrame:
    """Content and cadence of an arm, null for the holdout."""
    active = F.col("arm") != HOLDOUT
    return df.withColumn("content", F.when(active, F.split_part("arm", F.lit("__"), F.lit(1)))).withColumn(
        "cadence", F.when(active, F.split_part("arm", F.lit("__"), F.lit(2)))
    )


def arm_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ARMS]), (rank % len(ARMS) + 1).cast("int"))


def assign(eligible: DataFrame, *, seed: int | str, check: bool = True) -> DataFrame:
    """The ledger: every block dealt in equal parts to the seven arms, in the order of a keyed hash.

    A block whose size is no multiple of the number of arms fails. Labels depend on (seed, block, id) alone.
    """
    require_exact_columns(eligible, ELIGIBLE)
    if check:
        require_none(eligible_violations(eligible), "eligible table")
        sizes = eligible.groupBy(*BLOCKS).count()
        if odd := sizes.where(F.col("count") % len(ARMS) != 0).count():
            raise ContractError(f"{odd} blocks are no multiple of {len(ARMS)}")
    dealt = with_factors(ranks(eligible, BLOCKS, block_key(seed)).withColumn("arm", arm_of(F.col("_rank"))))
    return dealt.select(*ELIGIBLE, "arm", "content", "cadence", F.lit(PROBABILITY).alias("expected_probability"), F.lit(VERSION).alias("randomization_version"))


def eligible_violations(eligible: DataFrame) -> DataFrame:
    rules = blank_rules(eligible, ["participant_id", *BLOCKS])
    rules |= {"time_missing": F.col("eligible_at").isNull() | F.col("assigned_at").isNull(), "eligible_after_assigned": F.col("eligible_at") > F.col("assigned_at")}
    return count_rules(eligible, rules)


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """(rule, violations) of the ledger's row rules, in one pass."""
    require_exact_columns(ledger, LEDGER)
    holdout, p = F.col("arm") == HOLDOUT, F.col("expected_probability")
    active = F.col("arm").isin(*ACTIVE_ARMS)
    gone = F.col("content").isNull() | F.col("cadence").isNull()
    rules = blank_rules(ledger, ["participant_id", *BLOCKS, "arm", "randomization_version"]) | {
        "time_missing": F.col("eligible_at").isNull() | F.col("assigned_at").isNull(),
        "eligible_after_assigned": F.col("eligible_at") > F.col("assigned_at"),
        "unknown_arm": F.col("arm").isNotNull() & ~F.col("arm").isin(*ARMS),
        "wrong_version": F.col("randomization_version") != VERSION,
        "holdout_with_factors": holdout & (F.col("content").isNotNull() | F.col("cadence").isNotNull()),
        "active_without_factors": active & gone,
        "unknown_content": F.col("content").isNotNull() & ~F.col("content").isin(*CONTENTS),
        "unknown_cadence": F.col("cadence").isNotNull() & ~F.col("cadence").isin(*CADENCES),
        "arm_not_its_factors": active & ~gone & (F.col("arm") != F.concat_ws("__", "content", "cadence")),
        "probability_not_finite": p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")),
        "probability_not_equal_share": ~F.isnan(p) & (F.abs(p - PROBABILITY) > 1e-15),
    }
    return count_rules(ledger, rules)


def arm_counts(ledger: DataFrame, blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """One row for each block: the count of every arm, zeros included."""
    return ledger.groupBy(*blocks).agg(*[F.count_if(F.col("arm") == a).alias(a) for a in ARMS])


def exact_allocation(ledger: DataFrame) -> DataFrame:
    """Blocks with their least and greatest arm count, and whether all arms are there and equal."""
    counts = arm_counts(ledger)
    low, high = F.least(*[F.col(a) for a in ARMS]), F.greatest(*[F.col(a) for a in ARMS])
    return counts.select(*BLOCKS, low.alias("least"), high.alias("greatest"), ((low == high) & (low > 0)).alias("exact"))


def validate_ledger(ledger: DataFrame) -> None:
    from spark_trials.operators.contracts import validate_unique_key

    validate_unique_key(ledger, ["participant_id"], "ledger")
    require_none(ledger_violations(ledger), "ledger")
    if bad := exact_allocation(ledger).where("not exact").count():
        raise ContractError(f"allocation is not exact in {bad} blocks")


def _chi_square(counts: DataFrame) -> DataFrame:
    n = sum((F.col(a) for a in ARMS[1:]), F.col(ARMS[0]))
    expected = n * PROBABILITY
    statistic = sum((F.pow(F.col(a) - expected, 2) / expected for a in ARMS[1:]), F.pow(F.col(ARMS[0]) - expected, 2) / expected)
    out = counts.withColumn("sample_size", n).withColumn("expected_per_arm", expected).withColumn("chi_square", statistic)
    return out.withColumn("p_value", chi_square_tail(F.col("chi_square"), len(ARMS) - 1))


def sample_ratio(ledger: DataFrame, *, blocks: Sequence[str] = BLOCKS, alpha: float = 0.01) -> DataFrame:
    """Chi-square of the arm counts overall (scope ``overall``, its own gate) and in each block (one Holm family).

    The overall counts are sums of the block counts, so the ledger is read once.
    """
    counts = arm_counts(ledger, blocks)
    overall = _chi_square(counts.agg(*[F.sum(a).alias(a) for a in ARMS])).withColumn("p_value_holm", F.col("p_value"))
    overall = overall.withColumn("scope", F.lit("overall")).withColumns({b: F.lit(None).cast("string") for b in blocks})
    tested = with_holm(_chi_square(counts).withColumn("scope", F.lit("block")), "p_value", "p_value_holm", ["scope"], list(blocks))
    both = tested.withColumns({b: F.col(b).cast("string") for b in blocks}).unionByName(overall)
    return both.withColumn("passed", F.col("p_value_holm") >= alpha).select("scope", *blocks, *ARMS, "sample_size", "expected_per_arm", "chi_square", "p_value", "p_value_holm", "passed")


def row_digest() -> Column:
    """SHA-256 of a ledger row: fields parted by the unit separator, nulls as empty strings."""
    stamp = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for c in ("eligible_at", "assigned_at")]
    fields = ["participant_id", *BLOCKS, *stamp, "arm", "content", "cadence", F.format_string("%.17g", "expected_probability"), "randomization_version"]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields]), 256)


def ledger_digest(ledger: DataFrame, *, prefix: int = 4) -> DataFrame:
    """One row: the digest and the number of rows. Buckets are prefixes of the hashed id, so any partitioning gives the
    same digest: a tree of rows in id order within a bucket, buckets within their first two digits, and these in order. No
    task gets more than a bucket, one row in 65,536, or as many digests as there are hexadecimal numbers of half its digits."""
    rows = ledger.select(F.substring(F.sha2("participant_id", 256), 1, prefix).alias("bucket"), "participant_id", row_digest().alias("digest"))
    buckets = rows.groupBy("bucket").agg(_digest_of("participant_id").alias("digest"), F.count(F.lit(1)).alias("n"))
    tops = buckets.groupBy(F.substring("bucket", 1, prefix // 2).alias("top")).agg(_digest_of("bucket").alias("digest"), F.sum("n").alias("n"))
    return tops.agg(_digest_of("top").alias("ledger_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def _digest_of(order: str) -> Column:
    """The digest of a group's digests, in the order of a column."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda r: r["digest"]), "\n"), 256)


def reused_blocks(df: DataFrame, group: str, *, position: str = "position", arm: str = "arm", part: int = 4096) -> DataFrame:
    """Groups whose whole ordered arm sequence another group has too: group, sequence hash, groups with it.

    A group is digested in parts of ``part`` positions, and the parts' digests in order, so no task holds the arms of a group.
    """
    keyed = df.select(group, F.floor(F.col(position) / part).alias("_part"), F.col(position).alias("_at"), F.col(arm).alias("_arm"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_arm"))), lambda r: r["_arm"])
    parts = keyed.groupBy(group, "_part").agg(F.sha2(F.array_join(ordered, ","), 256).alias("digest"))
    hashes = parts.groupBy(group).agg(_digest_of("_part").alias("sequence_sha256"))
    sharing = hashes.groupBy("sequence_sha256").agg(F.count(F.lit(1)).alias("groups"))
    return hashes.join(sharing, "sequence_sha256").select(group, "sequence_sha256", "groups", (F.col("groups") > 1).alias("reused"))
