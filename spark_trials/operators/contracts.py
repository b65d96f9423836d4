"""Table contracts. Every check counts violations; no message holds a value of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The range of instants that 64-bit nanoseconds hold.
FIRST_INSTANT, LAST_INSTANT = "1677-09-21 00:12:43.145224 UTC", "2262-04-11 23:47:16.854775 UTC"


class ContractError(ValueError):
    """A table breaks its contract; the message says which rule and how many rows."""


def require_unique_columns(df: DataFrame) -> None:
    if extra := len(df.columns) - len({*df.columns}):
        raise ContractError(f"table has {extra} repeated column names")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    require_unique_columns(df)
    if missing := {*columns} - {*df.columns}:
        raise ContractError(f"table lacks {len(missing)} required columns")


def require_exact_columns(df: DataFrame, columns: Sequence[str]) -> None:
    require_unique_columns(df)
    missing, extra = {*columns} - {*df.columns}, {*df.columns} - {*columns}
    if missing or extra:
        raise ContractError(f"table lacks {len(missing)} columns and has {len(extra)} others")


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN for numbers."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all rules in one pass; a rule is true where a row breaks it."""
    one = df.agg(*[F.coalesce(F.count_if(c), F.lit(0)).cast("long").alias(name) for name, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return one.select(F.inline(pairs))


def require_none(violations: DataFrame, what: str) -> None:
    """Fail with the counts of the rules that are broken."""
    broken = [f"{r['rule']}: {r['violations']}" for r in violations.where("violations > 0").orderBy("rule").collect()]
    if broken:
        raise ContractError(f"{what} breaks its contract: {', '.join(broken)}")


def insist(df: DataFrame, rules: Mapping[str, Column], what: str) -> DataFrame:
    """``df`` as it is, whose job fails at a row that breaks a rule: no pass of its own.

    A rule is a count, null or 0 where the row keeps it; the message has the counts of the row that failed. The error is
    Spark's own, since it is found while the table is read. The condition ends in the number of the
    partition, never negative: predicates are not moved below a filter that is not deterministic, so neither a join nor a
    filter that reads only some of the rows has the others skipped before they are checked.
    """
    counts = {name: F.coalesce(c.cast("long"), F.lit(0)) for name, c in rules.items()}
    broken = F.lit(False)
    for c in counts.values():
        broken = broken | (c > 0)
    said = F.concat_ws(", ", *[F.when(c > 0, F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in counts.items()])
    return df.where(F.when(broken, F.raise_error(F.concat(F.lit(f"{what} breaks its contract: "), said)).cast("boolean")).otherwise(F.spark_partition_id() >= 0))


def required(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """``df``, whose job fails at a null in one of the columns. The column itself fails, not a filter beside it, which a join
    by that column would have skip the nulls first."""
    gone = {c: F.raise_error(F.lit(f"{what} breaks its contract: missing {c}")).cast(df.schema[c].dataType) for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), error) for c, error in gone.items()})


def text_instant(text: Column) -> Column:
    """A UTC instant of a string with an explicit offset; null for any other."""
    full = F.regexp_replace(F.trim(text), r"T(\d\d:\d\d)(Z|[+-]\d\d:?\d\d)$", "T$1:00$2")
    colon = F.regexp_replace(full, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(has_offset(text), colon.try_cast("timestamp"))


def has_offset(text: Column) -> Column:
    return F.trim(text).rlike(r"(Z|[+-]\d\d:?\d\d)$")


def _in_range(instant: Column) -> Column:
    return (instant >= F.lit(FIRST_INSTANT).cast("timestamp")) & (instant <= F.lit(LAST_INSTANT).cast("timestamp"))


def instant_states(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(instant, state): state is ok, naive (no offset) or invalid (null, not a time, or out of range)."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        return c, F.when(_in_range(c), "ok").otherwise("invalid")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(None).cast("timestamp"), F.when(c.isNull(), "invalid").otherwise("naive")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp"), F.lit("invalid")
    instant = text_instant(c)
    plain = F.regexp_replace(F.trim(c), r"T(\d\d:\d\d)$", "T$1:00").try_cast("timestamp_ntz")
    state = F.when(instant.isNotNull() & _in_range(instant), "ok").when(~has_offset(c) & plain.isNotNull(), "naive").otherwise("invalid")
    return F.when(state == "ok", instant), state


def parse_instants(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column as UTC instants; fails with the counts of naive and invalid values."""
    instant, state = instant_states(df, column)
    counts = df.agg(F.count_if(state == "naive"), F.count_if(state == "invalid")).first()
    if counts[0] or counts[1]:
        raise ContractError(f"time column has {counts[0]} values without a timezone and {counts[1]} invalid ones")
    return df.withColumn(column, instant)


def instant_literal(value: str | datetime) -> Column:
    """One instant with a timezone as a literal."""
    at = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    if at.tzinfo is None:
        raise ContractError("time needs a timezone")
    return F.lit(at.isoformat()).cast("timestamp")


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(rule, violations): rows with a missing key part, and all rows that share their whole key with another."""
    require_columns(df, key)
    gap = F.lit(False)
    for k in key:
        gap = gap | missing(df, k)
    groups = df.withColumn("_gap", gap).groupBy(*key, "_gap").agg(F.count(F.lit(1)).alias("_n"))
    one = groups.agg(
        F.coalesce(F.sum(F.when(F.col("_gap"), F.col("_n"))), F.lit(0)).cast("long").alias("missing_key"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("long").alias("duplicate_key"),
    )
    return one.select(F.expr("stack(2, 'missing_key', missing_key, 'duplicate_key', duplicate_key) as (rule, violations)"))


def validate_unique_key(df: DataFrame, key: Sequence[str], what: str = "table") -> None:
    require_none(key_violations(df, key), what)


def binary_rules(df: DataFrame, column: str, *, allow_missing: bool = False) -> dict[str, Column]:
    gap = missing(df, column)
    value = F.col(column).cast("double")
    rules = {f"{column}_not_binary": ~gap & ~value.isin(0.0, 1.0)}
    return rules if allow_missing else rules | {f"{column}_missing": gap}


def as_binary(df: DataFrame, column: str, *, allow_missing: bool = False) -> DataFrame:
    """The column as 0/1 integers; any other value fails."""
    require_none(count_rules(df, binary_rules(df, column, allow_missing=allow_missing)), column)
    return df.withColumn(column, F.when(~missing(df, column), F.col(column).cast("int")))


def blank_rules(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Complete strings that are not blank."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ContractError(f"column {c} must hold strings")
    return {f"{c}_blank": F.col(c).isNull() | (F.trim(c) == "") for c in columns}


def exposure_rules(df: DataFrame, column: str) -> dict[str, Column]:
    """Counts: finite, not negative, whole."""
    value = F.col(column).cast("double")
    gap = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return {f"{column}_not_finite": gap, f"{column}_negative": ~gap & (value < 0), f"{column}_not_whole": ~gap & (value != F.floor(value))}


def settled(df: DataFrame, rows: int = 1000) -> DataFrame:
    """A table of a few rows by contract, such as a family, the gates or the times of hot ids, computed once and held as a local
    table, so that what reads it does not run again what it comes from. A larger table is no such thing and fails."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ContractError(f"a table that is settled has at most {rows} rows")
    return df.sparkSession.createDataFrame(found, df.schema)


def orphans(events: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Events of ids that ``known`` does not have. Only the ids of ``known`` take part."""
    return events.join(known.select(id_col), id_col, "left_anti")


def without_orphans(events: DataFrame, known: DataFrame, id_col: str, *, fail: bool = True) -> DataFrame:
    if not fail:
        return events.join(known.select(id_col), id_col, "left_semi")
    if n := orphans(events, known, id_col).count():
        raise ContractError(f"events have {n} rows of unknown participants")
    return events


def require_instants(df: DataFrame, columns: Sequence[str]) -> None:
    """Time columns must hold instants: a time without a timezone means another moment in each session."""
    naive = [c for c in columns if not isinstance(df.schema[c].dataType, T.TimestampType)]
    if naive:
        raise ContractError(f"{len(naive)} time columns hold no instants with a timezone")


def one_to_one_audit(left: DataFrame, right: DataFrame, on: Sequence[str], *, suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Full outer join on unique keys with ``in_left`` and ``in_right``; names that clash get the suffixes."""
    clash = ({*left.columns} & {*right.columns}) - {*on}
    left = left.select(*on, *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns if c not in on], F.lit(True).alias("in_left"))
    right = right.select(*on, *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in on], F.lit(True).alias("in_right"))
    return left.join(right, list(on), "full_outer").withColumns({s: F.coalesce(s, F.lit(False)) for s in ("in_left", "in_right")})


def one_to_one_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, how: str = "inner", require_match: str = "both", suffixes: tuple[str, str] = ("_left", "_right")
) -> tuple[DataFrame, Observation]:
    """An audited join: unique keys on both sides, and no row unmatched on the sides that ``require_match`` names.

    Returns the rows that ``how`` asks for and an observation, whose ``get`` has the counts of unmatched rows once the rows have been
    read. One join and no further pass: keys are counted in the exchange that the join needs, and what breaks the contract
    fails while the rows are read.
    """
    if how not in ("inner", "left", "right", "outer") or require_match not in ("both", "left", "right", "none"):
        raise ContractError("unknown join option")

    def once(df: DataFrame, what: str) -> DataFrame:
        counted = required(df, on, what).withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*on)))
        return insist(counted, {"duplicate_key": F.when(F.col("_copies") > 1, F.col("_copies"))}, what).drop("_copies")

    met = one_to_one_audit(once(left, "left table"), once(right, "right table"), on, suffixes=suffixes)
    rules = {}
    if require_match in ("both", "left"):
        rules["unmatched_left"] = (~F.col("in_right")).cast("int")
    if require_match in ("both", "right"):
        rules["unmatched_right"] = (~F.col("in_left")).cast("int")
    counts = Observation()
    met = met.observe(counts, F.count_if(~F.col("in_right")).alias("left_unmatched"), F.count_if(~F.col("in_left")).alias("right_unmatched"))
    met = insist(met, rules, "one-to-one join") if rules else met
    keep = {"inner": F.col("in_left") & F.col("in_right"), "left": F.col("in_left"), "right": F.col("in_right"), "outer": F.lit(True)}[how]
    return met.where(keep).drop("in_left", "in_right"), counts


def amplification(rows: DataFrame, joined: DataFrame, id_col: str) -> DataFrame:
    """Rows and distinct subjects before and after a join, and the ratio of rows."""
    sides = [df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids")) for df in (rows, joined)]
    before, after = sides[0].toDF("rows_before", "subjects_before"), sides[1].toDF("rows_after", "subjects_after")
    ratio = F.col("rows_after") / F.nullif(F.col("rows_before"), F.lit(0))
    return before.join(after, F.lit(True)).withColumn("amplification", ratio)
