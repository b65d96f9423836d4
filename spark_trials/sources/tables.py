"""Declared schemas of the tables, and readers that take no other columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_trials.operators.contracts import ContractError, instant_states, require_exact_columns

DAY = "event_date"

_S, _TS, _B, _L, _D = T.StringType(), T.TimestampType(), T.BooleanType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


ASSIGNMENTS = _schema(participant_id=_S, experiment=_S, arm=_S, assigned_at=_TS, messages_delivered=_L, linked_before_entry=_B, converted_before_entry=_B)
EVENTS = _schema(participant_id=_S, event_type=_S, event_at=_TS)
ELIGIBLE = _schema(participant_id=_S, lifecycle_segment=_S, tenure_band=_S, assignment_wave=_S, eligible_at=_TS, assigned_at=_TS)
LEDGER = T.StructType([*ELIGIBLE.fields, *_schema(arm=_S, content=_S, cadence=_S, expected_probability=_D, randomization_version=_S).fields])
PROSPECTIVE_EVENTS = _schema(event_id=_S, participant_id=_S, event_type=_S, event_at=_TS, available_at=_TS, delivered_content=_S, delivered_cadence=_S)
REPLICATED_COUNTS = _schema(scenario=_S, replication=_L, outcome=_L, block=_L, arm=_L, n=_L, successes=_L)


#: Lossless steps from a file's type to the declared one.
WIDER = {("byte", "short"), ("byte", "int"), ("byte", "long"), ("short", "int"), ("short", "long"), ("int", "long"), ("float", "double")}
CORRUPT = "_corrupt_record"


def type_faults(found: T.StructType, declared: T.StructType) -> dict[str, str]:
    """Columns whose type in a file is neither the declared one nor one that widens to it: column to 'found, not declared'."""
    kinds = {f.name: f.dataType for f in found.fields}
    names = {"tinyint": "byte", "smallint": "short", "bigint": "long"}
    simple = lambda t: names.get(t.simpleString(), t.simpleString())
    pairs = {f.name: (simple(kinds[f.name]), simple(f.dataType)) for f in declared.fields if f.name in kinds}
    return {n: f"{a}, not {b}" for n, (a, b) in pairs.items() if a != b and (a, b) not in WIDER}


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """A table with a declared schema: its columns and no others, of the declared types or of ones that widen to them.

    A file with typed columns is held to its own schema, so a time that is stored as a string fails. Text formats are read by
    the schema, without inference, and bad rows fail; ``read_with_rejects`` sets them apart.
    """
    if fmt in ("csv", "json"):
        options = {"mode": "FAILFAST", **({"header": True} if fmt == "csv" else {}), **options}
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    df = spark.read.format(fmt).options(**options).load(path)
    require_exact_columns(df, schema.names)
    if faults := type_faults(df.schema, schema):
        raise ContractError("table has columns of other types: " + "; ".join(f"{n}: {what}" for n, what in sorted(faults.items())))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, fmt: str, *, required: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a text table: rows that keep the schema, typed, and all others as text with ``reasons``.

    Text is read as text, and each value is converted on its own, so a row says all that is wrong with it: ``<column>_invalid``
    (no value of its type), ``<column>_naive`` (a time without an offset, which means another moment in each session),
    ``<column>_missing`` (``required`` columns, all by default), or ``malformed`` (no record of these columns). One scan
    serves both tables if the caller keeps it.
    """
    if fmt not in ("csv", "json"):
        raise ContractError("rejects are of text formats; typed files fail as a whole")
    names = schema.names
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **({"header": True, "enforceSchema": False} if fmt == "csv" else {}), **options}
    raw = spark.read.format(fmt).options(**options).schema(texts).load(path)
    whole = F.col(CORRUPT).isNull()
    reasons, values = [F.when(~whole, "malformed")], {}
    for f in schema.fields:
        text, there = F.col(f.name), whole & F.col(f.name).isNotNull()
        if isinstance(f.dataType, T.TimestampType):
            value, state = instant_states(raw, f.name)
            reasons += [F.when(there & (state == "naive"), f"{f.name}_naive"), F.when(there & (state == "invalid"), f"{f.name}_invalid")]
        else:
            value = text.try_cast(f.dataType)
            reasons.append(F.when(there & value.isNull(), f"{f.name}_invalid"))
        if f.name in (names if required is None else required):
            reasons.append(F.when(whole & text.isNull(), f"{f.name}_missing"))
        values[f.name] = value
    marked = raw.withColumn("reasons", F.array_compact(F.array(*reasons)))
    rows = marked.where(F.size("reasons") == 0).select(*[values[n].alias(n) for n in names])
    return rows, marked.where(F.size("reasons") > 0).select(*names, F.col(CORRUPT).alias("record"), "reasons")


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(reason, rows); a row counts for each of its reasons."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def write_events(events: DataFrame, path: str, time_col: str = "event_at") -> None:
    """Events stored by day, so that a time range reads only its days. Days are brought together before, and adaptive execution
    splits large ones and joins small ones, so that neither a day of many events nor many days make odd files."""
    events.withColumn(DAY, F.to_date(time_col)).hint("rebalance", DAY).write.partitionBy(DAY).parquet(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType, *, since: datetime | None = None, until: datetime | None = None, time_col: str = "event_at") -> DataFrame:
    """Events of ``write_events`` at or after ``since`` and before ``until``; other days' folders are not opened."""
    stored = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    df = spark.read.parquet(path)
    require_exact_columns(df, stored.names)
    if faults := type_faults(df.schema, stored):
        raise ContractError("stored events have columns of other types: " + "; ".join(f"{n}: {what}" for n, what in sorted(faults.items())))
    if since is not None:
        df = df.where((F.col(DAY) >= F.to_date(F.lit(since))) & (F.col(time_col) >= F.lit(since)))
    if until is not None:
        df = df.where((F.col(DAY) <= F.to_date(F.lit(until))) & (F.col(time_col) < F.lit(until)))
    return df.select(*schema.names)


def window_bounds(assignments: DataFrame, window: timedelta, *, before: timedelta = timedelta(0), time_col: str = "assigned_at") -> dict[str, datetime | None]:
    """``since`` and ``until`` of all windows of a table of assignments, ``before`` them included: one row of two times."""
    first, last = assignments.agg(F.unix_micros(F.min(time_col)), F.unix_micros(F.max(time_col))).first()
    if first is None:
        return {"since": None, "until": None}
    at = lambda micros: datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)
    return {"since": at(first) - before, "until": at(last) + window}
