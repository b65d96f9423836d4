"""Reports: aggregate rows as JSON, numbers that are not finite as null."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_trials.operators.contracts import ContractError


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of number columns become null."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            changed[f.name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns(changed) if changed else df


def _value(df: DataFrame, name: str, digits: int | None) -> Column:
    """The JSON text of a column."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if digits is not None and isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits) + F.lit(0.0))  # without a negative zero
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    else:
        inside = F.to_json(F.array(c))
        text = inside.substr(F.lit(2), F.length(inside) - 2)
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))


def records(df: DataFrame, *, digits: int | None = None) -> DataFrame:
    """One JSON object for each row, keys sorted. With ``digits`` numbers with a point are written with so many after it, so that
    equal rows are equal texts wherever they are made."""
    df = finite(df)
    parts = [F.concat(F.lit(f"{json.dumps(c)}:"), _value(df, c, digits)) for c in sorted(df.columns)]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))


def document(sections: dict[str, DataFrame], *, digits: int | None = None) -> DataFrame:
    """One row, one JSON object: for each section the array of its ``records``, keys and rows sorted as texts.

    Sections are aggregates of tens of rows; row tables have no place in a report.
    """
    out, texts = None, []
    for k, name in enumerate(sorted(sections)):
        own = records(sections[name], digits=digits).agg(F.array_join(F.array_sort(F.collect_list("record")), ",").alias(f"s{k}"))
        out = own if out is None else out.join(own, F.lit(True))
        texts.append(F.concat(F.lit(f"{json.dumps(name)}:["), F.col(f"s{k}"), F.lit("]")))
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}")).alias("report"))


def write_document(report: DataFrame, path: str, *, label: str) -> None:
    """Write the one-row report as text; the name of the destination must carry the declared label."""
    if label not in path.rstrip("/").rsplit("/", 1)[-1]:
        raise ContractError("the destination's name must carry the report's label")
    report.coalesce(1).write.text(path)
