"""Events meet their units by id: checks inside the join's own exchange, and ids of very many events apart.

An id is one key of a join, so all its events would meet in one task. Ids with about ``HOT_ROWS`` events or more are found
in a sample of the id column; only how rows are joined depends on it, never a result. Their events stay where they are: the few
units of these ids are sent to them, and partial sums are all that moves. All others are joined by a shuffle and
aggregated in the same partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.operators.contracts import insist, required

#: From so many events on an id is hot; the sample has about ``DRAWN`` events of such an id. At most ``MOST_HOT`` ids are set apart.
HOT_ROWS, DRAWN, MOST_HOT = 1 << 18, 256, 1000


def hot_ids(events: DataFrame, id_col: str, *, rows: int | None = HOT_ROWS) -> list:
    """The ids that are set apart, commonest first; without ``rows`` none is looked for."""
    if rows is None:
        return []
    share = max(1, rows // DRAWN)
    ids = events.select(id_col).where(F.col(id_col).isNotNull())
    drawn = ids.sample(1.0 / share, seed=17) if share > 1 else ids
    counts = drawn.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(1, rows // share // 2))
    return [r[0] for r in counts.orderBy(F.desc("_n"), id_col).limit(MOST_HOT).collect()]


def apart(df: DataFrame, id_col: str, hot: Sequence) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary ids, rows of hot ones)."""
    if not hot:
        return df, None
    its = F.coalesce(F.col(id_col).isin(*hot), F.lit(False))
    return df.where(~its), df.where(its)


def narrow_units(units: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, columns) of units, whose ids must be there and differ. The columns are numbers or times.

    The count that shows a repeat is made in the exchange by id that the join needs anyway.
    """
    own = required(units.select(id_col, *columns), [id_col], "table of units")
    made = own.groupBy(id_col).agg(*[F.min(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    return insist(made, {"repeated_id": F.when(F.col("_n") > 1, F.col("_n"))}, "table of units").drop("_n")


def per_unit(
    events: DataFrame, units: DataFrame, id_col: str, aggregates: Mapping[str, Column], *, fail_on_orphans: bool = True, hot: Sequence = (), what: str = "event table"
) -> DataFrame:
    """(id, aggregates) of the ids that have events: each event meets its unit (one row an id) and is summed up.

    Events without an id, or of ids that are no unit, fail in the same pass; without ``fail_on_orphans`` they are passed over.
    """
    if fail_on_orphans:
        events = required(events, [id_col], what)
    units = units.withColumn("_known", F.lit(True))
    made = [c.alias(n) for n, c in aggregates.items()] + [F.count_if(F.col("_known").isNull()).alias("_lost")]

    def met(e: DataFrame, u: DataFrame) -> DataFrame:
        return e.join(u, id_col, "left" if fail_on_orphans else "inner").groupBy(id_col).agg(*made)

    (some, many), (of_some, of_many) = apart(events, id_col, hot), apart(units, id_col, hot)
    out = met(some, of_some)
    if many is not None:
        out = out.unionByName(met(many, F.broadcast(of_many)))  # as many units as there are hot ids
    return insist(out, {"rows_of_unknown_participants": F.col("_lost")}, what).drop("_lost")
