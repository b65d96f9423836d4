"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source gets the same expected number of copies, target / source size: a whole part that all get, and
a fraction that must be rounded to 0 or 1. Rounding each alone would miss the target by a random walk. Pivotal rounding
pairs two open documents and moves word mass between them, in a random direction, until one of the two is whole; the
odds make every document's expected copies right, and the moved mass keeps the source's words exactly as they were.

The pairs form a reduction tree. Documents of a source and size class (a power of two) are dealt by a hash to buckets of
at most ``fan_in`` on average, each bucket is folded by ``aggregate`` into decided documents and at most one open one, and
the open ones meet in the next level, until one is left in each class. These few are paired across classes in the same way,
and the last one alone is rounded by its fraction. No bucket grows with its source: a source with a third of all rows is
only more buckets.

Documents come in bands, long ones first (``BANDS``). What the last one of a band was rounded up or down is spread over all
shorter ones of the source, as far as their fractions stay within 0 and 1 whichever way it falls; that change has mean zero, so it
leaves every expectation right, and the words of a source end within a short document of the target where there are any.

All draws are hashes of the id, the text, the level and the seed, so reruns agree.

Defined results: a null text has size 0, and so has one of blanks; documents of size 0 are never taken. A null source is a
source, last in order. Repeated rows are documents of their own. Ids are whole numbers or null. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.llm.common import WORD, checkpoint, fresh

WEIGHTS = (5, 2, 1)
MOST = 3
FAN_IN = 128
#: A table of so many sources, under 1 MB, is sent to all executors.
BROADCAST_SOURCES = 10_000
#: Borders in words: longer documents are rounded first, and each band takes up what rounding the one before left over.
BANDS = (4096, 1024, 256, 64)
BLOCK = 1 << 16
_KEY = ("id", "hash", "row", "size")
_ITEM = "struct<id:bigint,hash:bigint,row:bigint,size:bigint,x:double,u:double>"
_DONE = "array<struct<id:bigint,hash:bigint,row:bigint,size:bigint,up:int>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size): shares by weight, none above ``most`` times its size.

    A source stops at ``most`` x its size once the level z, words for each unit of weight, passes most x size / weight.
    Sorted by that ratio, the sources that stop are a prefix, and z follows from running sums: what resharing the excess
    until none is above comes to, without a loop. The rows are one for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Numbering the sources orders one row for each of them: a window over the names, not over documents.
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = by.withColumn("n", F.row_number().over(named) - 1).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    all_ = Window.partitionBy(F.lit(0))
    upto = all_.orderBy(F.col("cap") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_).cast("double")
    before_cap = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    before_w = F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    left_w = F.sum("w").over(all_) - before_w
    # z if all before stop and this and later ones don't; it holds from the first source that z leaves under its cap.
    stepped = ranked.withColumn("z", (total - before_cap) / left_w).withColumn("stops", F.col("z") * F.col("w") > F.col("cap"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("n"), F.col("z")))).over(all_)
    return (
        stepped.withColumn("level", level["z"])
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")))
        .select("source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))
    )


def _draw(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _fold(items: Column) -> Column:
    """Fold open items into struct(open, decided): ``open`` is null or one item; decided ones are (row, x of 0 or 1)."""
    nothing, decided = F.lit(None).cast(_ITEM), F.array().cast(_DONE)

    def whole(item: Column, up: Column) -> Column:
        return F.struct(*[item[k].alias(k) for k in _KEY], up.cast("int").alias("up"))

    def moved(item: Column, x: Column) -> Column:
        return F.struct(*[item[k].alias(k) for k in _KEY], x.cast("double").alias("x"), item["u"].alias("u"))

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        to_a = F.least((1 - a["x"]) * a["size"], b["x"] * b["size"])  # words that can go from b to a
        to_b = F.least(a["x"] * a["size"], (1 - b["x"]) * b["size"])
        gives = b["u"] * (to_a + to_b) < to_b  # then b's mass goes to a
        a_full = (1 - a["x"]) * a["size"] <= b["x"] * b["size"]
        b_full = (1 - b["x"]) * b["size"] <= a["x"] * a["size"]
        # the one of the two that is whole now, how, and what is left of the other
        done = F.when(gives & a_full, whole(a, F.lit(1))).when(gives, whole(b, F.lit(0))).when(b_full, whole(b, F.lit(1))).otherwise(whole(a, F.lit(0)))
        rest = (
            F.when(gives & a_full, moved(b, b["x"] - (1 - a["x"]) * a["size"] / b["size"]))
            .when(gives, moved(a, a["x"] + b["x"] * b["size"] / a["size"]))
            .when(b_full, moved(a, a["x"] - (1 - b["x"]) * b["size"] / a["size"]))
            .otherwise(moved(b, b["x"] + a["x"] * a["size"] / b["size"]))
        )
        return F.when(a.isNull(), F.struct(b.alias("open"), state["decided"].alias("decided"))).otherwise(
            F.struct(rest.alias("open"), F.array_append(state["decided"], done).alias("decided"))
        )

    return F.aggregate(items, F.struct(nothing.alias("open"), decided.alias("decided")), step)


def _settle(items: Column) -> Column:
    """Pair the last open items of a source, then round the one that is left by its fraction: all of them decided."""
    folded = _fold(items)
    last = folded["open"]
    up = (_draw(*[last[k] for k in _KEY], F.lit("round")) < last["x"]).cast("int")
    return F.array_append(folded["decided"], F.struct(*[last[k].alias(k) for k in _KEY], up.alias("up")))


def _items(salt: Column, largest_first: bool = False) -> Column:
    """All rows of a bucket as an array, in an order that the ids alone fix."""
    order = -F.col("size").cast("double") if largest_first else _draw("id", "hash", "row", salt, F.lit("order"))
    item = F.struct(*[F.col(k).cast("long").alias(k) for k in _KEY], F.col("x").alias("x"), _draw("id", "hash", "row", salt, F.lit("move")).alias("u"))
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item")))), lambda i: i["item"])


def copies(rows: DataFrame, *, most_rows: int, fan_in: int = FAN_IN, seed: int | str = 42) -> DataFrame:
    """(id, hash, row, source, size, copies) of rows (id, hash, row, source, size, base, x, of_rows): ``base`` copies each, and
    one more for some.

    ``hash`` and ``row`` tell rows of an id apart, ``of_rows`` is the number of the source's rows here, ``most_rows`` the
    largest of these, which fixes the number of levels.
    """
    still, group = rows.where("x > 0").select(*_KEY, "source", "base", "x", "of_rows"), ["source", "base", "of_rows"]
    out = rows.where("not x > 0").select(*_KEY, "source", F.col("base").alias("copies"))

    def decided(df: DataFrame, items: Column | str) -> DataFrame:
        done = df.select("source", "base", F.explode(items).alias("d"))
        return done.select(*[f"d.{k}" for k in _KEY], "source", (F.col("base") + F.col("d.up")).cast("int").alias("copies"))

    levels = max(1, math.ceil(math.log(max(2, most_rows), fan_in)))
    for level in range(levels):
        salt = F.lit(f"{seed}/{level}")
        buckets = F.greatest(F.lit(1), F.ceil(F.col("of_rows") / float(fan_in) ** (level + 1))).cast("long")
        bucket = F.pmod(F.xxhash64("id", "hash", "row", salt, F.lit("deal")), buckets if level < levels - 1 else F.lit(1).cast("long"))
        dealt = still.withColumn("bucket", bucket).withColumn("class", F.floor(F.log2("size")).cast("int"))
        folded = dealt.groupBy(*group, "class", "bucket").agg(_items(salt).alias("items"))
        folded = checkpoint(folded.select(*group, _fold(F.col("items")).alias("f")))
        out = out.unionByName(decided(folded, "f.decided"))
        still = folded.where("f.open is not null").select(*[f"f.open.{k}" for k in _KEY], "source", "base", "f.open.x", "of_rows")
    last = still.groupBy(*group).agg(_items(F.lit(f"{seed}/last"), largest_first=True).alias("items"))
    return out.unionByName(decided(last, _settle(F.col("items"))))


def _times(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 1 in ``name``: in two steps, so that no array holds more than ``BLOCK`` numbers."""
    block = f"{name}_block"
    cut = df.withColumn(name, n.cast("long")).where(F.col(name) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(name) - 1) / BLOCK))))
    first, last = F.col(block) * BLOCK + 1, F.least(F.col(name), (F.col(block) + 1) * BLOCK)
    return cut.withColumn(name, F.explode(F.sequence(first, last))).drop(block)


def _keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What a row of the input is known by: id, source, size and the hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    return [F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"), words(text), F.xxhash64(text)]


def _band(size: Column) -> Column:
    """0 for the longest documents, then 1, 2, ..."""
    return sum(((size < b).cast("int") for b in BANDS), F.lit(0))


def _mixed(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, fan_in: int = FAN_IN, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, hash, source, size, copies), one for each row of ``docs``, and the goals of the sources."""
    keys = [c.alias(n) for c, n in zip(_keys(id_col, text_col, source_col), ("id", "source", "size", "hash"), strict=True)]
    # Rows alike in all four are interchangeable, so a number within them is enough to tell rows apart.
    same = docs.select(*keys).groupBy("id", "source", "size", "hash").agg(F.count(F.lit(1)).alias("n"))
    sized = checkpoint(_times(same, F.col("n"), "row").select(*_KEY, "source"))
    size, bands = F.col("size"), range(len(BANDS) + 1)
    here = [(_band(size) == b) & (size > 0) for b in bands]
    counts = [f(F.when(here[b], size)).alias(f"{n}{b}") for b in bands for n, f in (("n", F.count), ("w", F.sum), ("m", F.max))]
    by = sized.groupBy(F.col("source").alias("s")).agg(*counts).fillna(0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(sized, weights=weights, most=most).join(by, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = checkpoint(goals.withColumns({"base": F.floor(ratio).cast("int"), "x": ratio - F.floor(ratio)}))
    n_sources, *most_rows = goals.agg(F.count(F.lit(1)), *[F.coalesce(F.max(f"n{b}"), F.lit(0)) for b in bands]).first()

    def small(df: DataFrame) -> DataFrame:  # tables of more sources are joined by a shuffle
        return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df

    out = sized.where("size = 0").select("id", "hash", "source", "size", F.lit(0).alias("copies"))
    now = goals.withColumnRenamed("source", "of")
    for b in bands:
        own = small(now.select("of", "base", "x", F.col(f"n{b}").alias("of_rows")))
        rows = sized.where(here[b]).join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        made = copies(rows, most_rows=most_rows[b], fan_in=fan_in, seed=f"{seed}/{b}")
        if b < len(BANDS):
            made = checkpoint(made)
            taken = made.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("copies") * size).alias("taken"))
            rest, x = sum((F.col(f"w{c}") for c in bands[b + 2 :]), F.col(f"w{b + 1}")), F.col("x")
            over = F.coalesce("taken", F.lit(0)) - (F.col("base") + x) * F.col(f"w{b}")
            # Known before the draw: so much of it that the fractions of the rest stay within 0 and 1 whichever way it fell.
            share = F.least(F.lit(1.0), rest * F.least(x, 1 - x) / F.nullif(F.col(f"m{b}"), F.lit(0)))
            moved = F.coalesce(share * over / F.nullif(rest, F.lit(0)), F.lit(0.0))
            met = now.join(small(taken), F.col("of").eqNullSafe(F.col("s")), "left")
            now = checkpoint(met.withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - moved))).drop("s", "taken"))
        out = out.unionByName(made.select("id", "hash", "source", "size", "copies"))
    return out, small(goals)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Options: ``weights``, ``most`` (times its size that a source is taken at most), ``fan_in``, ``seed`` and the names of columns.
    """
    made, goals = _mixed(docs, **options)
    goals = goals.select(F.col("source").alias("of"), "source_size", "target")
    return made.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay as they are.

    A row finds its copies by id, source, size and the hash of its text. Of rows alike in these the mix's numbers are added
    up and divided among them, the first ones by a hash of all columns but maps get the odd ones. Rows that repeat in all of
    these columns are counted before they meet, so that no task gets them all.
    """
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    columns = docs.columns
    i, s, z, h, taken, n, k = fresh(columns, "i", "s", "z", "h", "copies", "n", "k")
    own = fresh([*columns, i, s, z, h, taken, n, k], "oi", "os", "oz", "oh")
    made = _mixed(docs, **options)[0].groupBy("id", "source", "size", "hash").agg(F.sum("copies").alias(taken), F.count(F.lit(1)).alias(n))
    made = checkpoint(made.where(F.col(taken) > 0).select(F.col("id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("hash").alias(h), taken, n))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(o) for c, o in zip(_keys(**names), own, strict=True)])
    hit = F.col(own[0]).eqNullSafe(F.col(i)) & F.col(own[1]).eqNullSafe(F.col(s)) & (F.col(own[2]) == F.col(z)) & (F.col(own[3]) == F.col(h))
    plain = [F.col(f"`{c}`") for c in columns]
    once = rows.join(made.where(F.col(n) == 1), hit).withColumn(k, F.explode(F.array_repeat(F.lit(1), F.col(taken).cast("int")))).select(*plain)
    again = rows.join(made.where(F.col(n) > 1), hit)
    key = [i, s, z, h, taken, n, k]
    told = [c for c, (_, kind) in zip(plain, docs.dtypes, strict=True) if "map<" not in kind]
    alike = again.withColumn(k, F.xxhash64(*told)).groupBy(*key).agg(F.first(F.struct(*plain)).alias(own[0]), F.count(F.lit(1)).alias(own[1]))
    before = F.sum(own[1]).over(Window.partitionBy(i, s, z, h).orderBy(k)) - F.col(own[1])
    odd = F.greatest(F.lit(0), F.least(F.col(own[1]), F.col(taken) % F.col(n) - before))
    many = _times(alike.withColumn(own[2], F.col(own[1]) * F.floor(F.col(taken) / F.col(n)) + odd), F.col(own[2]), own[3])
    return once.unionByName(many.select(*[F.col(own[0]).getField(c).alias(c) for c in columns]))
