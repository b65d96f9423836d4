"""Vector code compression: product codes whose entries are found by Orchard's search.

Components become whole numbers, floor(256 x). Vectors are cut into ``PARTS`` equal parts, each position with a codebook of
its own. Codebooks start as the parts of the rows of smallest ids; a round assigns every part to its nearest entry and moves
each entry to the floor of its parts' mean. All of it is whole numbers, so any partitioning gives the same codes.

Orchard's search: every entry keeps the others sorted by their distance to it. A part starts at the entry nearest along one
component, walks that entry's list, skips what is marked, and jumps to the list of any entry that is nearer. It stops at
the first one further from the current entry than twice the current distance: no later one can be nearer. Marks are bits
of words; all parts of a batch walk at once, one step of numpy each, and drop out when they are done.

A round reads the table once and sends back one row of sums for each entry and partition, summed by Spark: what meets the
driver are the codebooks, whatever the corpus. Sums by label are aggregated before they move, and join the rows by label.

Defined results: vectors that are null or hold a null or a number that is not finite are dropped. The length is that of most
vectors left (of the longer, if tied). Vectors of another length, of one that is no multiple of ``PARTS``, or with a
component beyond ``LIMIT`` (whose squares would leave 64 bits) stay with a null code and error and move no entry. Null ids come
last, rows of one id by their vector. Fewer rows than entries make fewer entries; an empty table gives an empty result.
Repeated rows are coded one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import SENT_ROWS, checkpoint, sent_if_small, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 27


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(x, np.float64) * SCALE).astype(np.int64)


class Orchard:
    """A codebook (a row of whole numbers each) with every entry's list of the others, nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(self.gaps, axis=1, kind="stable")
        self.along = int(np.argmax(entries.max(axis=0) - entries.min(axis=0))) if entries.size else 0
        self.order = np.argsort(entries[:, self.along], kind="stable")
        self.side = entries[self.order, self.along]

    def start(self, x: np.ndarray) -> np.ndarray:
        """The entry nearest along the widest component."""
        right = np.searchsorted(self.side, x[:, self.along]).clip(1, max(1, len(self.side) - 1))
        right = np.minimum(right, len(self.side) - 1)
        left = np.maximum(right - 1, 0)
        nearer = np.abs(self.side[left] - x[:, self.along]) <= np.abs(self.side[right] - x[:, self.along])
        return self.order[np.where(nearer, left, right)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row, ties to the lower entry; and how many distances that took."""
        best = self.start(x)
        away = ((x - self.entries[best]) ** 2).sum(axis=1)
        seen = np.zeros((len(x), -(-len(self.entries) // 64)), np.uint64)
        live, place, took = np.arange(len(x)), np.zeros(len(x), np.int64), len(x)
        seen[live, best >> 6] |= np.uint64(1) << (best & 63).astype(np.uint64)
        while len(live):
            near = best[live]
            other = self.lists[near, place[live]]
            going = self.gaps[near, other] <= 4 * away[live]  # an entry at twice the distance can still tie
            live, near, other = live[going], near[going], other[going]
            bit = np.uint64(1) << (other & 63).astype(np.uint64)
            fresh = seen[live, other >> 6] & bit == 0
            rows, new = live[fresh], other[fresh]
            seen[rows, new >> 6] |= bit[fresh]
            gap = ((x[rows] - self.entries[new]) ** 2).sum(axis=1)
            took += len(rows)
            won = (gap < away[rows]) | ((gap == away[rows]) & (new < best[rows]))
            place[live] += 1
            jump = rows[won]
            best[jump], away[jump], place[jump] = new[won], gap[won], 0
            live = live[place[live] < len(self.entries)]
        return best, away, took


def _sound(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, whole(b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def codebooks(fit: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after the rounds, from rows (id, vector) that can be coded."""
    first = fit.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.ascontiguousarray(_cut(whole(np.array([r["vector"] for r in first])), parts).transpose(1, 0, 2))
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, x in _batches(batches, 0):
            for p, own in enumerate(search):
                part = np.ascontiguousarray(_cut(x, parts)[:, p])
                entry, _, _ = own.nearest(part)
                count[p] += np.bincount(entry, minlength=count.shape[1])
                np.add.at(total[p], entry, part)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *[pa.array(total[p, e, k]) for k in range(width)]], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    columns = [f"s{k}" for k in range(width)]
    for _ in range(rounds):
        made = fit.select("vector").mapInArrow(sums, f"part long, entry long, n long, {', '.join(f'{c} long' for c in columns)}")
        made = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns])
        moved = books.copy()
        for r in made.collect():  # parts x entries rows at most
            moved[r["part"], r["entry"]] = [int(r[c]) // r["n"] for c in columns]
        books = moved
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sent: int = SENT_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes are entries in hexadecimal, two digits for each part."""
    if not 0 < entries <= 256:
        raise ValueError("an entry has two hexadecimal digits: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("vector").isNotNull() & _sound(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if most is None:
        return spark.createDataFrame([], schema)
    fits = (F.size("vector") == most["d"]) & F.forall("vector", lambda v: F.abs(v.cast("double")) < LIMIT / SCALE) & F.lit(most["d"] > 0 and most["d"] % parts == 0)
    fit = rows.where(fits)
    empty = not fit.limit(1).count()
    books = np.zeros((0, 0, 0), np.int64) if empty else codebooks(fit.select("id", "vector"), parts=parts, entries=entries, rounds=rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        for b, x in _batches(batches, 2):
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, own in enumerate(search):
                codes[:, p], away, _ = own.nearest(np.ascontiguousarray(_cut(x, parts)[:, p]))
                error += away
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    odd = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    made = odd if empty else fit.select("id", "label", "vector").mapInArrow(code, f"id long, label {kind}, code string, error long").unionByName(odd)
    made = checkpoint(made)
    by = made.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    met = made.join(sent_if_small(checkpoint(by), sent), F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
