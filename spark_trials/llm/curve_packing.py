"""Packing along a space-filling curve: documents that are alike lie side by side in full sequences.

A document is a hashed vector: its token ids fall in ``BUCKETS`` buckets, each weighing the root of its count. A fixed
random projection brings the vector, of length one, to ``DIMENSIONS`` coordinates, which all documents' means and deviations
bring to a common scale; a cell of the grid over them has a number on the Hilbert curve, whose neighbours are neighbours in
the grid. Documents are range-sorted by it and cut where a sequence is full, so only the very last tokens do not fill
one: they are cut into sequences of powers of two, which need no padding. A corpus leaves none at all.

Texts are tokenized once. Their ids are written down, compressed, beside eight numbers; the range-sort moves the numbers
alone. Running sums of tokens within a range and the sums of the ranges before, a number for each partition, place a
document, and its ids are then cut where they lie (``sent``: the table of places, narrow and of a checked size, goes to
all executors; beyond that many rows the ids are shuffled once, by row).

Documents of one cell, such as copies, are ordered by a hash of id and tokens and then by row, so any number of copies
parts evenly over the ranges.

Defined results: a null or empty text is its end alone. Documents of any length are cut where sequences end, and each id lies
in one piece. Rows that repeat are packed as documents of their own; ids are numbers or cast to them. Other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import SENT_ROWS, checkpoint, sent_if_small, ship
from spark_trials.llm.packing import coder

CAPACITY, END = 2048, 1
DIMENSIONS, BITS, BUCKETS, SEED = 4, 8, 1 << 16, 42
#: Coordinates are held as whole numbers of so small a unit, so that their sums do not depend on the order of rows.
UNIT = 1 << 20
COORDINATES = tuple(f"c{k}" for k in range(DIMENSIONS))


def directions(dimensions: int = DIMENSIONS, buckets: int = BUCKETS, seed: int = SEED) -> np.ndarray:
    """The projection: a row of normal numbers for each bucket."""
    return np.random.default_rng(seed).standard_normal((buckets, dimensions))


def coordinates(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where a document of these ids lies; without ids in the middle. A bucket is the upper 16 bits of a multiplied id."""
    if not len(ids):
        return np.zeros(table.shape[1])
    bucket = np.sort(((ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(16)).astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
    count = np.diff(first, append=len(bucket))
    return np.sqrt(count) @ table[bucket[first]] / np.sqrt(len(ids))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers on the Hilbert curve of grid cells (a row of ``bits``-bit numbers each)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, coarse ones first
        low = (1 << b) - 1
        for k in range(len(x)):
            flip = (x[k] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for k in range(len(x)):
            out = (out << 1) | (((x[k] ^ turn) >> b) & 1)
    return out


def cells(points: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The grid cells of points: a logistic curve spreads what is normal about evenly over a side."""
    z = (points - mean) / np.where(deviation > 0, deviation, 1.0)
    return np.minimum(np.floor((1 << bits) / (1.0 + np.exp(-1.702 * z))).astype(np.int64), (1 << bits) - 1)


def coded(docs: DataFrame, tokenizer: Callable[[], str] | str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, tie, c0 ..., ids): each document's tokens, its end included, with their number and coordinates."""
    ship(docs.sparkSession)
    made: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, squeeze = coder(tokenizer() if callable(tokenizer) else tokenizer), zstandard.ZstdCompressor(level=1)
        if not made:
            made.append(directions())
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                keys, texts = b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist()
                n, tie, at, packed = [], [], np.empty((len(keys), DIMENSIONS)), []
                for k, (key, text) in enumerate(zip(keys, texts, strict=True)):
                    ids = np.frombuffer(code.encode(text or ""), "<u4")
                    at[k] = coordinates(ids, made[0])
                    ids = np.append(ids, np.uint32(END))
                    narrow = ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids
                    raw = narrow.tobytes()
                    n.append(len(ids))
                    tie.append(np.int64(np.uint64(xxhash.xxh64_intdigest(raw, seed=0 if key is None else key & 0xFFFFFFFFFFFFFFFF))))
                    packed.append((b"2" if narrow is not ids else b"4") + squeeze.compress(raw))
                whole = np.rint(at * UNIT).astype(np.int64)
                columns = [np.arange(row, row + len(keys)), pa.array(keys, pa.int64()), np.array(n, np.int64), np.array(tie, np.int64), *whole.T, pa.array(packed, pa.binary())]
                row += len(keys)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=["row", "doc_id", "n", "tie", *COORDINATES, "ids"])

    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return at.mapInArrow(run, f"row long, doc_id long, n long, tie long, {', '.join(f'{c} long' for c in COORDINATES)}, ids binary")


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(ids)[1:]), f"<u{ids[:1].decode()}").astype("<u4")


def along_curve(documents: DataFrame) -> tuple[DataFrame, int]:
    """(row, at): the tokens before each document along the curve, and the number of all tokens."""
    spark = documents.sparkSession
    one = documents.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"), *[F.sum(c).alias(f"s{c}") for c in COORDINATES],
        *[F.sum(F.col(c).cast("decimal(20,0)") * F.col(c).cast("decimal(18,0)")).cast("double").alias(f"q{c}") for c in COORDINATES],
    ).first()
    rows = max(1, one["rows"])
    mean = np.array([(one[f"s{c}"] or 0) / rows for c in COORDINATES])
    deviation = np.sqrt(np.maximum(np.array([(one[f"q{c}"] or 0) / rows for c in COORDINATES]) - mean**2, 0.0))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.stack([b.column(3 + k).to_numpy() for k in range(DIMENSIONS)], axis=1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hilbert(cells(points, mean, deviation)))], names=["row", "n", "tie", "curve"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = before + np.cumsum(n)
            if len(n):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))], names=["row", "n", "within", "part"])

    numbered = documents.select("row", "n", "tie", *COORDINATES).mapInArrow(number, "row long, n long, tie long, curve long")
    ordered = numbered.repartitionByRange("curve", "tie", "row").sortWithinPartitions("curve", "tie", "row")
    placed = checkpoint(ordered.mapInArrow(running, "row long, n long, within long, part int"))
    sums = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each partition of the sort
    starts, at = [], 0
    for r in sums:
        starts.append((r["part"], at))
        at += r["n"]
    base = spark.createDataFrame(starts, "p int, base long")
    return placed.join(F.broadcast(base), F.col("part") == F.col("p")).select("row", (F.col("base") + F.col("within")).alias("at")), at


def last_cuts(total: int, capacity: int) -> list[int]:
    """Where the sequences start that the tokens beyond the full ones fill, largest power of two first; then the end."""
    at = total - total % capacity
    cuts = [at]
    for bit in range((total - at).bit_length() - 1, -1, -1):
        if (total - cuts[0]) >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return cuts


def pack_along_curve(
    docs: DataFrame, tokenizer: Callable[[], str] | str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, sent: int = SENT_ROWS,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    Sequences are numbered along the curve. ``tokenizer``: a tokenizer file, or what gives its path on an executor.
    """
    documents = checkpoint(coded(docs, tokenizer, id_col=id_col, text_col=text_col))
    places, total = along_curve(documents)
    cuts = last_cuts(total, capacity)
    full = cuts[0] // capacity

    def pieces(start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document's pieces."""
        at, end, k = start, start + n, 0
        while at < end:
            if at < cuts[0]:
                number, low, high = at // capacity, at // capacity * capacity, (at // capacity + 1) * capacity
            else:
                while cuts[k + 1] <= at:
                    k += 1
                number, low, high = full + k, cuts[k], cuts[k + 1]
            stop = min(end, high)
            yield at - start, stop - at, number, at - low
            at = stop

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in kinds]
                for key, n, packed, start in zip(*[b.column(k).slice(lo, 256).to_pylist() for k in range(4)], strict=True):
                    ids = unpacked(packed)
                    for first, length, number, offset in pieces(start, n):
                        own = ids[first : first + length]
                        for column, x in zip(out, (key, first, length, zlib.crc32(own.tobytes()), n, number, offset, own), strict=False):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[str(k) for k in range(len(kinds))])

    met = documents.select("row", "doc_id", "n", "ids").join(sent_if_small(checkpoint(places), sent), "row").select("doc_id", "n", "ids", "at")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return met.mapInArrow(cut, schema)
