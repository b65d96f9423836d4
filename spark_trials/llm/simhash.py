"""SimHash near-duplicates, joined through a segment-popcount embedding.

A document's fingerprint has bit b set if over half of its shingle hashes have it. Two fingerprints are linked if at most
``distance`` bits differ; classes are what links reach.

Candidates. Cut the 64 bits into 32 segments of 2 bits and count the bits set in each: a point of a 32-dimensional grid.
A changed bit changes one count by at most one, so the Manhattan distance of two points is at most the number of
differing bits: a lower bound, and points further apart than ``distance`` need no look. Points within it agree entirely
on at least ``blocks - distance`` of ``blocks`` blocks of the coordinates, so every linked pair meets in the grid cell of
some choice of that many blocks. Counts are kept in unary (00, 10, 11), so a cell is a mask of the word, and the
Manhattan distance is the bit count of an exclusive or. What is within it is then compared exactly.

Scale. Equal fingerprints are one row from the start, whatever the number of copies. Cells of one row go before anything
is compared. Inside a cell no pairs are made: a search from fingerprint to fingerprint gives a spanning forest of the
links there, fewer edges than members and the same classes. A cell of over ``cell_rows`` members is dealt to blocks that
meet pairwise in tasks of their own, so none grows with the cell.

Defined results: a null text or one of blanks has no words and fingerprint zero, linked like any other; under ``width``
words the whole sequence is the one shingle. Repeated rows share their fingerprint and class. A class is named by its
least doc_id; null ids are passed over unless a class has no other. ``one_of_each`` goes by classes and not by their names,
so classes without ids, or with an id in common, keep a row each. An empty table gives an empty result. Texts of any length
are read whole; ids are whole numbers or cast to them, and a string that is none fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import checkpoint, fresh, sent_if_small, ship
from spark_trials.llm.components import components

WIDTH, SEED, DISTANCE, BLOCKS, CELL_ROWS = 4, 42, 4, 8, 4096
EVEN = 0x5555555555555555


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) < width:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    hash_ = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):  # a long text is counted piece by piece
        part = [hash_(joined[a:b], SEED) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hashes: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; with ``hashes`` also h1 and h2, 128 bits that tell texts apart."""
    ship(docs.sparkSession)
    more = ["h1", "h2"] if hashes else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more])

    text = F.col(text_col).cast("string")
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[h.alias(n) for h, n in zip(_text_hashes(text), more, strict=False)])
    return at.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def _text_hashes(text) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``, as pairs of places."""
    grid = unary(fps)
    open_, edges = np.arange(len(fps)), []
    stack: list[int] = []
    while len(open_):
        if not stack:
            stack, open_ = [int(open_[0])], open_[1:]
            continue
        at = stack.pop()
        near = np.bitwise_count(grid[open_] ^ grid[at]) <= distance  # Manhattan distance of the counts
        near[near] = np.bitwise_count(fps[open_[near]] ^ fps[at]) <= distance
        found = open_[near].tolist()
        edges += [(at, k) for k in found]
        stack += found
        open_ = open_[~near]
    return edges


def unary(fps: np.ndarray) -> np.ndarray:
    """Counts of the 2-bit segments in unary."""
    one, even = np.uint64(1), np.uint64(EVEN)
    return ((fps | (fps >> one)) & even) | ((fps & (fps >> one) & even) << one)


def _unary(fp):
    signed = F.lit(EVEN)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(signed).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(signed), 1))


def links(fps: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``fps`` (fp) into the classes of all links."""
    wide = 64 // blocks
    ones = (1 << wide) - 1
    masks = [sum(ones << (wide * k) for k in some) for some in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    cells = fps.select("fp", _unary(F.col("fp")).alias("grid")).select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("grid").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])).alias("cell")
    )
    # Written down, the counted side has an exchange of its own, without which a join's hot cell cannot be split.
    shared = checkpoint(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = cells.join(shared, "cell")
    parts = F.ceil(F.col("n") / float(cell_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    met = met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in _with_end(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                kept.append(np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]))
            if not kept:
                continue
            all_ = np.concatenate(kept, axis=1)
            change = np.flatnonzero((all_[:3, 1:] != all_[:3, :-1]).any(axis=0)) + 1
            if b is not None:
                if not len(change):
                    kept = [all_]
                    continue
                kept, all_ = [all_[:, change[-1] :].copy()], all_[:, : change[-1]]
                change = change[:-1]
            else:
                kept = []
            yield _edges(all_[3], np.concatenate([[0], change, [all_.shape[1]]]).astype(np.int64), distance)

    return met.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _edges(signed: np.ndarray, bounds: np.ndarray, distance: int) -> pa.RecordBatch:
    fps = signed.view(np.uint64)
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    grid = unary(fps)
    near = np.bitwise_count(grid[two] ^ grid[two + 1]) <= distance
    near &= np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
    a, b = [signed[two[near]]], [signed[two[near] + 1]]
    for lo, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        if found := forest(fps[lo : lo + n], distance):
            pairs = np.array(found, np.int64) + lo
            a.append(signed[pairs[:, 0]])
            b.append(signed[pairs[:, 1]])
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _roots(fps: DataFrame, distance: int, blocks: int, cell_rows: int) -> DataFrame:
    """``fps`` (fp, least) with the root of each fingerprint's class."""
    roots = components(links(fps.select("fp"), distance=distance, blocks=blocks, cell_rows=cell_rows))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, *, distance: int = DISTANCE, width: int = WIDTH, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component_id."""
    marked = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    fps = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _roots(fps, distance, blocks, cell_rows)
    # Both written down, so that a class of very many fingerprints, and a fingerprint of very many copies, can be split.
    names = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = checkpoint(named.join(sent_if_small(names), "root").select(F.col("fp").alias("of"), "component_id"))
    return marked.join(of, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, *, distance: int = DISTANCE, width: int = WIDTH, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class: the one with the least id (null ids last), of several texts under
    that id the one with the least hash, of rows that repeat both the one with the least hash of all columns."""
    columns = docs.columns
    *keys, row = fresh(columns, "null", "known", "h1", "h2", "row")

    def key(id_, hashes):
        return [c.alias(n) for c, n in zip((id_.isNull(), F.coalesce(id_, F.lit(0)), *hashes), keys, strict=True)]

    marked = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, hashes=True))
    marked = marked.select(*key(F.col("doc_id"), (F.col("h1"), F.col("h2"))), "fp")
    counted = checkpoint(marked.groupBy("fp", *keys).agg(F.count(F.lit(1)).alias("times")))
    fps = checkpoint(counted.groupBy("fp").agg(F.min(F.struct(*keys)).alias("least")))
    stay = _roots(fps, distance, blocks, cell_rows).groupBy("root").agg(F.min("least").alias("least")).select("least.*", F.lit(True).alias("stays"))
    told = checkpoint(counted.join(stay, keys, "left").where("stays is null or times > 1").select(*keys, "stays"))
    gone, twice = told.where("stays is null").drop("stays"), told.where("stays").drop("stays")
    own = key(F.col(f"`{id_col}`").cast("long"), _text_hashes(F.col(f"`{text_col}`").cast("string")))
    plain = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(*plain, *own)
    left = rows.join(sent_if_small(gone), keys, "left_anti")
    if twice.isEmpty():
        return left.select(*plain)
    # Repeats of a row meet before the exchange, so that no task gets them all.
    told = [c for c, (_, kind) in zip(plain, docs.dtypes, strict=True) if "map<" not in kind]
    again = left.join(sent_if_small(twice), keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*plain), F.xxhash64(*told)).alias(row))
    return left.join(sent_if_small(twice), keys, "left_anti").select(*plain).unionByName(again.select(*[F.col(row).getField(c).alias(c) for c in columns]))
