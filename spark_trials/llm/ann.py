"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: rotations are learned on a bounded sample (``sample``, drawn by a hash) so that the signs of the rotated vectors
lose as little as they can (iterative quantization); ``rotations`` of them are joined, so codes may be longer than vectors.

Index: a code is cut into 16-bit substrings and every substring has its own table from value to rows. A code within Hamming
distance r of a query's lies within t_j of it in some substring j whenever the sum of (t_j + 1) is r + 1, so probing all
values within t_j finds every code within r. Those are kept by their full Hamming distance and ranked by the exact
Euclidean distance of the original vectors. The radius is the one that holds ``aim`` of the true neighbours in the sample,
whose neighbours are further away than those in the whole table. A query that finds under ``k`` rows doubles its radius.

Scale: rows are dealt by a hash to shards of about ``shard_rows``. A task gets the rows of a shard first, indexes them once,
and then answers the queries, which follow in the order of the sort, batch by batch: it holds a shard and a batch, however
many queries there are. Each returns k rows of each shard. Queries, one row in ``every``, are copied once for each shard.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a number that is not finite
take no part. Rows that repeat an id and a vector count once; a query meets every row but its own, other vectors of the
same id included. Ties go to the smaller id. Fewer candidates than ``k`` are all returned; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.llm.common import ship

K, ROTATIONS, SAMPLE, AIM = 10, 2, 4096, 0.94
SHARD_ROWS, PART = 131_072, 16
#: All values of a substring by the number of their bits, and how many have at most 0, 1, ... bits.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), kind="stable")
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), minlength=PART + 1))


def learn(x: np.ndarray, rotations: int = ROTATIONS, rounds: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, columns): a code's bits are the signs of (vector - mean) @ columns; their number is a multiple of 16."""
    mean = x.mean(axis=0)
    centred = x - mean
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    bits = -(-d // PART) * PART
    made = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(centred.T @ np.where(centred @ r >= 0, 1.0, -1.0))
            r = u @ v
        extra = rng.standard_normal((d, bits - d))
        made.append(np.concatenate([r, extra], axis=1))
    return mean, np.concatenate(made, axis=1)


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, columns = model
    return np.packbits((x - mean) @ columns >= 0, axis=1)


def radius_for(x: np.ndarray, codes: np.ndarray, k: int, aim: float) -> int:
    """The Hamming radius that holds ``aim`` of the true k nearest within the sample."""
    bits = codes.shape[1] * 8
    if len(x) < 2:
        return bits
    q = min(len(x), 512)
    gap = (x[:q] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[:q] @ x.T
    gap[np.arange(q), np.arange(q)] = np.inf
    near = np.argsort(gap, axis=1)[:, : min(k, len(x) - 1)]
    distance = np.bitwise_count(codes[:q, None, :] ^ codes[near]).sum(axis=2, dtype=np.int64)
    return int(np.quantile(distance, aim, method="higher"))


class MultiIndex:
    """A table from value to rows for every 16-bit substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(">u2").astype(np.int64)
        self.order = np.argsort(self.parts, axis=0, kind="stable").T.astype(np.int32)
        edges = np.arange((1 << PART) + 1)
        self.starts = [np.searchsorted(self.parts[o, j], edges) for j, o in enumerate(self.order)]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows that some substring's probes meet: every row within ``radius`` is one of them."""
        own = code.view(">u2").astype(np.int64)
        hit = np.zeros(len(self.codes), bool)
        for j, value in enumerate(own.tolist()):
            most = (radius + 1) // len(own) + (j < (radius + 1) % len(own)) - 1  # the sum of (most + 1) is radius + 1
            if most < 0:
                continue
            near = _MASKS[: _UP_TO[min(most, PART)]] ^ value
            first = self.starts[j][near]
            n = self.starts[j][near + 1] - first
            first, n = first[n > 0], n[n > 0]
            hit[self.order[j, np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in ``radius`` bits at most."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


class Shard:
    """The rows of a shard with their index, made once."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, model):
        self.ids, self.keys, self.x, self.model, self.index = ids, keys, x, model, MultiIndex(encode(x, model))
        self.bits = self.index.codes.shape[1] * 8

    def search(self, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, id, score) of the k nearest found of every query."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, code in enumerate(encode(q, self.model)):
            r = min(radius, self.bits)
            while True:
                rows = self.index.within(code, r) if r < self.bits else np.arange(len(self.x))
                rows = rows[(self.ids[rows] != ids[i]) | (self.keys[rows] != keys[i])]
                if len(rows) >= k or r >= self.bits:
                    break
                r = min(self.bits, max(1, 2 * r))
            score = np.sqrt(((self.x[rows] - q[i]) ** 2).sum(axis=1))
            if len(rows) > 4 * k:
                close = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                rows, score = rows[close], score[close]
            best = np.lexsort((self.ids[rows], score))[:k]
            out.append((np.full(len(best), i), self.ids[rows[best]], score[best]))
        return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def _matrix(values: pa.Array) -> np.ndarray:
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, whether queries, ids, keys, vectors) of neighbouring rows alike in the first two."""
    for b in batches:
        if not b.num_rows:
            continue
        shard, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        ids, keys, x = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4))
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(shard[lo]), bool(asks[lo]), ids[lo:hi], keys[lo:hi], x[lo:hi]


def nearest(
    vectors: DataFrame, *, every: int = 100, k: int = K, rotations: int = ROTATIONS, sample: int = SAMPLE, aim: float = AIM,
    shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(vector_col)
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & value.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(value).alias("key"), value.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None or not top["q"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == top["d"])
    drawn = rows.orderBy(F.xxhash64("id", "key"), "id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in drawn], np.float64)
    model = learn(x, rotations)
    radius = radius_for(x, encode(x, model), k, aim)
    shards = max(1, math.ceil(top["n"] / shard_rows))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id", "key", F.lit("shard")), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "key"])
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    both = placed.unionByName(asked).select("shard", "asks", "id", "key", "v").repartition("shard").sortWithinPartitions("shard", "asks", "id", "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, kept = None, None, []
        for shard, asks, ids, keys, x in _runs(batches):
            if shard != at:
                own, at, kept = None, shard, []
            if not asks:
                fresh = np.ones(len(ids), bool)  # rows that repeat are neighbours
                fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
                if kept:
                    fresh[0] = (ids[0], keys[0]) != (kept[-1][0][-1], kept[-1][1][-1])
                if fresh.any():
                    kept.append((ids[fresh], keys[fresh], x[fresh]))
                continue
            if own is None and kept:
                own, kept = Shard(*[np.concatenate([part[c] for part in kept]) for c in range(3)], model), []
            if own is not None:
                place, found, score = own.search(ids, keys, x, radius, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(keys[place]), pa.array(found), pa.array(score)], names=["query_id", "key", "vec_id", "score"])

    met = both.mapInArrow(meet, "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
