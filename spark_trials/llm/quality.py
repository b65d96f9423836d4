"""Quality by perplexity: an interpolated modified Kneser-Ney model of word pairs, trained on trusted text.

    P(w | v) = max(c(v w) - D(c(v w)), 0) / c(v)  +  g(v) P(w)
    P(w)     = max(n(w) - d(n(w)), 0) / N         +  h / V

c counts pairs in trusted text, n(w) the different words before w, N all different pairs; D and d are three discounts each,
from the counts of counts; g(v) and h give what they took back. Words are hashed to V = 2^26 numbers whatever the size of the
corpus, so P(w) is a table of 64 MB at most (one byte for n(w), larger ones beside it) that goes to every task; words that
share a number count as one, a share of about (different trusted words) / V.

Pairs are counted in groups by the sum of both words' upper bits, so a word that begins or ends a third of all pairs is no single
group. For scoring, pairs are dealt to shards by their first word, where the shard's counts meet them: P(w | v) needs c(v)
and g(v) of v. The counts of a shard are read first and its documents stream past them, so memory is bounded by the counts; a
shard with more pairs than ``SHARD_WORDS`` is dealt to several tasks (salts), each with its counts. ``shards`` and salts
decide where a pair is looked up and never what it scores, to the last bit. Pairs that begin with a word unknown to trusted
text need no counts and are scored where they are. The others travel sorted, as differences, by planes of bytes.

Trusted rows are those with label 1; one in five of them, by a hash of the id, is held out of the counts. In each language
a document is kept if its perplexity is at most the ``KEEP`` quantile of the held-out trusted ones, which the model has not
seen either; a language without any takes that of all languages.

Defined results: a null text is an empty one, of which the model sees the end alone. Repeated rows are scored one by one.
Labels that conflict for an id count as the larger. Without trusted rows P is uniform and all documents are kept. An empty
table gives an empty result; other columns are not read. Texts of any length are read whole; ids are whole numbers or cast to
them, and a string that is none fails.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import checkpoint, ship

SHARDS, MOST_SHARDS, SHARD_WORDS, KEEP, HELD = 8, 1 << 16, 8_000_000, 0.995, 5
BATCH_ROWS, BATCH_WORDS, GATHERED_BYTES, COUNTED_WORDS, CACHED_WORDS, CACHED_LETTERS = 1024, 1_000_000, 15_000_000, 2_000_000, 300_000, 64
#: Logarithms are summed as whole numbers of this part of one, so sums are the same in any order and for any dealing.
UNIT = 1 << 18
BITS = 26
WORDS = 1 << BITS
BEGIN, END = 0, 1
BROADCAST_LABELS = 2_000_000
CHUNKS = 64
OFTEN, SIZES = -1, -2
_ids: dict[str, int] = {}


def word_ids(text: str) -> list[int]:
    """Numbers of a text's words between BEGIN and END. Short words are kept with their numbers, up to a bound of tens of MB."""
    if len(_ids) > CACHED_WORDS:
        _ids.clear()
    out = [BEGIN]
    for w in text.split():
        k = _ids.get(w)
        if k is None:
            k = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % (WORDS - 2) + 2
            if len(w) <= CACHED_LETTERS:
                _ids[w] = k
        out.append(k)
    out.append(END)
    return out


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, all their first bytes first, each plane of bytes compressed by itself: small ones then take little."""
    at = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [k for k in range(8) if at[k].any()]
    parts = [zstandard.ZstdCompressor(level=1).compress(at[k].tobytes()) for k in used]
    sizes = np.zeros(9, "<u4")
    sizes[0], sizes[[k + 1 for k in used]] = len(x), [len(p) for p in parts]
    return sizes.tobytes() + b"".join(parts)


def unplanes(raw: bytes) -> np.ndarray:
    sizes, lo = np.frombuffer(raw, "<u4", 9).tolist(), 36
    at = np.zeros((8, sizes[0]), np.uint8)
    for k, size in enumerate(sizes[1:]):
        if size:
            at[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[lo : lo + size]), np.uint8)
            lo += size
    return np.ascontiguousarray(at.T).view("<u8").ravel()


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unrising(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=np.uint64)


class Pairs:
    """The word pairs of a few documents, sorted: their keys, first word before second, and their documents.

    With a model of words, pairs whose score needs no pair counts are scored here, ``lost`` by document: a first word that
    trusted text lacks leaves P(w) alone. Second words that it lacks are all alike and become one number.
    """

    def __init__(self, texts: pa.Array, p_word: WordModel | None = None):
        ids = [np.array(word_ids(t.as_py() or ""), np.uint32) for t in texts]
        self.lengths = np.fromiter((len(i) - 1 for i in ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        del ids
        first = np.ones(len(flat), bool)
        first[np.cumsum(self.lengths + 1) - 1] = False  # the last word begins no pair
        at = np.flatnonzero(first)
        v, w, doc = flat[at], flat[at + 1], np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        del flat, first, at
        self.lost = np.zeros(len(self.lengths), np.int64)
        if p_word is not None:
            alone = (p_word.small[v] == 0) & (v != BEGIN)
            self.lost += np.bincount(doc[alone], weights=units(p_word(w[alone].astype(np.int64))), minlength=len(self.lengths)).astype(np.int64)
            v, w, doc = v[~alone], w[~alone], doc[~alone]
            w = np.where(p_word.small[w] == 0, np.uint32(BEGIN), w)  # never a second word, so as rare as any other that is not there
        keys = (v.astype(np.uint64) << np.uint64(BITS)) | w
        order = np.argsort(keys, kind="stable")
        self.keys, self.doc = keys[order], doc[order]


def units(p: np.ndarray) -> np.ndarray:
    """-log p in whole numbers of a ``UNIT``, as doubles that add exactly."""
    return np.rint(-UNIT * np.log(p))


def shard_cuts(keys: np.ndarray, shards: int, bits: int = 2 * BITS) -> np.ndarray:
    """Where each shard begins in sorted keys of so many bits, and the end; ``shards`` is a power of 2."""
    return np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(bits - (shards.bit_length() - 1)))


def short_bits(shards: int) -> int:
    """Bits of a key in its part: the upper bits of the second word follow from the part and the first word."""
    return 2 * BITS - (shards.bit_length() - 1)


def parted(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, key in it): the part is the sum of both words' upper bits, so neither word alone decides it."""
    low = np.uint64(short_bits(shards) - BITS)
    v, w = keys >> np.uint64(BITS), keys & np.uint64(WORDS - 1)
    return ((v >> low) + (w >> low)) & np.uint64(shards - 1), (v << low) | (w & ((np.uint64(1) << low) - np.uint64(1)))


def whole(short: np.ndarray, part: int, shards: int) -> np.ndarray:
    """The keys that ``parted`` took apart."""
    low = np.uint64(short_bits(shards) - BITS)
    v = short >> low
    upper = (np.uint64(part + shards) - (v >> low)) & np.uint64(shards - 1)
    return (v << np.uint64(BITS)) | (upper << low) | (short & ((np.uint64(1) << low) - np.uint64(1)))


def batches_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, beyond one text, about BATCH_WORDS words."""
    sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + BATCH_ROWS, batch.num_rows)
        total = np.cumsum(sizes[lo:hi])
        hi = lo + max(1, int(np.searchsorted(total, 6 * BATCH_WORDS, side="right")))
        hi = min(hi, lo + BATCH_ROWS, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about GATHERED_BYTES of text: the more pairs are sorted together, the less each takes."""
    held, size = [], 0
    for whole in batches:
        for b in batches_of(whole, text):
            held.append(b)
            size += pa.compute.sum(pa.compute.binary_length(b.column(text))).as_py() or 0
            if size >= GATHERED_BYTES or len(held) >= 256:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def mixed(number: int) -> int:
    """A hash of a batch's number (partition and place in it), by which batches are dealt."""
    return xxhash.xxh64_intdigest(number.to_bytes(8, "little"))


def discounts(n: np.ndarray) -> np.ndarray:
    """(0, D1, D2, D3+) from the numbers of things counted once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not n1:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return np.array([0.0, min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of the counts of each."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


class WordModel:
    """P(w). ``small`` holds n(w) up to 254; words with 255 stand in ``big`` with their n(w)."""

    def __init__(self, small: np.ndarray, big: np.ndarray, big_n: np.ndarray):
        self.small, self.big, self.big_n = small, big, big_n
        often = sum(np.bincount(x, minlength=256) for x in np.array_split(small, CHUNKS))  # bincount makes eight bytes of each
        self.total = float((often[:255] * np.arange(255)).sum() + big_n.sum())
        self.d = discounts(often[1:5])
        taken = (self.d[np.minimum(np.arange(256), 3)] * often).sum()
        self.floor = taken / self.total / len(small) if self.total else 1.0 / len(small)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        n = self.small[w].astype(np.int64)
        high = np.flatnonzero(n == 255)
        if len(high):
            n[high] = self.big_n[np.searchsorted(self.big, w[high])]
        return (n - self.d[np.minimum(n, 3)]) / max(self.total, 1.0) + self.floor


class Shard:
    """P(w | v) from sorted keys, their counts and P(w)."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, d: np.ndarray, p_word: Callable[[np.ndarray], np.ndarray]):
        self.keys, self.p_word = keys, p_word
        self.v, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        total, taken = np.bincount(at, weights=count), d[np.minimum(count, 3)]
        self.share = (count - taken) / total[at] if len(keys) else np.zeros(0)
        self.rest = np.bincount(at, weights=taken) / total if len(keys) else np.zeros(0)

    def p(self, keys: np.ndarray) -> np.ndarray:
        p = self.p_word((keys & np.uint64(WORDS - 1)).astype(np.int64))
        if len(self.keys):
            v = keys >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(self.v, v), len(self.v) - 1)
            p *= np.where(self.v[at] == v, self.rest[at], 1.0)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            seen = self.keys[at] == keys
            p[seen] += self.share[at[seen]]
        return p


def _counted(trusted: DataFrame, shards: int) -> DataFrame:
    """(part, shard, keys, n): the different pairs of the trusted texts with their counts, by part and shard."""

    def emitted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        part, short = parted(keys, shards)
        there = np.unique(part).tolist()
        rows = [(rising(short[part == k]), planes(n[part == k])) for k in there]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "keys", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in batches_of(batch, 0):
                held.append(Pairs(b.column(0)).keys)
                size += len(held[-1])
                if size >= COUNTED_WORDS:
                    yield emitted(held)
                    held, size = [], 0
        if held:
            yield emitted(held)

    def counted(rows: pa.Table) -> pa.Table:
        keys, n = summed([unrising(x.as_py()) for x in rows.column("keys")], [unplanes(x.as_py()) for x in rows.column("n")])
        cuts = shard_cuts(keys, shards, short_bits(shards))
        there = [k for k in range(shards) if cuts[k + 1] > cuts[k]]
        return pa.table(
            {
                "part": pa.array([rows.column("part")[0].as_py()] * len(there), pa.int32()),
                "shard": pa.array(there, pa.int32()),
                "keys": pa.array([rising(keys[cuts[k] : cuts[k + 1]]) for k in there], pa.binary()),
                "n": pa.array([planes(n[cuts[k] : cuts[k + 1]]) for k in there], pa.binary()),
            }
        )

    made = trusted.select("text").mapInArrow(pairs, "part int, keys binary, n binary")
    return made.groupBy("part").applyInArrow(counted, "part int, shard int, keys binary, n binary")


def _totals(counts: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[bytes, bytes, bytes]]]:
    """(counts of counts of pairs, pairs of each shard, n(w) by chunks of the words)."""
    chunk = BITS - (CHUNKS.bit_length() - 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sizes = np.zeros(4, np.int64), np.zeros(shards, np.int64)
        for b in batches:
            seen = []
            for part, s, keys, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                n = unplanes(n.as_py())
                often += np.array([(n == k).sum() for k in (1, 2, 3, 4)])
                sizes[s] += int(n.sum())
                seen.append(whole(unrising(keys.as_py()), part, shards) & np.uint64(WORDS - 1))
            w, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
            cuts = np.searchsorted(w, np.arange(CHUNKS + 1, dtype=np.uint64) << np.uint64(chunk))
            there = [k for k in range(CHUNKS) if cuts[k + 1] > cuts[k]]
            rows = [(rising(w[cuts[k] : cuts[k + 1]]), planes(n[cuts[k] : cuts[k + 1]])) for k in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "w", "n"])
        ends = [(OFTEN, often), (SIZES, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ends], pa.int32()), pa.array([rising(np.arange(len(x), dtype=np.uint64)) for _, x in ends], pa.binary()), pa.array([planes(x) for _, x in ends], pa.binary())], names=["chunk", "w", "n"])

    def met(rows: pa.Table) -> pa.Table:
        k = rows.column("chunk")[0].as_py()
        w, n = summed([unrising(x.as_py()) for x in rows.column("w")], [unplanes(x.as_py()) for x in rows.column("n")])
        if k < 0:
            small, big = b"", np.ones(len(n), bool)
        else:
            table, big = np.zeros(1 << chunk, np.uint8), n >= 255
            table[(w - np.uint64(k << chunk)).astype(np.int64)] = np.minimum(n, 255)
            small = zstandard.ZstdCompressor(level=1).compress(table.tobytes())
        return pa.table({"chunk": pa.array([k], pa.int32()), "small": pa.array([small], pa.binary()), "big": pa.array([rising(w[big])], pa.binary()), "n": pa.array([planes(n[big])], pa.binary())})

    made = counts.mapInArrow(words, "chunk int, w binary, n binary").groupBy("chunk").applyInArrow(met, "chunk int, small binary, big binary, n binary")
    rows = {r["chunk"]: (bytes(r["small"]), bytes(r["big"]), bytes(r["n"])) for r in made.collect()}
    often, sizes = (unplanes(rows.pop(k)[2]).astype(np.int64) if k in rows else np.zeros(size, np.int64) for k, size in ((OFTEN, 4), (SIZES, shards)))
    return often, sizes, rows


def word_model(chunks: dict[int, tuple[bytes, bytes, bytes]]) -> WordModel:
    small, big, big_n = np.zeros(WORDS, np.uint8), [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    size = WORDS // CHUNKS
    for k in sorted(chunks):
        raw, w, n = chunks[k]
        small[k * size : (k + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        big.append(unrising(w))
        big_n.append(unplanes(n))
    return WordModel(small, np.concatenate(big).astype(np.int64), np.concatenate(big_n).astype(np.int64))


_models: dict[str, WordModel] = {}


def model_of(sent) -> WordModel:
    """The model of words that was sent, made once in a worker."""
    if sent.value[2] not in _models:
        _models.clear()
        _models[sent.value[2]] = word_model(sent.value[1])
    return _models[sent.value[2]]


def perplexities(
    docs: DataFrame, labels: DataFrame, *, shards: int | None = None, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality"
) -> DataFrame:
    """One row for each row of ``docs``, written down: doc_id, lang, trusted, held_out, n_words, log_perplexity (natural, for
    a word).

    ``shards`` (a power of 2) and ``shard_words`` deal the work; scores do not depend on them."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(label_col).alias("q")).where("q = 1 and i is not null")
    marks = checkpoint(marks.select("i", (F.pmod(F.xxhash64("i", F.lit("held")), F.lit(HELD)) == 0).alias("held")))
    if marks.count() <= BROADCAST_LABELS:  # 2 million rows of two numbers, tens of MB; more are joined by a shuffle
        marks = F.broadcast(marks)
    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = at.join(marks, F.col("doc_id") == F.col("i"), "left").select("doc_id", "lang", F.col("held").isNotNull().alias("trusted"), F.coalesce("held", F.lit(False)).alias("held_out"), "text")
    total = (at.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5  # words, about; they deal the work only
    if shards is None:
        shards = SHARDS
        while shards < MOST_SHARDS and total / shards > shard_words:
            shards *= 2
    counts = _counted(rows.where("trusted and not held_out"), shards).persist()  # used twice, and released below
    often, sizes, chunks = _totals(counts, shards)
    # A shard's part of all pairs is about its part of the trusted ones.
    salts = np.maximum(1, np.ceil(total * sizes / max(int(sizes.sum()), 1) / shard_words)).astype(np.int64).tolist()
    model = spark.sparkContext.broadcast((discounts(often), chunks, uuid.uuid4().hex))
    meta = [("lost", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("trusted", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())), ("words", pa.list_(pa.int32()))]
    meta_schema = "lost array<long>, doc_ids array<long>, langs array<string>, trusted array<boolean>, held array<boolean>, words array<int>"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in gathered(batches, 4):
            number, k = (part << 32) | k, k + 1
            p = Pairs(b.column(4), model_of(model))
            cuts = shard_cuts(p.keys, shards)
            own, dealt_by = mixed(number) % shards, mixed(~number & 0xFFFFFFFFFFFFFFFF)
            there = [s for s in range(shards) if cuts[s + 1] > cuts[s] or s == own]
            keys = [rising(p.keys[cuts[s] : cuts[s + 1]]) for s in there]
            doc = [planes(p.doc[cuts[s] : cuts[s + 1]]) for s in there]
            about = [p.lost.tolist(), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), (p.lengths - 1).tolist()]
            columns = [pa.array(there, pa.int32()), pa.array([dealt_by % salts[s] for s in there], pa.int32()), pa.array([number] * len(there), pa.int64())]
            columns += [pa.array([b.num_rows] * len(there), pa.int32()), pa.array(keys, pa.binary()), pa.array(doc, pa.binary())]
            columns += [pa.array([x if s == own else None for s in there], t) for x, (_, t) in zip(about, meta, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "salt", "batch", "docs", "keys", "n", *[n for n, _ in meta]])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, shard = None, ([], []), None
        for b in batches:
            out = []
            for r in range(b.num_rows):
                s, salt, batch, docs_, keys, n = (b.column(c)[r].as_py() for c in range(6))
                if (s, salt) != key:
                    key, known, shard = (s, salt), ([], []), None
                if batch < 0:  # the shard's counts come before its documents
                    known[0].append(whole(unrising(keys), -1 - batch, shards))
                    known[1].append(unplanes(n))
                    continue
                if shard is None:
                    shard, known = Shard(*summed(*known), model.value[0], model_of(model)), ([], [])
                lost = np.bincount(unplanes(n).astype(np.int64), weights=units(shard.p(unrising(keys))), minlength=docs_)
                out.append((r, planes(lost.astype(np.int64))))
            rest = b.take(pa.array([r for r, _ in out], pa.int32()))
            yield pa.RecordBatch.from_arrays([rest.column(2), pa.array([x for _, x in out], pa.binary()), *[rest.column(6 + c) for c in range(len(meta))]], names=["batch", "sums", *[n for n, _ in meta]])

    def met(rows: pa.Table) -> pa.Table:
        total = sum(unplanes(x.as_py()).astype(np.int64) for x in rows.column("sums"))
        about = next({n: rows.column(n)[k].as_py() for n, _ in meta} for k in range(rows.num_rows) if rows.column("doc_ids")[k].is_valid)
        n, total = np.array(about["words"], np.int64), total + np.array(about["lost"], np.int64)
        return pa.table(
            {
                "doc_id": pa.array(about["doc_ids"], pa.int64()), "lang": pa.array(about["langs"], pa.string()), "trusted": pa.array(about["trusted"], pa.bool_()),
                "held_out": pa.array(about["held"], pa.bool_()), "n_words": pa.array(n), "log_perplexity": pa.array(total / UNIT / (n + 1)),
            }
        )

    dealt = rows.mapInArrow(pairs, f"shard int, salt int, batch long, docs int, keys binary, n binary, {meta_schema}")
    salt = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, salts)), F.col("shard") + 1).cast("int") - 1)).alias("salt")
    first = counts.select("shard", salt, (-1 - F.col("part").cast("long")).alias("batch"), F.lit(0).alias("docs"), "keys", "n")
    at_shard = dealt.unionByName(first, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "batch")
    sums = at_shard.mapInArrow(scored, f"batch long, sums binary, {meta_schema}")
    try:
        return checkpoint(sums.groupBy("batch").applyInArrow(met, "doc_id long, lang string, trusted boolean, held_out boolean, n_words long, log_perplexity double"))
    finally:
        counts.unpersist()


def judge(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP, **options) -> DataFrame:
    """``perplexities`` with the language's threshold and ``kept``."""
    scored = perplexities(docs, labels, **options)
    held = scored.where("held_out")
    at = F.percentile_approx("log_perplexity", F.lit(keep), F.lit(100_000))
    by = held.groupBy(F.col("lang").alias("l")).agg(at.alias("own"))
    all_ = held.agg(at.alias("any"))
    met = scored.join(by, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(all_), F.lit(True))
    limit = F.coalesce("own", "any", F.lit(math.inf))
    return met.select("doc_id", "lang", "trusted", "held_out", "n_words", "log_perplexity", limit.alias("threshold"), (F.col("log_perplexity") <= limit).alias("kept"))
