"""Best-fit packing of documents in sequences of a fixed length.

Documents of equal length are interchangeable, so best-fit decreasing needs only how many pieces there are of each length:
at most ``capacity`` numbers, whatever the corpus. The plan keeps open bins by remaining capacity, as runs of bin numbers,
with a segment tree over the capacities whose leaves count open bins. For each length, longest first, the tree finds the
tightest open bin that fits in logarithmic time; all bins alike are filled at once, and where none fits new ones open.
That is best-fit decreasing over the whole corpus: no bin is closed early and no part of the corpus is packed alone.

The plan is a list of runs: pieces r to r+n of length l go to bins b onwards at an offset. It is small by proof: a length
splits at most one run and opens one, and a run of capacity c takes pieces of at most sqrt(2c) different lengths, so
there are under 3 x capacity x sqrt(2 x capacity) entries (400,000 for 2048, a few thousand in practice). It is sent to
all tasks, and pieces, numbered within their length by a distributed count, look up their place in it.

Defined results: a null or empty text is the one token that ends a document. Only documents longer than the capacity are
cut, into full pieces; the first one may be shorter. Repeated rows are packed as documents of their own. Other columns
are not read. An empty table gives an empty result. Ids are whole numbers or cast to them; a string that is none fails.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_trials.llm.common import checkpoint, ship

CAPACITY, END, SALT_ROWS = 2048, 0, 1 << 16
LONG_RUN = 100_000
#: Runs of what the pre-tokenizer's pattern takes as blanks.
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}+")
_coders: dict[str, TextCoder] = {}


#: The pre-tokenizer of byte-level BPE files that name none of their own.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_byte_bpe(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """A byte-level BPE file of the tokenizers library: its merges and its added tokens. Ids follow the order of the merges,
    so they are the ranks as well."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {t["content"]: int(t["id"]) for t in model.get("added_tokens", [])}
    if any(t.get(flag) for t in model.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks or whole words with them are not supported")
    signs = _byte_signs()
    ranks = {bytes(signs[c] for c in token): id_ for token, id_ in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), added


class TextCoder:
    """The ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    Texts are coded whole by tiktoken with the file's merges; nothing is kept between texts, so memory is a text and its ids.
    The strings of added tokens are their ids, as the tokenizers library has it, and part the text. A run of ``LONG_RUN``
    blanks is taken out before the pre-tokenizer's pattern, whose stack such runs would use up: all but its last blank are
    one piece, or all of it where the text ends.
    """

    def __init__(self, path: str):
        coding, added = read_byte_bpe(path)
        self.code, self.piece = coding.encode_ordinary, coding._encode_single_piece
        self.added = {token: array("I", [id_]).tobytes() for token, id_ in added.items()}
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(longest_first)})") if added else None

    def encode(self, text: str) -> bytes:
        if self.parts is None or not self.parts.search(text):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.parts.split(text) if part)

    def _plain(self, text: str) -> bytes:
        if len(text) < LONG_RUN:
            return self._ids(text)
        out, at = [], 0
        for run in BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += [self._ids(text[at : run.start()]), array("I", self.piece(text[run.start() : stop])).tobytes()]
            at = stop
        return b"".join([*out, self._ids(text[at:])])

    def _ids(self, text: str) -> bytes:
        return array("I", self.code(text)).tobytes()


def coder(path: str) -> TextCoder:
    """One for each worker process."""
    if path not in _coders:
        _coders[path] = TextCoder(path)
    return _coders[path]


def pieces(docs: DataFrame, tokenizer: Callable[[], str] | str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32). ``tokenizer``: a tokenizer file, or what gives its path on an executor."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer() if callable(tokenizer) else tokenizer)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            step = 256
            for lo in range(0, b.num_rows, step):
                ids, texts = b.column(0).slice(lo, step).to_pylist(), b.column(1).slice(lo, step).to_pylist()
                out: tuple[list, ...] = ([], [], [], [], [])
                for id_, text in zip(ids, texts, strict=True):
                    coded = code.encode(text or "") + end
                    total = len(coded) // 4
                    start, k = 0, 0
                    size = total % capacity or capacity if total > capacity else total
                    while start < total:
                        row = (id_, k, start, size, zlib.crc32(memoryview(coded)[4 * start : 4 * (start + size)]))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        start, k, size = start + size, k + 1, capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return at.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by remaining capacity: runs of bin numbers, and a segment tree of how many there are."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _change(self, left: int, by: int) -> None:
        at = self.leaves + left
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._change(left, n)

    def take(self, left: int, n: int) -> tuple[int, int]:
        """Up to n bins of one run with that capacity."""
        first, there = self.runs[left].popleft()
        if there > n:
            self.runs[left].appendleft((first + n, there - n))
        got = min(n, there)
        self._change(left, -got)
        return first, got

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity, ``size`` at least, of an open bin."""
        at = self.leaves + size
        if self.tree[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths. Entries (length, rank, n, each, bin, offset): pieces rank .. rank+n of
    that length go ``each`` to a bin from ``bin`` on, the first in a bin at ``offset``."""
    bins, new, entries = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = new, -(-left // each)
                new += n
            else:
                each = room // length
                first, n = bins.take(room, -(-left // each))
            full = min(n, left // each)  # bins that get all that fit
            if full:
                entries.append((length, rank, full * each, each, first, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if n > full:  # the last bin of this length gets the rest
                entries.append((length, rank, left, left, first + full, capacity - room))
                bins.add(room - left * length, first + full, 1)
                bins.add(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
    return entries


def ranked(rows: DataFrame, counts: dict[int, int], *, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``rows`` with ``rank``, from 0 within each length, without bringing the rows of a length together.

    A length is dealt by a hash to parts of about ``salt_rows`` rows, and the counts of the parts before say where each starts.
    """
    salts = rows.sparkSession.createDataFrame([(n, max(1, -(-k // salt_rows))) for n, k in counts.items()], "l long, salts long")
    salted = rows.join(F.broadcast(salts), F.col("length") == F.col("l")).drop("l")  # a row for each length: the capacity bounds them
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts").cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col("length").alias("l"), F.col("salt").alias("s"), "first")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("within", within)
    return numbered.join(starts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("first") + F.col("within")).drop("l", "s", "first", "within", "salt", "salts")


def pack(docs: DataFrame, tokenizer: Callable[[], str] | str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of the full length, most of a corpus of long texts, need no plan: each is a sequence, with a negative number.
    """
    made = checkpoint(pieces(docs, tokenizer, capacity=capacity, id_col=id_col, text_col=text_col))
    shorter = made.where(F.col("length") < capacity)
    counts = {int(r["length"]): int(r["n"]) for r in shorter.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    entries = plan(counts, capacity)
    sent = docs.sparkSession.sparkContext.broadcast(np.array(entries, np.int64).reshape(-1, 6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        # (length, rank) as one growing number: entries come by falling length and rising rank
        first = {}
        for k, length in enumerate(table[:, 0].tolist()):
            first.setdefault(length, k)
        stop = {}
        for k, length in enumerate(table[:, 0].tolist()):
            stop[length] = k + 1
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            entry = np.empty(len(length), np.int64)
            for own in np.unique(length).tolist():
                lo, hi = first[own], stop[own]
                at = length == own
                entry[at] = lo + np.searchsorted(table[lo:hi, 1], rank[at], side="right") - 1
            row = table[entry]
            step = rank - row[:, 1]
            bin_ = row[:, 4] + step // row[:, 3]
            offset = row[:, 5] + (step % row[:, 3]) * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bin_), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked(shorter, counts, salt_rows=salt_rows).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    placed = rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # a number by the partitions of the written table, which do not change
    full = made.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
