"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence on, and up to every sentence, the fewest consecutive ones, ``SENTENCES`` at
least, that hold ``words`` words are a span; its hash is taken over the lower-cased words. Equal spans anywhere in the corpus are repeats. The first
one, by (doc_id, text, place), stays; all sentences that any other one covers go. A sentence that goes has an equal one in
an earlier place, so of each repeated passage one copy stays.

A sentence ends after ``.``, ``!`` or ``?`` and a blank, and at a line end. One of more than ``LONG`` words, such as a
passage that was pasted into the middle of another sentence, is cut into clauses: after ``,``, ``;`` or ``:`` and a blank,
and before capitals that follow a blank. What a passage shares at its edges with the sentences around it stays: its words
before its first border and behind its last one.

Scale: a first pass counts bare hashes, with partial sums; a second one emits place and a second hash, 128 bits in all, of
those spans only that came twice, so a passage in a third of all documents is a count, a minimum, and a join that adaptive
execution splits. Texts meet their own cuts by the id.

Defined results: a null text stays null, and an empty one empty. A text of fewer words than a span has no span and stays.
Rows that repeat an id and a text are one document: all get the same cleaned text, in which what it holds first stays.
Null ids come first in order; ids are whole numbers. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_trials.llm.common import SENT_ROWS, checkpoint, fresh, ship

WORDS, SENTENCES, LONG = 20, 2, 20
BREAK = re.compile(r"\n\s*|(?<=[.!?])[^\S\n]+")
CLAUSE = re.compile(r"(?<=[,;:])[^\S\n]+|[^\S\n](?=[A-ZÀ-ÖØ-Þ])")
_ODD, _SEEDS = 0x9E3779B97F4A7C15, (0, 7)
_PLACES = 1 << 16


def _cut(text: str, border: re.Pattern, at: int, stop: int) -> list[tuple[int, int]]:
    out = []
    for m in border.finditer(text, at, stop):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    return [*out, (at, stop)] if at < stop else out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that holds a word; an end takes the break with it."""
    out = []
    for a, b in _cut(text, BREAK, 0, len(text)):
        # so many words have so many letters and blanks at least
        long = b - a > 2 * LONG and len(text[a:b].split()) > LONG
        out += _cut(text, CLAUSE, a, b) if long else [(a, b)]
    return [(a, b) for a, b in out if not text[a:b].isspace()]


_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of an odd number, and of its inverse, modulo 2^64."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, 2 * _powers.shape[1])
        pair = np.array([[_ODD], [pow(_ODD, -1, 1 << 64)]], np.uint64)
        _powers = np.concatenate([np.ones((2, 1), np.uint64), np.multiply.accumulate(np.repeat(pair, size - 1, axis=1), axis=1)], axis=1)
    return _powers[:, :n]


def spans(text: str, words: int = WORDS, least: int = SENTENCES, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """(first sentence, number of sentences, a hash for each seed) of every span, each place once."""
    none = np.zeros(0, np.int64)
    cut = sentences(text)
    if len(cut) < least:
        return none, none, *[none for _ in seeds]
    hash_ = xxhash.xxh64_intdigest
    own = [text[a:b].lower().split() for a, b in cut]
    joined = [" ".join(w).encode("utf-8", "surrogatepass") for w in own]
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
    places, size = np.arange(len(cut) + 1), len(cut) + 1
    stop = np.maximum(np.searchsorted(total, total[:-1] + words, side="left"), places[:-1] + least)
    first = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, places[1:] - least)
    on, up_to = stop < size, first >= 0
    first, stop = np.divmod(np.unique(np.concatenate([places[:-1][on] * size + stop[on], first[up_to] * size + places[1:][up_to]])), size)
    up, down = _power(len(cut) + 1)
    out = []
    for seed in seeds:
        hashes = np.array([hash_(j, seed) for j in joined], np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
        out.append(((sums[stop] - sums[first]) * down[first]).view(np.int64))
    return first, stop - first, *out


def _id(docs: DataFrame, id_col: str, text_col: str):
    return F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))


_STEP = 512


def _hashes(docs: DataFrame, words: int, least: int, text_col: str) -> DataFrame:
    """(span) of every span of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _STEP):
                found = [spans(t or "", words, least)[2] for t in b.column(0).slice(lo, _STEP).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["span"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "span long")


def _places(docs: DataFrame, words: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(span, second, id, text_hash, place) of every span of every text; ``place`` is first * 65536 + number of sentences."""
    id_, hash_ = _id(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _STEP):
                found = [spans(t or "", words, least, _SEEDS) for t in b.column(2).slice(lo, _STEP).to_pylist()]
                sizes = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
                which = pa.array(np.repeat(np.arange(len(found)), sizes) + lo)
                first, n, hashes, second = (np.concatenate([f[k] for f in found]) for k in range(4))
                columns = [pa.array(hashes), pa.array(second), b.column(0).take(which), b.column(1).take(which), pa.array(first * _PLACES + n)]
                yield pa.RecordBatch.from_arrays(columns, names=["span", "second", "id", "text_hash", "place"])

    at = docs.select(id_.alias("id"), hash_.alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return at.mapInArrow(run, "span long, second long, id long, text_hash long, place long")


def repeated(docs: DataFrame, *, words: int = WORDS, least: int = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, cuts): of each document with spans to remove, their places, packed as first * 65536 + number and merged
    where they overlap or touch."""
    if max(words, least) >= _PLACES:
        raise ValueError(f"a span holds fewer than {_PLACES} words and sentences")
    ship(docs.sparkSession)
    # Written down, the counted side has an exchange of its own, without which a join's hot span cannot be split.
    often = checkpoint(_hashes(docs, words, least, text_col).groupBy("span").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("span"))
    again = checkpoint(_places(docs, words, least, id_col, text_col).join(often, "span"))
    # rows that repeat an id and a text have the same places, all of them first ones
    at = F.struct("id", "text_hash", "place")
    head = checkpoint(again.groupBy("span", "second").agg(F.min(at).alias("head")))
    gone = again.join(head, ["span", "second"]).where(~at.eqNullSafe(F.col("head"))).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("c"))
    return gone.select("id", "text_hash", F.expr(_MERGED).alias("cuts"))


#: Sorted places ``c`` as the fewest that cover the same sentences: those that overlap or touch are one.
_MERGED = """aggregate(c, named_struct('done', cast(array() as array<bigint>), 'at', c[0] div 65536L, 'to', c[0] div 65536L),
  (m, x) -> if(x div 65536L <= m.to and x div 65536L + x % 65536L - m.at < 65536L,
    named_struct('done', m.done, 'at', m.at, 'to', greatest(m.to, x div 65536L + x % 65536L)),
    named_struct('done', concat(m.done, array(m.at * 65536L + m.to - m.at)), 'at', x div 65536L, 'to', x div 65536L + x % 65536L)),
  m -> concat(m.done, array(m.at * 65536L + m.to - m.at)))"""


def clean(text: str, cuts: np.ndarray) -> tuple[str, int, int]:
    """The text without the covered sentences, how many it had and how many went."""
    cut = sentences(text)
    change = np.zeros(len(cut) + 1, np.int64)
    np.add.at(change, cuts // _PLACES, 1)
    np.add.at(change, cuts // _PLACES + cuts % _PLACES, -1)
    gone = np.cumsum(change)[:-1] > 0
    parts, at = [], 0
    for (a, b), out in zip(cut, gone.tolist(), strict=True):
        if out:
            parts.append(text[at:a])
            at = b
    parts.append(text[at:])
    return "".join(parts), len(cut), int(gone.sum())


def dedup(docs: DataFrame, *, words: int = WORDS, least: int = SENTENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with cleaned texts, and two more columns: n_sentences and n_removed (0 where nothing went).

    If the input has columns of these names, they are replaced; ``cleaned`` keeps them.
    """
    ship(docs.sparkSession)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    i, h, cuts = fresh(columns, "i", "h", "cuts")
    removals = checkpoint(repeated(docs, words=words, least=least, id_col=id_col, text_col=text_col))
    # a row for each document that has cuts, and eight bytes for each cut
    total = removals.agg(F.count(F.lit(1)) * 8 + F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    removals = removals.select(F.col("id").alias(i), F.col("text_hash").alias(h), F.col("cuts").alias(cuts))
    if total <= 8 * SENT_ROWS:
        removals = F.broadcast(removals)
    id_, hash_ = _id(docs, id_col, text_col)
    met = docs.join(removals, id_.eqNullSafe(F.col(i)) & (hash_ == F.col(h)), "left").select(*[F.col(f"`{c}`") for c in columns], cuts)
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 1024
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                texts, gone = part.column(place).to_pylist(), part.column(len(columns))
                n = np.zeros((2, len(texts)), np.int32)
                for k, (t, marked) in enumerate(zip(texts, gone.is_valid().to_pylist(), strict=True)):
                    if marked and t:
                        texts[k], n[0, k], n[1, k] = clean(t, np.array(gone[k].as_py(), np.int64))
                    elif t:
                        n[0, k] = len(sentences(t))
                out = list(part.columns[: len(columns)])
                out[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*out, pa.array(n[0]), pa.array(n[1])], names=[*columns, "n_sentences", "n_removed"])

    schema = met.select(*[F.col(f"`{c}`") for c in columns]).schema.add("n_sentences", T.IntegerType()).add("n_removed", T.IntegerType())
    return met.mapInArrow(run, schema)


def cleaned(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of ``docs`` with cleaned texts and nothing more."""
    clash = {c: f"{fresh(docs.columns, c)[0]}_kept" for c in docs.columns if c in ("n_sentences", "n_removed")}
    back = {kept: c for c, kept in clash.items()}
    return dedup(docs.withColumnsRenamed(clash), text_col=text_col, **options).drop("n_sentences", "n_removed").withColumnsRenamed(back)
