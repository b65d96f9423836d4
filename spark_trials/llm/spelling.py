"""Spelling variants: words one letter apart, found by a bit-sliced position index, and the form that each is a variant of.

Index: for each position and letter of a block of words there is a bitset, the words that have that letter there. A query is
read letter by letter, and four bitsets follow it over all words of the block at once, 64 in a machine word:

    exact'    = exact & same                        same:   words with the query's letter at its position
    replaced' = replaced & same | exact & ~same     ahead:  with it one position later
    inserted' = (inserted | exact) & ahead          behind: with it one position before
    deleted'  = deleted & behind | exact

The first has no error, the others one. At the query's end, words of its length in ``replaced``, one letter longer in ``inserted``
or ``exact``, and one letter shorter in ``deleted`` are near. All queries of a length take a step together.

Two words one edit apart share their first or their last half, that is half the letters of the shorter one. So words are
dealt to groups by (length of the shorter, side, half), four for each word, and meet only within them. Groups are gathered to
blocks of ``BLOCK`` words; a larger group is dealt to parts, and its words visit each part, so no task holds a group. A pair
that shares both halves is taken from the first one. Pairs are summed up to counts and the best partner where they are found.

Words are counted in tasks before they move. A chain of forms is followed by doubling: each form has five times the count of its
word, so chains are logarithmic in the corpus and a few joins of the words with forms are enough.

Defined results: a null text has no words, a null id counts as an empty one. Texts and words of any length are taken whole;
repeated rows count as often as they come. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import checkpoint, sent_if_small, ship

SHORTEST, LEAST, TIMES, EVERY = 6, 5, 5, 199
#: Words of a block, and letters: memory of a block and its bitsets is bounded by both.
BLOCK, BLOCK_LETTERS, HELD_LETTERS = 4096, 1 << 22, 1 << 23
HELD_POSITIONS = 32
#: Words of a query batch times 64-bit words of a block.
STEP = 1 << 17
#: a-z, then U+00C0 to U+00FF.
LETTERS, FIRST_ACCENT = 26 + 64, 0xC0
GATHERED, HELD, ASKED = 0, 1, 2


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with the planted deletions; partial counts of tasks are summed."""
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")  # a shorter run is no word, with or without a deletion

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        letters = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for key, text in zip(b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist(), strict=True):
                    if not text:
                        continue
                    base = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(run.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes: lower() is ASCII's
                        h = zlib.crc32(word.encode(), base)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        if word in held:
                            held[word] += n
                        else:
                            held[word] = n
                            letters += 16 + len(word)
                    if letters > HELD_LETTERS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                        held, letters = {}, 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    ship(docs.sparkSession)
    at = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    return at.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a row of letter numbers for each word, LETTERS beyond its end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.full((len(words), int(lengths.max(initial=0))), LETTERS, np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(flat < 128, flat - ord("a"), flat - FIRST_ACCENT + 26)
    return out, lengths


def _bits(rows: np.ndarray) -> np.ndarray:
    """Booleans (a row for each bitset) packed in 64-bit words."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


class PositionIndex:
    """The bitsets of a block of words, made for a position when it is asked for; of long words only those nearby are held."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths, self.width = codes, lengths, -(-len(codes) // 64)
        self.made: dict[int, np.ndarray] = {}

    def at(self, position: int) -> np.ndarray:
        """A bitset for each letter; the last row, of no letter, is the words that end before."""
        if position not in self.made:
            rows = np.zeros((LETTERS + 1, len(self.codes)), bool)
            if 0 <= position < self.codes.shape[1]:
                rows[self.codes[:, position], np.arange(len(self.codes))] = True
                rows[LETTERS] = self.codes[:, position] == LETTERS
            else:
                rows[LETTERS] = True
            if len(self.made) == HELD_POSITIONS:
                self.made = {p: b for p, b in self.made.items() if abs(p - position) <= 2}
            self.made[position] = _bits(rows)
        return self.made[position]

    def of_length(self, n: int) -> np.ndarray:
        return _bits((self.lengths == n)[None])[0]

    def near(self, queries: np.ndarray, *, shorter: bool, longer: bool, equal: bool) -> np.ndarray:
        """A bitset for each query (rows of letters, all of one length): the words one edit away."""
        n = queries.shape[1]
        exact = np.full((len(queries), self.width), ~np.uint64(0))
        replaced, inserted, deleted = (np.zeros_like(exact) for _ in range(3))
        for i in range(n):
            c = queries[:, i]
            same = self.at(i)[c]
            if equal:
                replaced = (replaced & same) | (exact & ~(same | self.at(i)[LETTERS]))
            if longer:
                inserted = (inserted | exact) & self.at(i + 1)[c]
            if shorter:
                deleted = (deleted & self.at(i - 1)[c]) | exact
            exact = exact & same
        out = np.zeros_like(exact)
        if equal:
            out |= replaced & self.of_length(n)
        if longer:
            out |= (inserted | exact) & self.of_length(n + 1)
        if shorter:
            out |= deleted & self.of_length(n - 1)
        return out


def _ones(bitsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of all ones."""
    row, word = np.nonzero(bitsets)
    bits = np.unpackbits(bitsets[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(bits)
    return row[k], 64 * word[k] + bit


class Block:
    """Words of one length and of one more, in groups; queries meet the words of their own group."""

    def __init__(self, short: int):
        self.short, self.words, self.counts, self.groups, self.sides = short, [], [], [], []

    def add(self, word: str, n: int, group: int, side: int) -> None:
        self.words.append(word)
        self.counts.append(n)
        self.groups.append(group)
        self.sides.append(side)

    def extend(self, other: Block) -> None:
        for own, more in zip((self.words, self.counts, self.groups, self.sides), (other.words, other.counts, other.groups, other.sides), strict=True):
            own += more

    def full(self) -> bool:
        return len(self.words) >= BLOCK or len(self.words) * self.short >= BLOCK_LETTERS

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (*letter_codes(self.words), np.array(self.groups), np.array(self.sides))


def meet(asked: Block, block: Block) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the largest count among them, the first of these) for the words of ``asked`` near some in ``block``."""
    if not asked.words or not block.words:
        return
    codes, lengths, groups, _ = block.arrays()
    asked_codes, asked_lengths, asked_groups, asked_sides = asked.arrays()
    index, half, short = PositionIndex(codes, lengths), block.short // 2, block.short
    found: dict[int, tuple[int, int, str]] = {}
    for n in (short, short + 1):
        own = np.flatnonzero(asked_lengths == n)
        step = max(1, STEP // max(1, index.width))
        for lo in range(0, len(own), step):
            rows = own[lo : lo + step]
            q, j = _ones(index.near(asked_codes[rows, :n], shorter=n > short, longer=n == short, equal=n == short))
            q = rows[q]
            keep = asked_groups[q] == groups[j]
            q, j = q[keep], j[keep]
            first = (asked_codes[q, :half] == codes[j, :half]).all(axis=1)
            keep = (asked_sides[q] == 0) | ~first
            for a, b in zip(q[keep].tolist(), j[keep].tolist(), strict=True):
                k, most, best = found.get(a, (0, 0, ""))
                count, word = block.counts[b], block.words[b]
                found[a] = (k + 1, count, word) if (-count, word) < (-most, best) else (k + 1, most, best)
    for a, (k, most, best) in found.items():
        yield asked.words[a], k, most, best


def dealt(words: DataFrame) -> DataFrame:
    """(short, side, half, part, role, word, n): each word in its groups, those of more than a block in parts.

    A word of a small group is gathered in a block and asked of it; one of a large group is held by a part and asked of all.
    """
    length = F.char_length("word")

    def group(side: int, short):
        half = F.floor(short / 2).cast("int")
        return F.struct(short.alias("short"), F.lit(side).alias("side"), (F.right("word", half) if side else F.left("word", half)).alias("half"))

    own = F.array(group(0, length), group(1, length))
    longer = F.when(length > F.lit(SHORTEST), F.array(group(0, length - 1), group(1, length - 1))).otherwise(F.array().cast("array<struct<short:int,side:int,half:string>>"))
    rows = words.select("word", "n", F.explode(F.concat(own, longer)).alias("g")).select("word", "n", "g.*")
    sizes = rows.groupBy("short", "side", "half").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_n") * F.col("short") / BLOCK_LETTERS)).cast("int")
    large = sizes.withColumn("_parts", parts).where("_parts > 1").select(F.col("short").alias("_s"), F.col("side").alias("_d"), F.col("half").alias("_h"), "_parts")
    at = sent_if_small(checkpoint(large))
    rows = rows.join(at, (F.col("short") == F.col("_s")) & (F.col("side") == F.col("_d")) & (F.col("half") == F.col("_h")), "left")
    place = F.struct(F.pmod(F.xxhash64("word"), "_parts").cast("int").alias("part"), F.lit(HELD).alias("role"))
    every = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(ASKED).alias("role")))
    all_ = F.when(F.col("_parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(GATHERED).alias("role")))).otherwise(F.concat(F.array(place), every))
    return rows.withColumn("_at", F.explode(all_)).select("short", "side", "half", "_at.part", "_at.role", "word", "n")


def visits(rows: Iterator[tuple]) -> Iterator[tuple[Block, Block]]:
    """(asked, block) of sorted rows: small groups gathered, parts of large ones with their visitors, a block of them at a time."""
    small = Block(0)
    for group, ((short, side, _, _), own) in enumerate(groupby(rows, key=itemgetter(0, 1, 2, 3))):
        block, asked, role = Block(short), Block(short), GATHERED
        for _, _, _, _, role, word, n in own:
            if role == ASKED and asked.full():
                yield asked, block
                asked = Block(short)
            (asked if role == ASKED else block).add(word, n, group, side)
        if role != GATHERED:
            yield asked, block
            continue
        if small.full() or small.short != short:
            yield small, small
            small = Block(short)
        small.extend(block)
    yield small, small


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, most, best) of the words (word, n) that have near ones: how many, and the commonest of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, block in visits(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            if found := list(meet(asked, block)):
                columns = zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["word", "n_near", "most", "best"])

    groups = dealt(words).repartition("short", "side", "half", "part").sortWithinPartitions("short", "side", "half", "part", "role")
    made = groups.mapInArrow(search, "word string, n_near long, most long, best string")
    best = F.min(F.struct((-F.col("most")).alias("m"), "best")).alias("b")
    return made.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("most"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms. A step doubles what has been followed."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = checkpoint(now.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        if not step.where("_moved").limit(1).count():
            return step.drop("_moved")
        now = step.drop("_moved")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a form is the commonest near word, where that has ``times`` the word's count."""
    counted = word_counts(docs, id_col=id_col, text_col=text_col, every=every)
    words = checkpoint(counted.where(F.col("n") >= least))
    met = words.join(near_words(words), "word", "left")
    varies = F.col("most") >= times * F.col("n")
    named = checkpoint(met.select("word", F.when(varies, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(varies, F.col("most")).alias("form_n")))
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
