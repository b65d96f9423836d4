"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Templates are cut into words; every run of ``GRAM`` words is hashed, and of every ``WINDOW`` neighbouring hashes the least
is kept: the winnowed fingerprints, in an inverted index from hash to (template, place). All runs of a text are looked up, so
any ``GRAM + WINDOW - 1`` words that it shares with a template, or all of a template of ``GRAM`` words, meet in the index. Each meeting is a diagonal of text against
template; meetings of one template at nearby diagonals are one candidate, aligned within a band around them. Words that no
template has are one symbol without a fingerprint, so a text costs a look-up for each word and little more.

Templates that differ in a word or two must also hold the words that tell them from others (``TELLING``: version, NC, SA,
Lesser, Affero). Short licenses are whole texts without the line of the copyright holder; of the GNU
licenses, Apache and Mozilla the template is the header that files carry, and coverage is of that header.

Defined results: one row for each match of a row of the input whose coverage, the share of the template's words that the
alignment matches, is ``COVERAGE`` or more. Of matches that overlap by half of the shorter one, the one that fits best
stands for all: most words matched, then the greater coverage, then the first by place and name. Null and empty texts have none, repeated rows repeat theirs, a text of
any length is read whole, other columns are not read, and an empty table gives an empty result. Ids are whole numbers or cast to
them; a string that is none fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import ship
from spark_trials.llm.license_texts import NOTICES, TELLING, TEXTS

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
WORDS = re.compile(r"[^\W_]+")

TEMPLATES = NOTICES | TEXTS


class Index:
    """The inverted index of the winnowed templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        cut = [[w.lower() for w in WORDS.findall(t)] for t in templates.values()]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for t in cut for w in t}))}
        self.templates = [np.array([self.number[w] for w in t], np.int64) for t in cut]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            grams = self.grams(t)
            for at in self.winnow(grams).tolist():
                self.places.setdefault(int(grams[at]), []).append((k, at))
        self.known = np.array(sorted(self.places), np.uint64)
        told = [TELLING[n].split("|") if n in TELLING and templates[n] == TEMPLATES.get(n) else [] for n in self.names]
        self.telling = [[[self.number.get(w, -1) for w in run.split()] for run in runs] for runs in told]

    def told(self, k: int, words: np.ndarray) -> bool:
        """Whether all runs of telling words of template ``k`` stand in ``words``, each side by side."""
        return all(any(words[i : i + len(run)].tolist() == run for i in range(len(words) - len(run) + 1)) for run in self.telling[k])

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Hashes of runs of words; the largest number where a word is in no template."""
        n = len(words) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(GRAM):
            part = words[k : k + n]
            known &= part > 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h[~known] = np.iinfo(np.uint64).max
        return h

    def winnow(self, grams: np.ndarray) -> np.ndarray:
        """Places of the least of every window of neighbouring hashes."""
        n = len(grams) - WINDOW + 1
        if n <= 0:
            return np.arange(len(grams))
        windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
        return np.unique(np.arange(n) + windows.argmin(axis=1))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of meetings."""
        grams = self.grams(words)
        at = np.flatnonzero(np.isin(grams, self.known))  # all of them: a notice of GRAM words has one that winnowing could pass over
        met = sorted((k, place - own) for place in at.tolist() for k, own in self.places[int(grams[place])])
        out: list[tuple[int, int, int]] = []
        for k, diagonal in met:
            if out and out[-1][0] == k and diagonal - out[-1][2] <= BAND and diagonal - out[-1][1] <= BAND:
                out[-1] = (k, out[-1][1], diagonal)
            else:
                out.append((k, diagonal, diagonal))
        return out


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order within the band of diagonals low - BAND .. high + BAND: (matches, first and
    last matched place in the text). Of equal ones the shortest span counts."""
    lo, hi = low - BAND, high + BAND
    width = hi - lo + 1
    # For each diagonal: (matches, -(span), first): the best that ends there
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * width  # matches, -last, first
    top = (0, 0, -1, -1)
    for i, symbol in enumerate(template.tolist()):
        row = list(best)
        for d in range(width):
            j = i + lo + d
            here = best[d]
            if 0 <= j < len(words) and words[j] == symbol:
                m, _, first = here
                found = (m + 1, -j, first if m else j)
                here = found
                span = -(j - found[2])
                if (found[0], span) > (top[0], top[1]):
                    top = (found[0], span, found[2], j)
            # one more word of the text skipped: from the diagonal before, in this row; of the template: from the next, in the last row
            if d and row[d - 1][0] > here[0]:
                here = row[d - 1]
            if d + 1 < width and best[d + 1][0] > here[0]:
                here = best[d + 1]
            row[d] = here
        best = row
    return top[0], top[2], top[3]


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, end, matched words) of every match; start and end count characters."""
    if not text:
        return []
    of = index.number.get
    told = np.array([of(w, 0) for w in WORDS.findall(text.lower())], np.int64)
    if not index.candidates(told):
        return []
    found = [m.span() for m in WORDS.finditer(text)]
    words = np.fromiter((of(text[a:b].lower(), 0) for a, b in found), np.int64, len(found))
    met = []
    for k, low, high in index.candidates(words):
        matches, first, last = align(index.templates[k], words, low, high)
        share = matches / len(index.templates[k])
        if share >= coverage and index.told(k, words[first : last + 1]):
            met.append((matches, share, first, last, index.names[k]))
    taken: list[tuple[int, float, int, int, str]] = []
    for own in sorted(met, key=lambda m: (-m[0], -m[1], m[2], m[4])):
        _, _, first, last, _ = own
        if not any(2 * (min(last, t[3]) - max(first, t[2]) + 1) > min(last - first, t[3] - t[2]) + 1 for t in taken):
            taken.append(own)
    return sorted(((name, share, found[first][0], found[last][1], matches) for matches, share, first, last, name in taken), key=lambda r: (r[2], r[3], r[0]))


def scan_licenses(
    docs: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each match: doc_id, license, coverage, start, end, matched_words. The index goes to every task; its
    size is that of the templates."""
    ship(docs.sparkSession)
    given = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows = [(i, *m) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in scan(t, index, coverage)]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "start", "end", "matched_words"])

    at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return at.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long, matched_words int")
