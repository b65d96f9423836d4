"""URL filters by a bit-parallel wildcard automaton.

Every glob rule becomes a run of bits in masks of 64-bit words. For each character of a canonical URL the state of all
rules moves one place by a shift and an AND (Shift-And); ``*`` is a bit that keeps itself set. The state of a batch of
URLs is a matrix of words, so one numpy step moves all rules of all URLs.

Canonical form: ``.`` + host + the byte 0xFF + path. UTF-8 never holds 0xFF, so no rule can match across the border of
host and path. A rule ``example.org/es/`` is the glob ``*.example.org<FF>/es/*``: its host, all subdomains, paths that
start so. Rules may hold ``*`` (any run of bytes) in host and path.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. Of the rules that fit, the
longest wins (then block before allow, then code point order). A URL that no rule fits gets ``default``. Rows are kept
one by one, so repeated rows give repeated results, an empty table an empty one, and other columns are not read. URLs of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import lower_ascii, ship

BORDER = 0xFF
STEP_CELLS = 1 << 22


class ShiftAnd:
    """All rules packed in masks of 64-bit words."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        """rules: (host glob, path prefix glob, verdict)."""
        ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
        self.names = [host + path for host, path, _ in ranked]
        self.verdicts = [verdict for _, _, verdict in ranked]
        bits: list[tuple[int | None, bool]] = []  # of each bit: the byte that enters it, whether it then stays
        self.last, first = [], []
        for host, path, _ in ranked:
            first.append(len(bits))
            at_star = True  # "*" before the leading dot
            bits.append((None, True))
            for byte in b"." + host.lower().encode() + bytes([BORDER]) + path.encode():
                if byte == 0x2A:
                    if not at_star:
                        bits[-1] = (bits[-1][0], True)
                    at_star = True
                else:
                    bits.append((byte, False))
                    at_star = False
            bits[-1] = (bits[-1][0], True)  # what follows the prefix is free
            self.last.append(len(bits) - 1)
        # Behind so many bytes of the path no rule can move; a star within a path has no such place.
        self.reach = None if any("*" in path for _, path, _ in ranked) else max((len(path.encode()) for _, path, _ in ranked), default=0)
        self.words = (len(bits) + 63) // 64
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (byte, stays) in enumerate(bits):
            bit = np.uint64(1 << (i % 64))
            if byte is not None:
                self.enter[byte, i // 64] |= bit
            if stays:
                self.stay[i // 64] |= bit
        for i in first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def best(self, urls: list[bytes]) -> np.ndarray:
        """Of each canonical URL the place of its winning rule, or -1."""
        out = np.full(len(urls), -1, np.int64)
        if not self.names or not urls:
            return out
        ends = map(len, urls) if self.reach is None else (min(len(u), u.index(BORDER) + 1 + self.reach) for u in urls)
        lengths = np.fromiter(ends, np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        lo = 0
        while lo < len(order):  # long URLs in small blocks: the cells of a block are bounded
            hi = lo + max(1, min(len(order) - lo, STEP_CELLS // max(1, int(lengths[order[lo]]))))
            own = order[lo:hi]
            out[own] = self._block([urls[i] for i in own], lengths[own])
            lo = hi
        return out

    def _block(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths[0])
        grid = np.zeros((len(urls), width), np.uint8)
        for i, u in enumerate(urls):
            grid[i, : lengths[i]] = np.frombuffer(u, np.uint8, lengths[i])
        state = np.broadcast_to(self.start, (len(urls), self.words)).copy()
        one, top = np.uint64(1), np.uint64(63)
        for k in range(width):
            live = int(np.searchsorted(-lengths, -k, side="left"))  # URLs longer than k come first
            s = state[:live]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.enter[grid[:live, k]]) | (s & self.stay)
        best = np.full(len(urls), -1, np.int64)
        for rule in range(len(self.last) - 1, -1, -1):  # better rules come first
            word, bit = divmod(self.last[rule], 64)
            best[(state[:, word] >> np.uint64(bit)) & one == one] = rule
        return best


def canonical(host: str, path: str) -> bytes:
    return b"." + host.encode("utf-8", "surrogatepass") + bytes([BORDER]) + path.encode("utf-8", "surrogatepass")


def host_and_path(url):
    """Columns: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + F.lit(1), F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict. ``rules``: (host, path prefix, allow or block)."""
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("url")).select(
        F.col(id_col), host.alias("host"), path.alias("path")
    )
    kind = parts.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd(rules)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = machine.best([canonical(h, p) for h, p in zip(hosts, paths, strict=True)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    b.column(2),
                    pa.array([machine.names[i] if i >= 0 else None for i in at], pa.string()),
                    pa.array([machine.verdicts[i] if i >= 0 else default for i in at], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
