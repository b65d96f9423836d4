"""Media columns: telephony audio.

Encodings of 8-bit telephony: mu-law and A-law (one byte a sample) and IMA ADPCM in blocks (four bits a sample). mu-law
and A-law expand through tables of 256 entries that a rule makes. ADPCM is a chain within a block, but blocks do not
depend on each other: one numpy step decodes the same nibble of all blocks of a batch. PCM is resampled to twice the rate by
a four-tap interpolator in whole numbers, so equal bytes give equal samples on every machine.

Media are kept in a WAV container; ``store`` and ``load`` are exact inverses.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_trials.llm.common import ship

UNIT, RATE = 192, 8000
#: Format tags of the container.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
#: How far each nibble moves the step index of IMA ADPCM.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: The 89 step sizes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
     190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
     2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
     18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of IMA ADPCM blocks (rows of bytes), one row each: 2 x (size - 4) + 1 samples."""
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | (head[:, 1] << 8)) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], 88)
    data = blocks[:, 4:].T  # a row for each byte of all blocks
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    for k in range(len(data)):
        for half in (0, 1):
            nibble = (data[k] >> 4 if half else data[k] & 15).astype(np.int32)
            step = STEPS[index]
            size = nibble & 7
            # step/8 + step/4, /2, /1 for each bit of the size, rounded down one by one
            move = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * ((size >> 1) & 1) + step * (size >> 2)
            value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + MOVES[size], 0, 88)
            out[1 + 2 * k + half] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples (-a + 9b + 9c - d) / 16, the ends repeated."""
    if not len(pcm):
        return pcm
    wide = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    between = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def store(payload: bytes, kind: str = "mulaw", rate: int = RATE, block: int = UNIT) -> bytes:
    """A WAV file whose samples (or blocks, for ADPCM) are the payload as it is."""
    if kind == "adpcm":
        per = 2 * (block - 4) + 1
        shape = struct.pack("<HHIIHHHH", TAGS[kind], 1, rate, rate * block // per, block, 4, 2, per)
    else:
        shape = struct.pack("<HHIIHHH", TAGS[kind], 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(shape)) + shape + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def load(media: bytes) -> tuple[str, int, int, bytes]:
    """(kind, rate, block size, payload) of a WAV file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, block = 12, "", 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            kind = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return kind, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, PCM) of a stored file."""
    kind, rate, block, payload = load(media)
    raw = np.frombuffer(payload, np.uint8)
    if kind == "adpcm":
        return rate, adpcm(raw.reshape(-1, block)).ravel()
    return rate, (MULAW if kind == "mulaw" else ALAW)[raw]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _level(pcm: np.ndarray) -> str:
    """Whole numbers only: samples, sum of squares, crossings of zero, peak."""
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)},{int((wide * wide).sum())},{turns},{int(np.abs(wide).max(initial=0))}"


STEP_BYTES = 4 << 20


def _steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``STEP_BYTES`` together, one row at least."""
    lo = 0
    while lo < len(sizes):
        hi, total = lo, 0
        while hi < len(sizes) and (hi == lo or total + sizes[hi] <= STEP_BYTES):
            total += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def _sizes(column: pa.Array) -> list[int]:
    return [x or 0 for x in pc.binary_length(column).to_pylist()]


def media_columns(docs: DataFrame, *, kind: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (of the text), media (the stored file), rate and pcm, what the file
    decodes to, little-endian int16, resampled to twice the stored rate.

    A null text is an empty one, whose payload is one unit of blanks. Rows do not depend on each other, so repeated rows give
    repeated results; ids are whole numbers or null, other columns are not read, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _steps(_sizes(b.column(1))):
                texts = [padded(t) for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                media = [store(payload, kind) for _, payload in texts]
                found = [decode(m) for m in media]
                pcm = [doubled(p).astype("<i2").tobytes() for _, p in found]
                columns = [pa.array([n for n, _ in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([2 * r for r, _ in found], pa.int32()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], names=["doc_id", "n_bytes", "media", "rate", "pcm"])

    at = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return at.mapInArrow(run, "doc_id long, n_bytes long, media binary, rate int, pcm binary")


def digests(stored: DataFrame) -> DataFrame:
    """Figures of stored media (``media_columns``), from the bytes that are read back: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (levels of the payload as mu-law, A-law and ADPCM) and
    pcm_sha256. Blocks of ADPCM of many rows are decoded together."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _steps(_sizes(b.column(2))):
                part = b.slice(lo, hi - lo)
                media, pcm = part.column(2).to_pylist(), part.column(3).to_pylist()
                payloads = [load(m)[3] for m in media]
                chained, at, rows = adpcm(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)), 0, []
                for n, m, payload, samples in zip(part.column(1).to_pylist(), media, payloads, pcm, strict=True):
                    raw = np.frombuffer(payload, np.uint8)
                    own = chained[at : at + len(payload) // UNIT].ravel()
                    at += len(payload) // UNIT
                    feature = f"mulaw={_level(MULAW[raw])};alaw={_level(ALAW[raw])};adpcm={_level(own)}"
                    sha = [hashlib.sha256(x).hexdigest() for x in (payload, m, samples)]
                    rows.append((n, len(payload), sha[0], zlib.crc32(payload[-16:]), len(m), sha[1], feature, sha[2]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds, strict=True))
    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, f"doc_id long, {schema}")


def telephony(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the figures of its stored media."""
    return digests(media_columns(docs, id_col=id_col, text_col=text_col))
