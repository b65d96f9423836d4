import hashlib
import random
import zlib

import numpy as np
import pytest

from spark_trials.llm import telephony as tel


def mulaw(byte):
    u = ~byte & 0xFF
    size = (((u & 15) * 2 + 33) << (u >> 4 & 7)) - 33
    return -4 * size if u & 128 else 4 * size


def alaw(byte):
    a = byte ^ 0x55
    part, low = a >> 4 & 7, a & 15
    size = (2 * low + 1) * 8 if part == 0 else (2 * low + 33) * 8 << (part - 1)
    return size if a & 128 else -size


def adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if nibble & bit else 0
            value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
            index = max(0, min(88, index + int(tel.MOVES[nibble & 7])))
            out.append(value)
    return out


def test_tables():
    assert tel.MULAW.tolist() == [mulaw(b) for b in range(256)]
    assert tel.ALAW.tolist() == [alaw(b) for b in range(256)]


def test_adpcm_blocks():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(9 * tel.UNIT))
    got = tel.adpcm(np.frombuffer(raw, np.uint8).reshape(-1, tel.UNIT))
    assert got.tolist() == [adpcm(raw[k : k + tel.UNIT]) for k in range(0, len(raw), tel.UNIT)]


@pytest.mark.parametrize("kind", ["mulaw", "alaw", "adpcm"])
def test_round_trip(kind):
    rng = random.Random(2)
    for n in (1, 3):
        payload = bytes(rng.randrange(256) for _ in range(n * tel.UNIT))
        media = tel.store(payload, kind)
        assert tel.load(media)[0] == kind and tel.load(media)[3] == payload
        assert len(tel.decode(media)[1]) == (n * 377 if kind == "adpcm" else n * tel.UNIT)
    with pytest.raises(ValueError):
        tel.load(b"something else")


def test_resampling():
    pcm = np.array([0, 160, -320, 32767, 32767, -32768], np.int16)
    out = tel.doubled(pcm)
    assert out[::2].tolist() == pcm.tolist() and len(out) == 12
    x = [0, *pcm.tolist(), -32768, -32768]
    want = [max(-32768, min(32767, (9 * (x[k + 1] + x[k + 2]) - x[k] - x[k + 3] + 8) >> 4)) for k in range(6)]
    assert out[1::2].tolist() == want
    assert len(tel.doubled(np.zeros(0, np.int16))) == 0


def level(samples):
    turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
    return f"{len(samples)},{sum(x * x for x in samples)},{turns},{max(map(abs, samples))}"


def test_features_sample_by_sample(docs, docs_rows, spark):
    """Every feature and the PCM again, one sample after another; one text of many batches' bytes among them."""
    long = "ab é\n" * 300_000
    rows = [(i, t) for i, t, *_ in docs_rows if len(t or "") < 800][:40]
    got = tel.telephony(spark.createDataFrame([*rows, (99, long)], "doc_id long, text string")).collect()
    assert len(got) == len(rows) + 1
    want = {}
    for _, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
        mu = [mulaw(b) for b in payload]
        chained = [x for k in range(0, len(payload), 192) for x in adpcm(payload[k : k + 192])]
        wide = [mu[0], *mu, mu[-1], mu[-1]]
        doubled = [v for k in range(len(mu)) for v in (mu[k], max(-32768, min(32767, (9 * (wide[k + 1] + wide[k + 2]) - wide[k] - wide[k + 3] + 8) >> 4)))]
        pcm = hashlib.sha256(b"".join(x.to_bytes(2, "little", signed=True) for x in doubled)).hexdigest()
        want[hashlib.sha256(payload).hexdigest()] = (f"mulaw={level(mu)};alaw={level([alaw(b) for b in payload])};adpcm={level(chained)}", pcm)
    for r in got:
        if r["doc_id"] != 99:
            assert (r["feature"], r["pcm_sha256"]) == want[r["payload_sha256"]]
    assert next(r for r in got if r["doc_id"] == 99)["n_bytes"] == len(long.encode())


def test_query_columns(docs, docs_rows, clashing, no_docs, spark):
    def plain(text):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
        media = tel.store(payload)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()

    want = sorted(((r[0], *plain(r[1])) for r in docs_rows), key=str)
    for df in (docs, clashing):
        got = tel.telephony(df).collect()
        assert sorted((tuple(r[:7]) for r in got), key=str) == want
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], (r["feature"], r["pcm_sha256"], r["media_sha256"])) == (r["feature"], r["pcm_sha256"], r["media_sha256"])
    assert tel.telephony(no_docs).count() == 0
    for kind in ("alaw", "adpcm"):
        row = tel.media_columns(docs.where("doc_id = 3"), kind=kind).first()
        assert row["rate"] == 16000 and np.frombuffer(row["pcm"], "<i2")[::2].tolist() == tel.decode(bytes(row["media"]))[1].tolist()
