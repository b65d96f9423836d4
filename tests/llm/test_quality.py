import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from llm_samples import prose

from spark_trials.llm import quality


def discount(n):
    n1, n2, n3, n4 = n
    if not n1:
        return [0, 0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return [0, min(max(d1, 0), 1), min(max(d2, 0), 2), min(max(d3, 0), 3)]


def plain(trained, texts, bits):
    """The formulas, word by word."""
    size = 1 << bits

    def ids(t):
        return [0, *[xxhash.xxh64_intdigest(w.encode()) % (size - 2) + 2 for w in (t or "").split()], 1]

    pairs = Counter(p for t in trained for i in [ids(t)] for p in zip(i, i[1:], strict=False))
    d = discount([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    after, before = defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        after[v][w] = c
        before[w] += 1
    e = discount([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    total, back = sum(before.values()), sum(e[min(c, 3)] for c in before.values())

    def p_word(w):
        return (before[w] - e[min(before[w], 3)]) / total + back / total / size if total else 1 / size

    def p(v, w):
        own = after.get(v)
        if not own:
            return p_word(w)
        n = sum(own.values())
        return (own[w] - d[min(own[w], 3)]) / n + sum(d[min(c, 3)] for c in own.values()) / n * p_word(w)

    return [-sum(math.log(p(v, w)) for v, w in zip(i, i[1:], strict=False)) / (len(i) - 1) for i in map(ids, texts)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for k in range(240):
        text = prose(rng, rng.randint(20, 80), "abcd") if k % 3 else prose(rng, 40, "vwxyz").upper()
        rows.append((k, text, "en" if k % 2 else None, "x", 1))
    rows += [(500, None, "en", "x", 1), (501, "", "zz", "x", 1), (502, prose(rng, 30_000, "abcd"), "en", "x", 1), (None, "abc abd", "en", "x", 1), (7, rows[7][1], "en", "x", 1)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 240, 1) if k % 7] + [(None, 1, 0), (900, 1, 0), (8, 0, 0)]
    schema = "doc_id long, text string, lang string, shard string, batch int"
    return spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_against_plain_formulas(corpus, monkeypatch):
    docs, labels, rows = corpus
    got = quality.perplexities(docs, labels, shards=4).collect()
    assert len(got) == len(rows)
    trusted = {r["doc_id"] for r in got if r["trusted"]}
    assert trusted == {k for k in range(240) if k % 7 and k % 3 and k != 8} | ({8} if 8 % 3 else set())
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert held and held < trusted
    trained = [t for i, t, *_ in rows if i in trusted and i not in held]
    want = sorted(zip([str(r[0]) for r in rows], plain(trained, [r[1] for r in rows], quality.BITS), strict=True))
    found = sorted((str(r["doc_id"]), r["log_perplexity"]) for r in got)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [p for _, p in found] == pytest.approx([p for _, p in want], rel=2e-6)


def test_probabilities_sum_to_one():
    import numpy as np

    small = np.zeros(quality.WORDS, np.uint8)
    small[[2, 5, 9]] = 1, 2, 255
    p_word = quality.WordModel(small, np.array([9]), np.array([700]))
    every = np.arange(quality.WORDS)
    assert p_word(every).sum() == pytest.approx(1) and p_word(np.array([3])) > 0
    assert p_word(np.array([9]))[0] == pytest.approx(700 / 703, rel=0.01)
    shard = quality.Shard(np.array([2, 5, 9], np.uint64), np.array([1, 3, 7]), np.array([0, 0.6, 1.1, 1.4]), p_word)
    assert shard.p(every.astype(np.uint64)).sum() == pytest.approx(1)


def test_dealing_changes_no_score(corpus):
    """Many shards and salts, where one word begins most pairs, score as few do."""
    docs, labels, _ = corpus
    few = quality.perplexities(docs, labels, shards=1)
    many = quality.perplexities(docs, labels, shards=64, shard_words=50)
    a, b = (sorted((str(r["doc_id"]), r["n_words"], r["log_perplexity"]) for r in x.collect()) for x in (few, many))
    assert a == b  # to the last bit


def test_judgement(corpus, spark):
    docs, labels, rows = corpus
    out = quality.judge(docs, labels, shards=4, keep=0.9).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"] for r in out if r["kept"]}
    junk = {k for k in range(240) if k % 3 == 0}
    assert not kept & junk and len(kept - junk) >= 0.8 * 160
    assert all(r["kept"] for r in quality.judge(docs, labels.limit(0), shards=4).collect())
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_planes():
    import numpy as np

    x = np.array([0, 1, 255, 256, 2**52 - 1], np.uint64)
    assert quality.unplanes(quality.planes(x)).tolist() == quality.unrising(quality.rising(x)).tolist() == x.tolist()


@pytest.mark.parametrize("shards", [1, 2, 64])
def test_parts(shards):
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 2 * quality.BITS, 5000).astype(np.uint64))
    part, short = quality.parted(keys, shards)
    assert len(np.unique(part)) == shards
    for k in range(shards):
        assert (np.diff(short[part == k].astype(np.int64)) > 0).all()
        assert (quality.whole(short[part == k], k, shards) == keys[part == k]).all()


def test_batches_are_dealt_evenly():
    """Partitions of few batches each: by their number alone all would fall in a few salts."""
    numbers = [(part << 32) | k for part in range(1000) for k in range(7)]
    for ways in (8, 64, 512):
        dealt = [0] * ways
        for n in numbers:
            dealt[quality.mixed(n) % ways] += 1
        assert min(dealt) > 0 and max(dealt) < 3 * len(numbers) / ways


def test_long_words_are_not_kept():
    quality._ids.clear()
    quality.word_ids("short " + " ".join("x" * 10_000 + str(k) for k in range(50)))
    assert list(quality._ids) == ["short"]
