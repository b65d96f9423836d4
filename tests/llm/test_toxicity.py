import math
import random
import time
import zlib

import pytest
from llm_samples import prose

from spark_trials.llm import toxicity



@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        text, bad = prose(rng, rng.randint(5, 60)), k % 4 == 0
        if bad:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "Grobianisch", "lump"]))
            text = " ".join(words)
        rows.append((k, text, "en", "a", 1))
        if k % 3 < 2 or bad:
            labels.append((k, 1, int(bad)))
    rows += [(9000, None, "en", "a", 0), (9001, "", "en", "a", 0), (9001, "", "en", "a", 0), (None, "grobian lump", "en", "a", 0), (9002, "grobian " + prose(rng, 20_000), "en", "a", 0)]
    labels += [(0, 1, 0), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(marked):
    docs, labels, rows = marked
    out = toxicity.judge(docs, labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(r["predicted"] for r in held if r["doc_id"] % 4 == 0) >= 0.95 * sum(r["doc_id"] % 4 == 0 for r in held)
    assert sum(r["predicted"] for r in held if r["doc_id"] % 4) <= 0.02 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (9000, 9001)}
    assert len(empty) == 1 and empty.pop() < 0.7


def test_only_toxic_rows_go(marked):
    from pyspark.sql import functions as F

    docs, labels, _ = marked
    wide = docs.withColumns({c: F.lit(1) for c in ("features", "score", "__bad", "i", "margin")})
    out = toxicity.without_toxic(wide, labels)
    assert out.columns == wide.columns
    bad = {r["doc_id"] for r in toxicity.judge(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    assert out.where("doc_id = 9001").count() == 2


def test_without_both_labels(marked, no_docs):
    docs, labels, rows = marked
    one = toxicity.judge(docs, labels.where("toxic = 0"))
    assert one.where("score = 0 and predicted = 0").count() == len(rows)
    assert toxicity.judge(no_docs, labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == len(rows)


def slow_features(text, lexicon):
    """The twelve numbers letter by letter, without patterns."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    weight = [next((lexicon[k] for k in (w, w[:5] + "*", w[:4] + "*") if lexicon.get(k)), 0.0) for w in words]
    hits = [k for k, x in enumerate(weight) if x]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON] if hits else []
    near = sum(any(abs(h - y) <= 5 for y in you) for h in hits)
    letter, joint = (lambda c: c.isalnum() and not c.isdecimal()), set("0123456789@$*#!|+")
    hidden = k = 0
    while k < len(text):
        if not letter(text[k]):
            k += 1
            continue
        parts = 0
        while k < len(text) and letter(text[k]):
            k += 1
        while True:
            j = k
            while j < len(text) and text[j] in joint:
                j += 1
            if j == k or j == len(text) or not letter(text[j]):
                break
            while j < len(text) and letter(text[j]):
                j += 1
            k, parts = j, parts + 1
        hidden += parts > 0
    big = {chr(c) for r in ((65, 91), (0xC0, 0xD7), (0xD8, 0xDF)) for c in range(*r)}
    runs, k = 0, 0
    while k < len(text):
        j = k
        while j < len(text) and text[j] in big:
            j += 1
        sign = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        runs += j - k >= 3 and not sign(k - 1) and not sign(j)
        k = max(j, k + 1)
    plain = sum("A" <= c <= "Z" for c in text)
    n, size = max(1, len(words)), len(text)
    return [
        len(hits) / n, math.log1p(len(hits)), sum(weight) / n, max(weight, default=0.0), near / n, len(you) / n, plain / size, runs / n if plain > 2 else 0.0,
        text.count("!") / size, sum(c in ".,;:?\"'()-" for c in text) / size, hidden / n, math.log1p(len(words)),
    ]


def test_features_against_slow_ones():
    lexicon, rng = {"lump": 2.0, "grobi*": 3.0, "shut*": 1.5, "b": 0.5}, random.Random(4)
    bits = ["LUMP", "lump", "grobian", "grobianisch", "you", "Du", "vos", "shutting", "gr0b1an", "a1b2c3", "A$$", "x!!y", "ABC", "ÄÖÜ", "ab_CDE", "²x", "b", "1+1", "été", "don't", "(so)", "--", "!", "!!!", "\n", "字", "9"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", "", ", ", "\n"]) for _ in range(rng.randint(1, 40)))
        assert toxicity.features(text, toxicity.Weights(lexicon)) == pytest.approx(slow_features(text, lexicon), abs=1e-12), text
    assert toxicity.features(None, toxicity.Weights(lexicon)) == toxicity.features("", toxicity.Weights(lexicon)) == [0.0] * len(toxicity.NAMES)


@pytest.mark.parametrize("text", ["a" * 2_000_000 + " 1", "A" * 2_000_000 + "_1", "a1" * 1_000_000, "1" * 2_000_000 + " a", "字" * 1_000_000 + "1 !"])
def test_long_runs_take_linear_time(text):
    began = time.time()
    toxicity.features(text, toxicity.Weights({"lump": 1.0}))
    assert time.time() - began < 1.5
