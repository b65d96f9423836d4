import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from spark_trials.llm import spelling as sp
from spark_trials.llm.queries import ORACLE_SQL

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def counts(rows, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(rows, every=199):
    n = counts(rows, every)
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out)


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind != 2) :]


def made(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, words, letters="abcéÿ", docs=80):
    """Texts over a vocabulary with chains of variants, of steeply falling counts."""
    rng = random.Random(seed)
    vocabulary = []
    for _ in range(words):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 11)))
        for times in (600, 90, 14, 5):
            vocabulary += [w] * rng.choice([times, times // 3])
            w = edited(rng, w, letters)
    rng.shuffle(vocabulary)
    cut = len(vocabulary) // docs + 1
    return [(k, "  ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in vocabulary[k * cut : (k + 1) * cut])) for k in range(docs)]


def test_index_against_pairs():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(300)})
    codes, lengths = sp.letter_codes(words)
    index = sp.PositionIndex(codes, lengths)
    for n in range(6, 10):
        rows = np.flatnonzero(lengths == n)
        for kinds in (dict(shorter=True, longer=True, equal=True), dict(shorter=True, longer=False, equal=False), dict(shorter=False, longer=True, equal=True)):
            q, j = sp._ones(index.near(codes[rows, :n], **kinds))
            allowed = {n - 1: kinds["shorter"], n: kinds["equal"], n + 1: kinds["longer"]}
            want = {(r, k) for r in rows for k in range(len(words)) if near(words[r], words[k]) and allowed[len(words[k])]}
            assert {(int(rows[a]), int(b)) for a, b in zip(q, j, strict=True)} == want and len(q) == len(want)


def test_against_brute_force(spark):
    rows = [*corpus(1, 60), (None, "Anyone anyone ANYONE anyone anyone"), (900, None), (901, ""), (902, "a b ×÷×÷×÷ " * 6)]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1]) and max(r[4] for r in want) > 2
    assert made(sp.variants(df)) == want
    assert made(sp.variants(df, every=3)) == brute(rows, 3)


def test_parts_of_large_groups(spark, monkeypatch):
    """With blocks of three words nearly all groups are dealt to parts."""
    rows = corpus(2, 60, "ab")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert made(sp.variants(df)) == want
    monkeypatch.setattr(sp, "BLOCK", 3)
    monkeypatch.setattr(sp, "HELD_LETTERS", 200)
    seen = {r["role"] for r in sp.dealt(sp.word_counts(df).where("n >= 5")).collect()}
    assert seen == {sp.GATHERED, sp.HELD, sp.ASKED}
    # tasks have the module's own block size: the parts and roles are what differs
    assert made(sp.variants(df)) == want


def test_visits_gather_and_part(monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 3)
    rows = [(6, 0, "aaa", 0, sp.GATHERED, "aaab" + c * 2, 5) for c in "xy"] + [(6, 0, "bbb", 0, sp.GATHERED, "bbbbbb", 5)] + [(6, 0, "ccc", 0, sp.GATHERED, "cccccc", 7)]
    rows += [(6, 1, "ccc", 0, sp.HELD, "xxxccc", 5)] + [(6, 1, "ccc", 0, sp.ASKED, c * 3 + "ccc", 5) for c in "abcd"] + [(7, 0, "aaa", 0, sp.GATHERED, "aaaaaaa", 5)]
    got = [(len(asked.words), len(block.words)) for asked, block in sp.visits(iter(rows)) if block.words]
    assert sorted(got) == sorted([(3, 3), (3, 1), (1, 1), (1, 1), (1, 1)])


def test_long_words_and_texts(spark):
    long = "ab" * 10_000
    rows = [(k, f"{long} {long[:-1]}c {long}x filler" + " prose" * 50_000) for k in range(6)] + [(10 + k, f"{long} " * 6) for k in range(8)]
    want = brute(rows, 10**12)
    assert made(sp.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=10**12)) == want
    assert [r[4] for r in want if len(r[0]) > 100] == [2, 1, 1]


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SAMPLE}'")
    assert made(sp.variants(spark.read.parquet(SAMPLE))) == sorted(con.execute(ORACLE_SQL["op11_spelling"]).fetchall())


def test_defined_results(docs, docs_rows, clashing, no_docs):
    want = brute([(r[0], r[1]) for r in docs_rows])
    assert made(sp.variants(docs)) == want == made(sp.variants(clashing))
    assert sp.variants(no_docs).count() == 0
