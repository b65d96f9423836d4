import random

import numpy as np
import xxhash

from spark_trials.llm import simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, ids, distance=4):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                up[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(top(k), []).append(k)
    return {k: min((ids[m] for m in g if ids[m] is not None), default=None) for g in groups.values() for k in g}


def test_fingerprints_and_classes(docs, docs_rows, clashing):
    fps = [plain(r[1]) for r in docs_rows]
    named = classes(fps, [r[0] for r in docs_rows])
    want = sorted(((r[0], fps[k], named[k]) for k, r in enumerate(docs_rows)), key=str)
    for df in (docs, clashing):
        got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()]
        assert sorted(got, key=str) == want


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("ÄBcd\u00a0e") for _ in range(4)) for _ in range(70_000))
    assert simhash.fingerprint(text) == plain(text)


def test_links_of_hard_fingerprints(spark):
    """Chains, a dense cell that is cut into blocks, and strangers: the classes are those of all pairs."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        nxt = chain[-1]
        for b in rng.sample(range(64), 4):
            nxt ^= 1 << b
        chain.append(nxt)
    centre = rng.getrandbits(64)
    dense = list({centre ^ sum(1 << b for b in rng.sample(range(6), rng.randint(0, 6))) ^ (1 << rng.randint(6, 63)) for _ in range(300)})
    fps = list(dict.fromkeys(fps + chain + dense))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell_rows=16).distinct().collect()
    place = {f: k for k, f in enumerate(signed)}
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) % (1 << 64)).count("1") <= 4
        x, y = top(place[a]), top(place[b])
        up[max(x, y)] = min(x, y)
    want = classes(fps, list(range(len(fps))))
    assert {k: top(k) for k in range(len(fps))} == want
    x = np.array(fps, np.uint64)
    bound = np.bitwise_count(simhash.unary(x)[:, None] ^ simhash.unary(x)[None])
    assert (bound <= np.bitwise_count(x[:, None] ^ x[None])).all()


def test_components(spark):
    from spark_trials.llm.components import components

    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, clashing, no_docs):
    made = simhash.near_duplicates(docs)
    want = sorted({r["component_id"] for r in made.collect()}, key=str)
    out = simhash.one_of_each(clashing)
    assert out.columns == clashing.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == want
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_with_missing_and_shared_ids(spark):
    """Different texts without ids, or under one id, are classes of their own and all stay; their copies go."""
    from llm_samples import prose

    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(30)]
    rows = [(None, t, "a") for t in texts[:20]] + [(7, t, "a") for t in texts[20:]]
    rows += [(None, texts[0], "b")] * 5 + [(900, texts[1], "a"), (7, texts[25], "a"), (8, texts[26], "a"), (None, texts[27], "a")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)).collect()
    want = [(900 if k == 1 else None if k < 20 else 7, t) for k, t in enumerate(texts)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
