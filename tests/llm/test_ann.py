import os
import random

import numpy as np
import pytest

from spark_trials.llm import ann

GIVEN = "/root/testdata/sf0.1/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<float>, shard int, key string"


def exact(rows, every=100, k=10):
    good = list({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), j) for j, w in good if (j, w) != (i, v))
            out.setdefault(i, []).append(scored[:k])
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(1500)]
    rows += [(2000 + k, x[k].tolist()) for k in range(5)] + [(200, x[200].tolist())]  # ties, and a repeated row
    bad = [float("nan")] + [1.0] * 15
    rows += [(3000, None), (3100, [0.0] * 16), (3200, bad), (3300, [None] + [1.0] * 15), (3400, [float("inf")] * 16), (None, [1.0] * 16), (3500, [1.0] * 4)]
    return rows


def test_recall_and_scores(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], SCHEMA).repartition(6)
    got = ann.nearest(df, shard_rows=400).collect()
    want = exact(vectors)
    assert {r["query_id"] for r in got} == set(want)
    hits = 0
    for q, sets in want.items():
        own = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        hits += len({i for _, _, i in own} & {i for _, i in sets[0]})
        by_id = {i: s for s, i in sorted(exact(vectors, k=10**6)[q][0])}
        assert all(by_id[i] == pytest.approx(s, abs=1e-12) for _, s, i in own)
    assert hits >= 0.9 * 10 * len(want)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 7), (0, 2, 5)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id > 0")).count() == 0


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 2, 3, 5, 9, 16, 31):
        q = codes[random.Random(radius).randrange(500)] ^ np.uint8(5)
        want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
        assert index.within(q, radius).tolist() == want.tolist()


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given table is not here")
def test_recall_on_the_given_table(spark):
    df = spark.read.parquet(GIVEN)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q in got:
        score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        score[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, score))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(got)
