import hashlib
import math

import duckdb
import numpy as np
import pytest

from spark_trials.llm import vector_codes as vc
from spark_trials.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, label int"
SAMPLE = "/root/testdata/sf0.001/embeddings.parquet"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain lists and loops over (id, vector, label)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    width = len(kept[0][1]) // parts
    cut = lambda w, p: w[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda w, p: min((gap(cut(w, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = {}
        for r in kept:
            for p in range(parts):
                own.setdefault((p, near(r[1], p)[1]), []).append(cut(r[1], p))
        for (p, k), members in own.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(r[0], r[2], [near(r[1], p) for p in range(parts)]) for r in kept]
    totals = {}
    for _, label, found in coded:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), totals[label], digest) for i, label, found in coded), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_orchard_finds_the_nearest_with_ties():
    rng = np.random.default_rng(5)
    for entries, spread in ((1, 2), (2, 2), (7, 1), (64, 2), (64, 500), (130, 9), (256, 40)):
        for _ in range(8):
            x = rng.integers(-spread, spread + 1, (300, rng.integers(1, 5)))
            book = x[:entries].copy()
            gaps = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            best, away, took = vc.Orchard(book).nearest(x)
            assert (best == gaps.argmin(axis=1)).all() and (away == gaps.min(axis=1)).all() and took <= gaps.size
    x = rng.integers(-1000, 1000, (4000, 4))
    assert vc.Orchard(x[:64].copy()).nearest(x)[2] < 0.6 * 4000 * 64  # the lists are left early


def test_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.float32(rng.standard_normal(32))], int(k % 5) if k % 7 else None) for k in range(150)]
    rows += [(10, rows[3][1], 1), (10, rows[3][1], 1), (None, rows[4][1], None)]  # ids that repeat and lack
    rows += [(200, None, 1), (201, [*rows[0][1][:31], None], 1), (202, [*rows[0][1][:31], float("nan")], 1), (203, [*rows[0][1][:31], float("inf")], 1), (204, [0.0] * 32, 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert plain(vc.compress(df)) == want
    from pyspark.sql import functions as F

    clashing = df.withColumns({c: F.lit("x") for c in ("id", "vector", "code", "error", "of", "label_error", "part", "entry", "n")})
    assert plain(vc.compress(clashing, sent=1)) == want


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SAMPLE}'")
    made = vc.compress(spark.read.parquet(SAMPLE)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert plain(made) == sorted(con.execute(ORACLE_SQL["op12_vector_codes"]).fetchall(), key=repr)


def test_odd_vectors_stay_without_code(spark):
    rows = [(k, [float(k + c) for c in range(16)], 0) for k in range(5)] + [(90, [1.0] * 8, 0), (91, [1e9] * 16, 0), (92, [], 3)]
    made = {r["vec_id"]: r for r in vc.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(made) == 8 and all(made[k]["code"] is None and made[k]["error"] is None for k in (90, 91, 92))
    assert [made[k]["error"] for k in range(5)] == [0] * 5 and made[92]["label_error"] is None and made[90]["label_error"] == 0
    lone = vc.compress(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).first()
    assert lone["code"] is None and lone["codebooks_sha256"] == hashlib.sha256(b"").hexdigest()
    assert vc.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], SCHEMA), entries=300)
