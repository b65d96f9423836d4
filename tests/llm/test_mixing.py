import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spark_trials.llm.mixing import copies, mix, mix_rows, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Cap and reshare in rounds until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 40}, {"a": 1, "b": 2, "c": 300, "d": 4, "e": 5000}, {"a": 0, "b": 9}):
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = plain_targets(sizes)
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(want)
        assert {r["source"]: r["source_size"] for r in rows} == sizes


def test_mix(docs, docs_rows, clashing):
    made = [r.asDict() for r in mix(docs, fan_in=8).collect()]
    assert len(made) == len(docs_rows)
    assert sorted((r["doc_id"], r["size"]) for r in made if r["doc_id"] is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in docs_rows if i is not None)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in made:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = [r.asDict() for r in mix(clashing, fan_in=8).collect()]
    assert sorted(map(str, again)) == sorted(map(str, made))


def test_each_document_has_fair_odds(spark):
    """Over many draws at once (copies of a small corpus under other source names), every document's mean copies come near its
    ratio: long ones, short ones and the last ones of their classes alike."""
    sizes = [2000, 900, 300, 120, 120, 40, 17, 9, 5, 3, 2, 1, 1, 0]
    draws, names = 600, ("a", "b")
    rows = [(f"{s}{k:04d}", s, d, n) for s in names for k in range(draws) for d, n in enumerate(sizes)]
    sized = spark.createDataFrame(rows, "source string, kind string, row long, size long")
    base = sized.select(F.xxhash64("source").alias("id"), F.lit(7).cast("long").alias("hash"), "row", "size", "source")
    x = {"a": 0.37, "b": 0.81}
    given = base.where("size > 0").withColumns({"base": F.lit(1), "x": F.when(F.col("source") < "b", x["a"]).otherwise(x["b"]), "of_rows": F.lit(13).cast("long")})
    made = copies(given, most_rows=13, fan_in=4, seed=1).groupBy(F.substring("source", 1, 1).alias("kind"), "row").agg(F.avg("copies").alias("m")).collect()
    assert len(made) == 26
    for r in made:
        assert abs(r["m"] - 1 - x[r["kind"]]) <= 4.5 * (x[r["kind"]] * (1 - x[r["kind"]]) / draws) ** 0.5, r


def test_bands_keep_the_odds_and_the_words(spark):
    """Through ``mix``: 300 sources of the same documents, in three bands of sizes."""
    sizes = [1500, 1100, 700, 600, 200, 90, *[40] * 150, 33, 20, *[12] * 12, *[5] * 20, *[1] * 30]
    rows = [(k * 1000 + d, f"s{k:03d}", " ".join(["w"] * n)) for k in range(300) for d, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made = mix(df, weights=(1.0, 0.6), fan_in=8)
    by = made.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.sum("size").alias("n")).collect()
    assert max(abs(r["t"] - r["goal"]) for r in by) <= 250  # of 15,000 words, of which one document has 1500
    ratios = {r["source"]: r["goal"] / r["n"] for r in by}
    assert len({round(x, 9) for x in ratios.values()}) == 2
    for x in set(ratios.values()):
        own = made.where(F.abs(F.col("target") / F.col("source_size") - x) < 1e-9).groupBy(F.expr("doc_id % 1000").alias("d")).agg(F.avg("copies").alias("m")).collect()
        part = x - int(x)
        for r in own:
            assert abs(r["m"] - x) <= 4.5 * (part * (1 - part) / 150) ** 0.5, (r, x)


def test_rows_repeat_as_the_mix_says(docs, clashing):
    made = mix(docs, fan_in=8).groupBy("doc_id").agg(F.sum("copies").alias("c")).where("c > 0").collect()
    out = mix_rows(clashing, fan_in=8)
    assert out.columns == clashing.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["c"] for r in made}


def test_rows_alike_agree_between_runs(spark):
    rows = [(None, f"w{k} x y z", "s", k) for k in range(40)] + [(7, "same text here", "s", 1)] * 90 + [(7, "same text here", "s", 2)] * 9 + [(k, "o n e", "t", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    runs = [sorted((str(r["doc_id"]), r["text"], r["n"]) for r in mix_rows(df.repartition(p), fan_in=8, weights=(2.0, 1.0)).collect()) for p in (2, 9)]
    assert runs[0] == runs[1]
    took = mix(df, fan_in=8, weights=(2.0, 1.0)).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()
    assert sum(r["c"] for r in took if r["doc_id"] == 7) == sum(r[0] == "7" for r in runs[0])


def test_empty(no_docs, spark):
    assert mix(no_docs).count() == 0 and mix_rows(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["taken"], r["target"]) for r in mix(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
