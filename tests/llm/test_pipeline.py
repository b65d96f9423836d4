import random

import pytest
from llm_samples import prose
from pyspark.sql import functions as F

import corpus_pipeline
from spark_trials.llm import queries


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    passage = prose(rng, 70)
    more = [(1000 + k, prose(rng, 60) + (" grobian" if k % 4 == 0 else ""), "en", "a", 1) for k in range(240)]
    more += [(2000 + k, f"{prose(rng, 80)} {passage} {prose(rng, 80)}", "de", "b", 1) for k in range(5)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1000 + k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, passage


def test_stages_one_by_one(spark, folder):
    sf_dir, passage = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    toxic = {1000 + k for k in range(0, 240, 4)}
    assert len(ids["toxicity"] & toxic) <= 0.05 * len(toxic) and {1000 + k for k in range(240)} - toxic <= ids["toxicity"]
    assert not {60 + k for k in range(8)} & ids["simhash_near_dedup"] and {k for k in range(20)} <= ids["simhash_near_dedup"]
    middle = " ".join(passage.split()[25:-25])
    assert seen["simhash_near_dedup"].where(F.col("text").contains(middle)).count() == 5
    assert seen["substring_dedup"].where(F.col("text").contains(middle)).count() == 1
    assert seen["substring_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = seen["best_fit_packing"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n <> e or n > 2048").count() == 0
    assert pieces.where("piece = 0").count() == seen["mixing"].count() and ids["best_fit_packing"] == ids["mixing"]


def test_rows_without_ids_or_with_one_id(spark, folder):
    """50 texts without an id, 50 under one id, copies of both, and columns whose names the stages use themselves."""
    rng = random.Random(31)
    lone, shared = [prose(rng, 60) for _ in range(50)], [prose(rng, 60) for _ in range(50)]
    rows = [(None, t, "en", "a", 1) for t in lone + lone[:9]] + [(7, t, "en", None, 1) for t in shared + shared[:9]]
    rows += [(None, None, None, None, None), (8, "", "en", "b", 0), (8, " ", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("row", "features", "score", "fp", "n_removed", "__cuts", "hash", "size", "copies", "times", "stays", "h1")
    docs = docs.withColumns({c: F.lit("x") for c in clash}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, folder[0])
    assert kept.columns == docs.columns and kept.count() == len(rows)
    kept = stages["simhash_near_dedup"](spark, docs, folder[0])
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(t for i, t in found if t and i is None) == sorted(lone) and sorted(t for i, t in found if i == 7) == sorted(shared)
    assert sum(not (t or "").strip() for _, t in found) == 1
    cut = stages["substring_dedup"](spark, docs, folder[0])
    assert cut.columns == docs.columns and cut.count() == len(rows) and {r["n_removed"] for r in cut.collect()} == {"x"}
    taken = stages["mixing"](spark, docs, folder[0])
    assert taken.columns == docs.columns and taken.count() > 0
    assert stages["best_fit_packing"](spark, docs, folder[0]).where("piece = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name


def test_run_and_registration(spark, folder):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert known["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{k}_") for n in known) for k in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE_SQL) <= set(known)
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_url_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "https://www.Example.org/es/a?x"), (2, None), (3, "a.com/de/"), (4, "x://m.a.com/de/1#z"), (5, "x://b.com/fr"), (6, "y://example.org/en/12"), (7, "é://org/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_url_filter"]).fetchall()
    assert sorted(tuple(r) for r in queries.op1_url_filter(spark, str(tmp_path)).collect()) == sorted(want)
