import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spark_trials.operators import contracts as con
from spark_trials.operators.contracts import ContractError


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    con.require_exact_columns(df, ["b", "a"])
    for columns in (["a"], ["a", "b", "c"]):
        with pytest.raises(ContractError):
            con.require_exact_columns(df, columns)
    with pytest.raises(ContractError):
        con.require_unique_columns(df.select("a", F.col("b").alias("a")))


def test_time_forms(spark):
    forms = {
        "2026-01-01T02:00:00+02:00": "ok", "2026-01-01T01:00Z": "ok", "2026-01-01T01:00:00.25Z": "ok", "2026-01-01T02:00+0200": "ok", "2026-01-01T02:00:00": "naive", "2026-01-01": "naive",
        "9999-01-01T00:00:00Z": "invalid", "soon": "invalid", None: "invalid", "1500-01-01T00:00:00Z": "invalid", "2026-13-01T00:00:00Z": "invalid",
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    instant, state = con.instant_states(df, "t")
    rows = df.select("t", state.alias("s"), F.unix_micros(instant).alias("i")).collect()
    assert {r["t"]: r["s"] for r in rows} == forms
    assert next(r["i"] for r in rows if r["t"] == "2026-01-01T02:00:00+02:00") == 1767225600000000
    with pytest.raises(ContractError, match="2 values without a timezone"):
        con.parse_instants(df, "t")
    naive = spark.sql("select timestamp_ntz '2026-01-01' as t")
    with pytest.raises(ContractError, match="1 values without a timezone"):
        con.parse_instants(naive, "t")
    assert con.parse_instants(spark.sql("select timestamp '2026-01-01' as t"), "t").count() == 1
    with pytest.raises(ContractError):
        con.instant_literal("2026-01-01T00:00:00")
    assert spark.range(1).select(F.unix_micros(con.instant_literal("2026-01-01T00:00:00Z"))).first()[0] == 1767225600000000


def test_keys_count_all_rows_of_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", None), ("c", float("nan")), ("d", 2.0)], "k string, v double")
    assert {r["rule"]: r["violations"] for r in con.key_violations(df, ["k", "v"]).collect()} == {"missing_key": 2, "duplicate_key": 3}
    with pytest.raises(ContractError) as e:
        con.validate_unique_key(df, ["k"])
    assert "3" in str(e.value) and "a" not in str(e.value).split(":")[-1]
    con.validate_unique_key(df.where("k = 'd'"), ["k"])


def test_binary(spark):
    df = spark.createDataFrame([(0.0, True), (1.0, False), (None, None)], "x double, b boolean")
    assert [r["x"] for r in con.as_binary(df, "x", allow_missing=True).coalesce(1).collect()] == [0, 1, None]
    assert [r["b"] for r in con.as_binary(df, "b", allow_missing=True).coalesce(1).collect()] == [1, 0, None]
    with pytest.raises(ContractError):
        con.as_binary(df, "x")
    with pytest.raises(ContractError):
        con.as_binary(spark.createDataFrame([(2,)], "x int"), "x")


def test_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    for require, says in (("both", "unmatched_(left|right): 1"), ("left", "unmatched_left: 1"), ("right", "unmatched_right: 1")):
        with pytest.raises((PySparkException, Py4JJavaError), match=says):
            con.one_to_one_join(left, right, ["k"], require_match=require)[0].collect()
    for how, n in (("inner", 1), ("left", 2), ("right", 2), ("outer", 3)):
        rows, counts = con.one_to_one_join(left, right, ["k"], how=how, require_match="none")
        assert rows.columns == ["k", "v_left", "v_right"] and len(rows.collect()) == n and counts.get == {"left_unmatched": 1, "right_unmatched": 1}
    gone = right.union(spark.createDataFrame([(None, "z")], right.schema))
    for a, b, says in ((left.union(left), right, "left table breaks its contract: duplicate_key: 2"), (left, gone, "right table breaks its contract: missing k")):
        with pytest.raises((PySparkException, Py4JJavaError), match=says):
            con.one_to_one_join(a, b, ["k"], require_match="none")[0].collect()


def test_orphans_and_exposures(spark):
    events, known = spark.createDataFrame([("a",), ("z",)], "id string"), spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ContractError, match="1 rows"):
        con.without_orphans(events, known, "id")
    assert con.without_orphans(events, known, "id", fail=False).count() == 1
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.5,), (float("inf"),), (None,)], "x double")
    assert [r["violations"] for r in con.count_rules(df, con.exposure_rules(df, "x")).orderBy("rule").collect()] == [1, 2, 1]
