from spark_trials.oracles import ORACLE_SQL
from spark_trials.plans import adapters as ad


def test_truth_of_all_replications(spark):
    """Even replications count for the truth as odd ones do, in the code and in the SQL."""
    hits = {(1, 0): 10, (1, 4): 10, (2, 0): 20, (2, 4): 80}
    counts = spark.createDataFrame([("s", r, 0, 0, arm, 100, s) for (r, arm), s in hits.items()], "scenario string, replication long, outcome long, block long, arm long, n long, successes long")
    (row,) = ad.r_truth(counts).collect()
    assert (row["arm"], round(row["true_effect"], 12)) == (4, 0.3)
    assert not any("replication % 2" in ORACLE_SQL[f"q_rep_{q}"] for q in ("policy", "rates", "diagnostics", "gates"))
