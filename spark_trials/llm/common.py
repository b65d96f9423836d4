"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
_shipped: set[str] = set()


#: Rows of a batch that goes to Python, where the session has Spark's own 10,000: texts can be long. Spark bounds the bytes
#: of a batch by itself. The setting stays as it is made here; a session that has its own keeps it.
BATCH_ROWS = 1000
_OWN_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application (as ``--py-files`` would), and bound what a batch holds."""
    if spark.conf.get(_OWN_ROWS) == "10000":
        spark.conf.set(_OWN_ROWS, BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "spark_trials_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A cluster must name one, since executors cannot share a folder of the driver's
    machine; a session that is one machine alone (``local``), as in tests, gets one of its own where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the folder that the cluster shares and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of so many narrow rows, tens of MB, is sent to all executors.
SENT_ROWS = 1_000_000


def sent_if_small(written: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A checkpointed table as a side of a join: sent to all executors if it has at most ``rows`` rows, else left to a shuffle.
    The result is the same; what is saved is the shuffle of the texts on the other side."""
    return F.broadcast(written) if written.count() <= rows else written


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column of the input has, whatever its extra columns are called."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
