import random

import pytest
from llm_samples import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_rows():
    """Prose with copies, near copies, nulls, empty and blank texts, a very long text and repeated rows."""
    rng = random.Random(7)
    rows = []
    for k in range(60):
        rows.append((k, prose(rng, rng.randint(3, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 5))
    rows += [(60 + k, rows[k][1], "en", "a", 5) for k in range(8)]  # exact copies
    rows += [(70 + k, rows[20 + k][1] + " zz", "en", "b", 5) for k in range(8)]  # near copies
    rows += [(80, None, "en", "a", 0), (81, "", "en", "b", 0), (82, " \n\t ", None, None, 0), (None, "no id here at all", "en", None, 1)]
    rows += [(83, prose(rng, 9000), "en", "a", 1), (84, "single", "en", "c", 1), (84, "single", "en", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns whose names the operators use themselves."""
    extra = ("id", "row", "size", "fp", "bucket", "span", "component_id", "features", "score", "copies", "__i", "__copies", "n", "text_hash", "rank", "length")
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in extra})
