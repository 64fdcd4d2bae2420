import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

EXTRA = ("did", "rid", "row", "key", "dig", "spans", "norm", "keep", "n", "component", "score", "f0", "node", "bucket", "batch", "part", "digs", "x", "gen", "v", "hit")


@pytest.fixture(scope="session")
def docs_rows(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, one id with two texts, and columns of every internal name."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "some text of its own"), (1, None), (2, ""), (3, " \n\t "), (4, passage), (4, passage), (4, "another " + passage), (5, passage + " tail"), (6, "long " * 60000), (7, "ß" * 5000), (8, None), (9, "x\n" + passage + "\n\n")]
    extra = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(d, t, None, None, None, *["z"] * len(EXTRA)) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
