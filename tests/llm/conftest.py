import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from prevalens.llm.common import PACKAGE_ROOT
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = PACKAGE_ROOT
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prevalens-llm-test-"))
    yield s


SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, b string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, "en", "s1"), (2, "", None, None), (3, " \n\t ", "en", "s1"), (4, "one", "en", "s2"),
            (5, "a b c d", "fr", None), (6, long, "en", "s1"), (6, long, "en", "s1"), (7, long + " end", "en", "s1"),
            (8, "same text of seven words in all", "en", "s2"), (9, "same text of seven words in all", "en", "s2"),
            (None, "no id here but some words to read", "en", "s2"), (10, "12345 !!! ???", "fr", "s3"),
            (11, "été à la plage où il fait très chaud aujourd'hui", "fr", "s3"),
            (12, "mail me at a.b@c.de or +1 (234) 555-7975", "en", "s3")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
