"""Small helpers shared by the operators: scans, saved intermediates, word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Word separators of every contract: space, tab, newline, vertical tab, form feed, return.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark removes the shuffle files of a query when the query has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; the path may be on any store that Spark can read."""
    # Python workers of a local run find this package where the driver found it
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only on a local master."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="prevalens-llm-")
        sc.setCheckpointDir(named)
    return named


@contextmanager
def settings(spark: SparkSession, named: dict):
    """Session settings of the queries that are made inside."""
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def saved(df: DataFrame, name: str, by: list | None = None, codec: str | None = None,
          batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by some columns if named, and read it back.

    Later reads survive lost executors and never run the upstream plan again, so the
    shuffle files of the write are removed as soon as it has ended.
    Every call gets a folder of its own, so two runs never meet.  ``batch`` bounds the rows of
    an Arrow batch for this write: a task holds a batch of texts several times over, on both sides.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    with freed(spark), text_batches(spark, batch):
        df.write.parquet(path, partitionBy=by, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int | None = TEXT_ROWS):
    """Queries made inside, which must also end inside, have Arrow batches of at most ``rows`` rows."""
    limit = int(spark.conf.get(_BATCH_ROWS))
    return settings(spark, {_BATCH_ROWS: str(rows)} if rows and not 0 < limit <= rows else {})


def freed(spark: SparkSession):
    """Queries made inside, which must also end inside, leave no shuffle files."""
    return settings(spark, {_FREED: "true"})


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside a row expression."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    """Words of a text: runs of anything but the separators; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: words start where a separator run ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
