"""Session construction and lineage helpers.

The engine never assumes a local machine: checkpoints go to the folder the
cluster names in ``spark.checkpoint.dir``.  Only when that is unset (tests,
local runs) do we create one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that hold from local[8] up to a large cluster: AQE re-plans joins
# and coalesces/splits partitions from runtime statistics, so the static
# shuffle partition count is only a starting point.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "prevalens", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's, else one made for this run."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or sc.getConf().get("spark.checkpoint.dir", None))
    if not configured:
        # Unset only in tests / local runs: a private scratch folder is fine there.
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="prevalens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table, next to the checkpoints.

    Every call gives another folder, so a result stays readable after later calls.
    """
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def package_for_workers(spark: SparkSession) -> None:
    """Python workers of a local run find this package where the driver found it, whatever their folder."""
    spark.sparkContext.environment.setdefault(
        "PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss).

    Used for small, re-read intermediate tables that feed iterative fits, so a
    lost executor or a repeated job never recomputes the raw-table joins.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
