"""Incremental clean step over a stream of survey files.

The clean step is a two-level aggregation (state pivot, then weighted national
roll-up), which Structured Streaming cannot chain as stateful operators on a
non-time key.  ``foreachBatch`` therefore keeps the received rows as a table,
partitioned by batch and period, and recomputes the national tables of every
period that the batch touches from all rows received for that period.  A period
split over several files, or a late file, adds to what is there.  Both writes
overwrite their own partitions only, so a batch replayed after a failure
rewrites the same ones, and the checkpoint location gives exactly-once
progress over the source files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import SurveySpec
from ..plans import clean


def _write_period_tables(batch: DataFrame, epoch: int, spec: SurveySpec, sink_dir: str,
                         min_sample: float | None) -> None:
    rows_dir = os.path.join(sink_dir, "_rows")
    (batch.withColumn("_batch", F.lit(epoch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("_batch", spec.year).parquet(rows_dir))
    schema = StructType([*batch.schema.fields, StructField("_batch", LongType())])
    received = batch.sparkSession.read.schema(schema).parquet(rows_dir)
    # the periods of one batch: a handful of values, used to prune the received rows
    touched = [r[0] for r in received.where(F.col("_batch") == epoch).select(spec.year).distinct().collect()]
    rows = received.where(F.col(spec.year).isin(touched)).drop("_batch").select(*batch.columns)
    tables = clean.clean_tables(rows, spec, min_sample=min_sample, validate=False)
    for name in ("outcome_national", "driver_national", "habit_national"):
        (tables[name].write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(spec.year)
         .parquet(os.path.join(sink_dir, name)))


def national_stream(spark: SparkSession, source_dir: str, schema: StructType, spec: SurveySpec,
                    sink_dir: str, checkpoint_location: str, *, min_sample: float | None = None,
                    files_per_trigger: int = 1, available_now: bool = True):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``source_dir`` receives parquet files of the long survey table; a period may
    come in several files.  With ``available_now`` the query processes what is
    there and stops (batch-style backfill); otherwise it keeps polling.
    """
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: _write_period_tables(df, epoch, spec, sink_dir, min_sample))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
