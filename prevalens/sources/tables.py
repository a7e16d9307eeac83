"""Parquet / CSV table I/O (scan, sink, report files)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet scan of ``<base_dir>/<name>.parquet``; pruning and pushdown are Catalyst's."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def nan_as_null(df: DataFrame, columns: list | None = None) -> DataFrame:
    """NaN in floating columns becomes NULL, as missing values are in a survey file."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    chosen = floating & set(columns) if columns is not None else floating
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan")).cast(df.schema[c].dataType))
                           for c in df.columns if c in chosen})


def read_tables(spark: SparkSession, base_dir: str, names) -> dict:
    """Scan several parquet tables of one folder (e.g. the national tables)."""
    return {n: nan_as_null(read_table(spark, base_dir, n)) for n in names}


def write_table(df: DataFrame, base_dir: str, name: str, *,
                partition_by: list | None = None) -> str:
    """Overwrite ``<base_dir>/<name>.parquet``; optional partition columns."""
    path = os.path.join(base_dir, f"{name}.parquet")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_tables(tables: dict, base_dir: str, *, partition_by: dict | None = None) -> dict:
    """Write each named DataFrame; returns name -> path."""
    partition_by = partition_by or {}
    return {n: write_table(df, base_dir, n, partition_by=partition_by.get(n))
            for n, df in tables.items()}


def write_report_csv(df: DataFrame, path: str) -> str:
    """Report sink: CSV with a header and no index column (keys are columns already)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a saved report back with an explicit schema (never inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path)
