"""Raw survey CSV scan with pandas-compatible missing-value handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: tokens a pandas CSV read treats as missing by default ---
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")
# --- end of fixed values ---------------------------------------------------

# Typed survey columns; every other header column is read as a string.
SURVEY_TYPES = {
    "YearStart": T.IntegerType(),
    "Data_Value": T.DoubleType(),
    "Sample_Size": T.DoubleType(),
}


def read_survey_csv(spark: SparkSession, path: str, columns: list,
                    types: dict | None = None, *, multi_line: bool = False) -> DataFrame:
    """Scan a raw survey CSV by header name.

    All columns are read as strings (an explicit schema, no inference pass
    over the file); missing tokens become NULL, then the typed columns are
    converted with ``try_cast`` so a stray token never fails the job.
    ``columns`` is the header list (it fixes the scan schema).  A file is split
    among tasks unless ``multi_line`` is set (needed only where a quoted field
    holds a line break: then a file is one task).
    """
    types = SURVEY_TYPES if types is None else types
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = (spark.read.schema(schema)
           .option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).option("enforceSchema", False)
           .csv(path))
    out = []
    for c in columns:
        col = F.col(f"`{c}`")
        cleaned = F.when(F.trim(col).isin(*NA_TOKENS) | col.isNull(), F.lit(None)).otherwise(col)
        if c in types:
            cleaned = cleaned.try_cast(types[c])
        out.append(cleaned.alias(c))
    return raw.select(*out)


def write_survey_csv(df: DataFrame, path: str) -> str:
    """Write a long survey table as a headered CSV (nulls as empty fields)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
