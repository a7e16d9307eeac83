"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 2) -> Column:
    """numpy/pandas-style rounding (half to even); Spark's ``round`` is half-up."""
    return F.bround(col(c), digits)


def row_mean(*cols) -> Column:
    """Null-skipping mean across columns: one present value gives that value, none gives NULL."""
    cs = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return F.try_divide(total, F.nullif(present, F.lit(0)))


def safe_divide(num, den) -> Column:
    """Division that yields NULL on a zero / NULL denominator (ANSI-safe)."""
    return F.try_divide(col(num), F.nullif(col(den), F.lit(0)))


def contains_ci(c, pattern: str) -> Column:
    """Case-insensitive regex "contains"; NULL input gives False."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def slug(c) -> Column:
    """Lower-case, '/' and ' ' to '_' (file-name slug of a label)."""
    return F.translate(F.lower(col(c)), "/ ", "__")


def percent_text(c, digits: int = 1) -> Column:
    """0.6778 -> '67.8%'."""
    return F.concat(F.format_number(F.bround(col(c) * 100, digits), digits), F.lit("%"))


def plus_minus_text(c, digits: int = 1) -> Column:
    """0.0428 -> '±4.3%'."""
    return F.concat(F.lit("±"), percent_text(c, digits))


def significance_stars(p) -> Column:
    """p < .001 '***', < .01 '**', < .05 '*', else ''."""
    p = col(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**")
            .when(p < 0.05, "*").otherwise(""))


def vif_band(v) -> Column:
    """VIF > 10 problem, > 5 warning, else ok."""
    v = col(v)
    return F.when(v > 10, "problem").when(v > 5, "warning").otherwise("ok")


def map_values(c, mapping: dict, default=None) -> Column:
    """Dictionary lookup as a literal map (no join, no UDF)."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    out = m[col(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def lin_space(lo, hi, num: int) -> Column:
    """Array of ``num`` evenly spaced values from lo to hi inclusive."""
    lo, hi = col(lo), col(hi)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: lo + (hi - lo) * i / F.lit(num - 1))
