"""Field cleaning expressions: trimming, empty -> null, decimal-comma money, compact dates.

All are built-in expressions (no UDF), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.keys import _col


def blank_to_null(c) -> Column:
    """Trimmed text, or null when nothing is left."""
    t = F.trim(_col(c))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def parse_money(c, precision: int = 18, scale: int = 2, thousands: str = ".",
                decimal: str = ",") -> Column:
    """``'1.234,50'`` -> ``1234.50`` as ``decimal(precision, scale)``; bad text -> null."""
    t = blank_to_null(c)
    if thousands:
        t = F.replace(t, F.lit(thousands), F.lit(""))
    if decimal != ".":
        t = F.replace(t, F.lit(decimal), F.lit("."))
    return t.try_cast(f"decimal({precision},{scale})")


def parse_compact_date(c, fmt: str = "yyyyMMdd") -> Column:
    """``'20240131'`` -> date; ``'0'``, empty or malformed -> null (never raises)."""
    return F.try_to_date(blank_to_null(c), fmt)


def format_money(c, decimals: int = 2) -> Column:
    """Number -> ``'1.234,50'`` (the registry's decimal-comma rendering)."""
    us = F.format_number(_col(c), decimals)  # '1,234.50'
    return F.translate(us, ",.", ".,")


def format_compact_date(c, fmt: str = "yyyyMMdd") -> Column:
    """Date or timestamp -> ``'20240131'``; taken as a date first, so a wall-clock
    (``timestamp_ntz``) value never passes through the session time zone."""
    return F.date_format(F.to_date(_col(c)), fmt)


def clean_columns(df: DataFrame, text: list[str] = (), money: list[str] = (),
                  dates: list[str] = (), money_scale: int = 2) -> DataFrame:
    """Apply the cleaning rules to the named columns in one projection."""
    exprs = []
    for name in df.columns:
        if name in money:
            exprs.append(parse_money(name, scale=money_scale).alias(name))
        elif name in dates:
            exprs.append(parse_compact_date(name).alias(name))
        elif name in text:
            exprs.append(blank_to_null(name).alias(name))
        else:
            exprs.append(F.col(name))
    return df.select(*exprs)
