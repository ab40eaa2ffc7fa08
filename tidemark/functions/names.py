"""Column rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    """Trimmed, lower-cased name; null where the value is null or blank."""
    v = F.lower(F.trim(c))
    return F.when(v != "", v)


def finite(c: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))
