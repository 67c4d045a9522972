"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``;
nothing runs in Python per row, so the expressions stay inside whole-stage
code generation.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text a pandas numeric parse accepts: optional blanks and sign, decimal or
# scientific notation, or an infinity spelling. Anything else (e.g. "1d",
# "1,000", "0x10") is unparsable and becomes 0.0, as in the original.
NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
# Leading / trailing blanks, Unicode-aware like Python's str.strip().
EDGE_BLANKS = r"(?U)^\s+|\s+$"


def parse_numeric(col: str | Column, data_type: T.DataType | None = None) -> Column:
    """Unparsable, null or NaN -> null, everything else as double."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(data_type, T.StringType):
        text = F.regexp_replace(c, EDGE_BLANKS, "")
        parsed = F.when(c.rlike(NUMERIC_TEXT), text.try_cast(T.DoubleType()))
    else:
        parsed = c.cast(T.DoubleType())
    return F.nanvl(parsed, F.lit(None).cast(T.DoubleType()))


def coerce_numeric(col: str | Column, data_type: T.DataType | None = None) -> Column:
    """Unparsable, null or NaN -> 0.0, everything else as double."""
    return F.coalesce(parse_numeric(col, data_type), F.lit(0.0))


def normalize_plan(col: str | Column, allowed: Iterable[str], default: str) -> Column:
    """null -> default, strip, lower, '' -> default, unknown -> default."""
    c = F.col(col) if isinstance(col, str) else col
    cleaned = F.lower(F.regexp_replace(F.coalesce(c.cast(T.StringType()), F.lit(default)), EDGE_BLANKS, ""))
    return F.when(cleaned.isin(list(allowed)), cleaned).otherwise(F.lit(default))


def lookup(col: str | Column, mapping: Mapping[str, float]) -> Column:
    """Literal map lookup; a key missing from the map gives null."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = []
    for key, value in mapping.items():
        pairs.extend([F.lit(key), F.lit(float(value))])
    return F.try_element_at(F.create_map(*pairs), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of failing on a zero denominator.

    The original divides pandas columns (inf / NaN on zero); with ANSI mode
    Spark would raise, so zero denominators become null here. The contract
    check quarantines the negative inputs that produce them.
    """
    return F.try_divide(numerator, denominator)


def round_half_even(col: Column, decimals: int) -> Column:
    """NumPy-style rounding: half to even on the scaled binary value."""
    scale = float(10**decimals)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def q6(col: str | Column) -> Column:
    """Six-decimal rounding used when a computed double is registered."""
    c = F.col(col) if isinstance(col, str) else col
    return round_half_even(c, 6)


def clip_lower(col: Column, lower: float) -> Column:
    """clip(lower=...) that keeps null / NaN as null."""
    clean = F.nanvl(col, F.lit(None).cast(T.DoubleType()))
    return F.when(clean.isNull(), clean).otherwise(F.greatest(F.lit(float(lower)), clean))
