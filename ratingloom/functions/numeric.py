"""Small numeric and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 9


def score(col: Column) -> Column:
    """Quantise to 9 digits before ranking: double sums depend on row order in their last
    bits, and an unrounded near-tie would make the chosen top k differ between runs.

    Plain arithmetic instead of round(), which goes through BigDecimal for every row.
    """
    unit = F.lit(float(10 ** SCORE_DIGITS))
    return F.floor(col * unit + F.lit(0.5)) / unit


def seeded_key(seed: int, *cols: Column | str) -> Column:
    """Engine-neutral pseudo-random key of a row: md5 of seed and the row's identity."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def key_to_long(key: Column) -> Column:
    """First 60 bits of a hex key as a non-negative bigint."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when whole is 0 or missing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def whole_days(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86400))


def shown(col: Column | str, digits: int = 6) -> Column:
    """Rounded for output; the nudge keeps a sum's last bits from deciding an exact half-way case."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(1e-10), digits)
