"""Column expressions used by the scoring methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lev_sim(a, b, distance: Column | None = None) -> Column:
    """``1 - distance / longer length`` over code points; two empty texts give 1."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b) if distance is None else distance
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - d.cast("double") / longer)


def weighted_mean(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of score times weight over the sum of weights, 0 when that sum is 0."""
    total = sum(float(w) for w in weights)
    if not total > 0:
        return F.lit(0.0)
    parts = [s * F.lit(float(w)) for s, w in zip(scores, weights)]
    return reduce(lambda x, y: x + y, parts) / F.lit(total)


def clip_nonneg(col) -> Column:
    return F.greatest(_c(col), F.lit(0.0))


def abs_diff(a, b) -> Column:
    return F.abs(_c(a).cast("double") - _c(b).cast("double"))


def words(text) -> Column:
    """Lower-cased tokens between blanks, without empty ones."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda t: t != "")


# Date layouts tried in turn.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
    "MM/dd/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
)

_DAY = 86_400_000_000


def parse_date(text, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First layout that fits, as a time stamp without zone; null if none does."""
    text = F.trim(_c(text))
    tries = [
        F.try_to_timestamp(text, F.lit(f)) if "H" in f else F.try_to_date(text, f) for f in formats
    ]
    return F.coalesce(*[t.cast("timestamp_ntz") for t in tries])


def micros(ts) -> Column:
    """Microseconds since 1970 of a date or time stamp, free of time zones."""
    return F.timestamp_diff(
        "MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), _c(ts).cast("timestamp_ntz")
    )


def days_between(first, second) -> Column:
    """Absolute value of the floored day difference of two microsecond columns.

    ``first`` is the earlier record in pair order: with times of day the floor
    makes the two orders differ.
    """
    diff = _c(first) - _c(second)
    return F.abs((diff - F.pmod(diff, F.lit(_DAY))) / F.lit(_DAY))
