"""Metaphone code (Philips 1990) as one chain of pattern replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules in order. Letters still to be coded are lower
# case and finished codes are upper case, so no rule sees the output of another.
RULES = (
    (r"[^a-z]", ""),
    (r"gg+", "K"),
    (r"([abd-z])\1+", "$1"),
    (r"^(?:k(?=n)|g(?=n)|p(?=n)|a(?=e)|w(?=r))", ""),
    (r"^x", "S"),
    (r"^wh", "w"),
    (r"mb$", "m"),
    (r"t(?=ch)", ""),
    (r"sch", "SK"),
    (r"sh|s(?=i[oa])", "X"),
    (r"ch|c(?=ia)", "X"),
    (r"sc(?=[iey])|c(?=[iey])", "S"),
    (r"ck|c", "K"),
    (r"dg(?=[eiy])", "J"),
    (r"gh(?![aeiou]|$)", ""),
    (r"g(?=n$|ned$)", ""),
    (r"gh", "K"),
    (r"g(?=[iey])", "J"),
    (r"g", "K"),
    (r"d", "T"),
    (r"ph", "F"),
    (r"th", "0"),
    (r"t(?=i[ao])", "X"),
    (r"t", "T"),
    (r"(?<=[aeiou])h(?![aeiou])", ""),
    (r"h", "H"),
    (r"[wy](?![aeiou])", ""),
    (r"x", "KS"),
    (r"q", "K"),
    (r"v", "F"),
    (r"[sz]", "S"),
    (r"(?<!^)[aeiou]", ""),
)


def metaphone(text) -> Column:
    """Phonetic code, blind to case; anything but the letters a to z is skipped."""
    text = F.col(text) if isinstance(text, str) else text
    coded = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), RULES, F.lower(text))
    return F.upper(coded)
