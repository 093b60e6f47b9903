"""Token-set ratio: how alike two sets of words are, 0 to 100."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_set(text) -> Column:
    """Sorted distinct words: lower case, non-word signs as blanks, ASCII only."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " ")
    clean = F.regexp_replace(clean, r"[^\x00-\x7F]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda t: t != "")))


_PAIRS = 4096  # aligned at once


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts.

    Bit-parallel rows (Hyyrö 2004): a bit for each character of the shorter text, one
    step for each character of the longer one, for many pairs of like length at once.
    """
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(n_a), np.int64)
    short, long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    order = np.lexsort((long, (short + 63) // 64))
    order = order[short[order] > 0]
    for at in range(0, len(order), _PAIRS):
        part = order[at: at + _PAIRS]
        swap = n_a[part] > n_b[part]
        x = _characters([b[k] if s else a[k] for k, s in zip(part.tolist(), swap.tolist())], -(-int(short[part].max()) // 64) * 64, 0)
        y = _characters([a[k] if s else b[k] for k, s in zip(part.tolist(), swap.tolist())], int(long[part].max()), 1)
        out[part] = _rows(x, y)
    return out


def _characters(texts: list[str], width: int, other: int) -> np.ndarray:
    """Code points of each text in a row, filled up with numbers that no character has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), 0x110000 + other, np.uint32)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    words = x.shape[1] // 64
    row = np.full((len(x), words), ~np.uint64(0))
    for j in range(y.shape[1]):
        match = np.packbits(x == y[:, j, None], axis=1, bitorder="little").view("<u8")
        hit = row & match
        total, carry = np.empty_like(row), np.zeros(len(x), np.uint64)
        for w in range(words):  # one long number: sums carry from word to word
            part = row[:, w] + hit[:, w]
            total[:, w] = part + carry
            carry = ((part < row[:, w]) | (total[:, w] < part)).astype(np.uint64)
        row = total | (row - hit)
    # Bits beyond a text are never matched and stay set; each cleared bit is a character in common.
    return words * 64 - np.bitwise_count(row).sum(axis=1).astype(np.int64)


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()), dtype="int32")


def set_parts(a, b) -> tuple[Column, Column, Column]:
    """Common words, words only in ``a``, words only in ``b``, each joined by blanks."""
    a, b = F.col(a), F.col(b)
    return (
        F.array_join(F.array_intersect(a, b), " "),
        F.array_join(F.array_except(a, b), " "),
        F.array_join(F.array_except(b, a), " "),
    )


def _joined_length(common: Column, rest: Column) -> Column:
    """Length of the common words followed by the rest."""
    gap = F.when((F.length(common) > 0) & (F.length(rest) > 0), 1).otherwise(0)
    return F.length(common) + gap + F.length(rest)


def _ratio(lcs: Column, total: Column) -> Column:
    """Whole percent, halves to even; texts without length give 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.lit(200.0) * lcs / total))


def set_ratio_bound(common: str, only_a: str, only_b: str) -> Column:
    """The ratio if the unshared words lined up as well as their lengths allow."""
    c, x, y = F.col(common), F.col(only_a), F.col(only_b)
    return _best(c, x, y, F.least(F.length(x), F.length(y)))


def set_ratio(common: str, only_a: str, only_b: str) -> Column:
    """Best of the three ratios between common words and the two full sides.

    Common words lead both sides, so only the unshared rests need an alignment.
    """
    c, x, y = F.col(common), F.col(only_a), F.col(only_b)
    return _best(c, x, y, _lcs(x, y))


def _best(c: Column, x: Column, y: Column, rest_lcs: Column) -> Column:
    n, nx, ny = F.length(c), _joined_length(c, x), _joined_length(c, y)
    lead = n + F.when((n > 0) & (F.length(x) > 0) & (F.length(y) > 0), 1).otherwise(0)
    contained = (F.length(x) == 0) | (F.length(y) == 0)
    return (
        F.when((nx == 0) | (ny == 0), F.lit(0.0))
        .when((n > 0) & contained, F.lit(100.0))
        .otherwise(F.greatest(_ratio(n, n + nx), _ratio(n, n + ny), _ratio(lead + rest_lcs, nx + ny)))
    )
