"""Exact joins of texts within few edits, by equal segments (Pass-Join, Li et al. 2011).

A text cut evenly into one segment more than there may be edits has a segment that no
edit touches, so each text within that distance holds it, at a place shifted by no
more than the edits on either side. The shorter text of a pair is indexed by (length,
edits, segment number, segment); the longer one looks up the substrings that can stand
there. What a lookup finds is measured once, by an edit distance that stops early.

A segment that very many texts share, such as a common beginning, says little. There
the rest of both texts, left and right of it, is within the remaining edits, so the
segment is joined together with what few deletions leave of the rest. With more than
two edits to spare its texts are compared in blocks. No pair is lost either way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import probe_pairs
from .grams import crowded
from .settings import block_rows, cut_lineage, shuffle_width, spread

EPS = 1e-9
_FEW = 2  # edits up to which deletions are written out


def _edits(t: float, length: str) -> str:
    return f"cast(floor({1.0 - t!r}D * ({length}) + {EPS!r}D) as int)"


def _cut(length: str) -> tuple[str, str]:
    """Start and size of segment ``i`` of ``k + 1`` in a text of some length; the later segments are the longer."""
    size, shorter = f"cast({length} div (k + 1) as int)", f"(k + 1 - {length} % (k + 1))"
    return f"(i * {size} + greatest(0, i - {shorter}))", f"({size} + if(i >= {shorter}, 1, 0))"


def _entry(length: str, at: str, size: str) -> str:
    return f"named_struct('key', xxhash64({length}, k, i, substring(v, {at} + 1, {size})), 'at', {at}, 'size', {size}, 'i', i, 'k', k)"


def index_entries(t: float, longest: int) -> Column:
    """Segments of a text ``v``, for every number of edits that a pair with a text of its length or longer may have."""
    at, size = _cut("length(v)")
    partner = f"least({longest}, cast(floor(length(v) / {t!r}D + {EPS!r}D) as int))"
    return F.expr(f"flatten(transform(sequence({_edits(t, 'length(v)')}, {_edits(t, partner)}), k -> "
                  f"transform(sequence(0, k), i -> {_entry('length(v)', at, size)})))")


def probe_entries(t: float) -> Column:
    """Substrings of a text ``v`` that a segment of a text of its length or shorter can be equal to."""
    at, size = _cut("m")
    shift = "(length(v) - m)"
    low = f"greatest(0, {at} - i, {at} + {shift} - (k - i))"
    high = f"least(length(v) - {size}, {at} + i, {at} + {shift} + (k - i))"
    spots = f"if({high} >= {low}, sequence({low}, {high}), cast(array() as array<int>))"
    by_segment = f"transform(sequence(0, k), i -> transform({spots}, q -> {_entry('m', 'q', size)}))"
    by_length = f"transform(sequence(length(v) - k, length(v)), m -> flatten({by_segment}))"
    return F.expr(f"flatten(flatten(transform(array({_edits(t, 'length(v)')}), k -> {by_length})))")


def left_over(text: Column, depth: Column) -> Column:
    """Hashes of what is left of a text after up to ``depth`` deletions, 0 to 2."""
    n = F.length(text)

    def without(i):  # the text without its i-th character, counted from 1
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))

    def without_two(i, j):  # i < j
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, n))

    none = F.array().cast("array<bigint>")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    once = F.transform(places, lambda i: F.xxhash64(without(i)))
    twice = F.flatten(F.transform(places, lambda i: F.transform(F.slice(places, i + 1, n), lambda j: F.xxhash64(without_two(i, j)))))
    return F.array_distinct(F.concat(
        F.array(F.xxhash64(text)), F.when(depth >= 1, once).otherwise(none), F.when(depth >= 2, twice).otherwise(none)))


def _keys(hot: Column) -> Column:
    """The key of a segment, or, where it is common, keys of it and what deletions leave on either side."""
    before = left_over(F.substring(F.col("v"), F.lit(1), F.col("at")), F.col("i"))
    after = left_over(F.substring(F.col("v"), F.col("at") + F.col("size") + 1, F.length("v")), F.col("k") - F.col("i"))
    both = F.flatten(F.transform(before, lambda a: F.transform(after, lambda b: F.xxhash64("key", a, b))))
    return F.when(hot, F.array_distinct(both)).otherwise(F.array("key"))


def segment_pairs(values: DataFrame, id_col: str, t: float, longest: int, keep: Callable[[], Column], carry: Sequence[str] = (),
                  size: int | None = None) -> DataFrame | None:
    """Pairs of rows whose texts ``v`` are within ``1 - t`` edits a character of the longer one, filtered by ``keep``.

    ``v`` is among ``id_col`` and ``carry``, which come back with ``_l`` and ``_r``, ids
    in order, once per shared key. Texts have ``longest`` characters at most, and ``keep``
    is the edit bound or more. With ``size``, the number of rows, None comes back where tiles
    of all pairs (:func:`texts.dense_pairs`) are the shorter way.
    """
    names = [id_col, *carry]
    rows = spread(values, id_col).select(*names)
    both = F.array(F.struct(F.lit(True).alias("asks"), probe_entries(t).alias("e")), F.struct(F.lit(False).alias("asks"), index_entries(t, longest).alias("e")))
    entries = rows.select(*names, F.inline(both)).select(*names, "asks", F.inline("e"))
    entries = cut_lineage(entries)  # read for its common keys, then by both sides of each join
    n_l, n_r = F.length("v_l"), F.length("v_r")

    def once():  # the left end is the longer text; of two equally long ones both look up
        return ((n_l > n_r) | (F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))) & keep()

    def met(rows: DataFrame, unique: bool) -> DataFrame:
        # Both sides read one shuffle, of a set width: measuring is heavy for the bytes there are.
        shared = rows.select(*names, "asks", "key").repartition(shuffle_width(rows.sparkSession), "key")
        sides = [shared.where(asks).drop("asks") for asks in ("asks", "NOT asks")]
        found = probe_pairs(*sides, ["key"], id_col, keep=once, unique=unique, ordered=False)
        swap = F.col(f"{id_col}_l") > F.col(f"{id_col}_r")
        ends = lambda a, b, s: [F.when(swap, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}")).alias(f"{c}_{s}") for c in names]
        return found.select(*ends("r", "l", "l"), *ends("l", "r", "r"))

    # At most one key in ``limit`` entries is common; the written table shows its size.
    limit = block_rows(values.sparkSession)
    held = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("k").alias("_k"), F.count_if("asks").cast("double").alias("_asks"))
    if size is not None:
        # Common segments with few edits get longer keys, which meet less often.
        met_by = F.when((F.col("_n") <= limit) | (F.col("_k") > _FEW), F.col("_asks") * (F.col("_n") - F.col("_asks")))
        if crowded(held.agg(F.sum(met_by)).first()[0] or 0.0, size):
            return None
    hot = cut_lineage(held.where(F.col("_n") > limit).select("key", "_k"))
    most = hot.agg(F.max("_k")).first()[0]
    if most is None:
        return met(entries, unique=True)
    marked = entries.join(hot.withColumnRenamed("key", "_hot"), F.col("key") == F.col("_hot"), "left")
    few = F.coalesce(F.col("_k") <= _FEW, F.lit(True))
    keyed = marked.where(few).select(*names, "asks", F.explode(_keys(F.col("_hot").isNotNull())).alias("key"))
    found = met(keyed, unique=True)
    return found if most <= _FEW else found.unionByName(met(marked.where(~few), unique=False))
