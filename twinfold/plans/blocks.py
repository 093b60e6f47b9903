"""Joins between rows that share a key, with hot keys cut into tiles.

A key held by more than ``block_rows`` rows is split into blocks by a hash of
the row id, and the comparisons of that key become a grid of block pairs, each
its own join key. No task then sees more than two blocks of one key, however
many rows hold it, and nothing is dropped. Keys below the limit form one tile
and cost no replication.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settings import block_rows, cut_lineage, shuffle_width


def key_sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def _on(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{k}_l") == F.col(f"{k}_r") for k in keys])


def _tidy(joined: DataFrame, keys: Sequence[str], tile: Sequence[str]) -> DataFrame:
    gone = {f"{k}_{s}" for k in tile for s in "lr"}
    kept = [F.col(f"{k}_l").alias(k) for k in keys]
    return joined.select(*kept, *[F.col(c) for c in joined.columns if c not in gone])


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys held by more than ``limit`` rows with their number of blocks, if any.

    Counting combines before its shuffle. The table holds at most one key per
    ``limit`` rows; written out, its size is known, so Spark broadcasts it only
    where that is small.
    """
    blocks = F.ceil(F.col("_n") / F.lit(float(limit))).cast("int").alias("_b")
    hot = cut_lineage(key_sizes(rows, keys).where(F.col("_n") > limit).select(*keys, blocks))
    return hot if hot.take(1) else None


def direct_pairs(
    rows: DataFrame, keys: Sequence[str], id_col: str, keep: Callable[[], Column] | None = None
) -> DataFrame:
    """:func:`self_pairs` for keys known not to be hot.

    Both sides of the join read one and the same shuffle.
    """
    shared = rows.repartition(shuffle_width(rows.sparkSession), *keys)
    on = _on(keys) & (F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))
    if keep is not None:
        on = on & keep()
    return _tidy(_side(shared, "l").join(_side(shared, "r"), on), keys, keys)


def self_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    id_col: str,
    keep: Callable[[], Column] | None = None,
    size: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Unordered pairs of rows that agree on ``keys`` and pass ``keep``.

    Every column of ``rows`` other than the keys comes back twice, with ``_l``
    and ``_r``, the smaller id left. ``keep`` must be symmetric, as it is applied
    before the ends are put in order. A pair that shares several keys comes back
    once per key. Without keys all rows are compared, and ``size`` is their
    number.
    """
    spark = rows.sparkSession
    limit = limit or block_rows(spark)
    width = shuffle_width(spark)
    if keys:
        hot = hot_keys(rows, keys, limit)
        if hot is None:
            return direct_pairs(rows, keys, id_col, keep)
        sized = _with_blocks(rows, hot, keys)
    else:
        # Enough tiles to keep every core busy, none above the row limit.
        parts = max(-(-size // limit), min(int((4 * width) ** 0.5) + 1, -(-size // 32)), 1)
        sized = rows.withColumn("_b", F.lit(parts))
    own_block = sized.withColumn("_o", _block(id_col))
    tile = list(keys) + ["_i", "_j"]
    left = (
        own_block.withColumn("_j", F.explode(F.sequence("_o", F.col("_b") - 1)))
        .withColumnRenamed("_o", "_i").drop("_b")
    )
    right = (
        own_block.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_o"))))
        .withColumnRenamed("_o", "_j").drop("_b")
    )
    left = _side(left.repartition(width, *tile), "l")
    right = _side(right.repartition(width, *tile), "r")
    once = (F.col("_i_l") < F.col("_j_l")) | (F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))
    on = _on(tile) & once
    if keep is not None:
        on = on & keep()
    pairs = _tidy(left.join(right, on), keys, tile)
    # Across two blocks either end may have the smaller id: put it left.
    swap = F.col(f"{id_col}_l") > F.col(f"{id_col}_r")
    names = [c for c in rows.columns if c not in keys]
    return pairs.select(
        *keys,
        *[F.when(swap, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")).alias(f"{c}_l") for c in names],
        *[F.when(swap, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")).alias(f"{c}_r") for c in names],
    )


def probe_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    id_col: str,
    keep: Callable[[], Column] | None = None,
    unique: bool = False,
    ordered: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``keys`` where the left id is the smaller.

    ``left`` may hold several rows per id (the keys it looks for), ``right``
    one row per id. ``unique`` says the keys identify a right row, so no key can
    be hot on that side. ``ordered=False`` leaves the condition on ids out.
    """
    accept = F.lit(True)
    if ordered:
        accept = F.col(f"{id_col}_l") < F.col(f"{id_col}_r")
    if keep is not None:
        accept = accept & keep()
    hot = None if unique else hot_keys(right, keys, limit or block_rows(left.sparkSession))
    if hot is None:
        return _tidy(_side(left, "l").join(_side(right, "r"), _on(keys) & accept), keys, keys)
    spread = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    tile = list(keys) + ["_i", "_j"]
    width = shuffle_width(left.sparkSession)
    lhs = _with_blocks(left, hot, keys).withColumn("_i", _block(id_col)).withColumn("_j", spread).drop("_b")
    rhs = _with_blocks(right, hot, keys).withColumn("_j", _block(id_col)).withColumn("_i", spread).drop("_b")
    lhs = _side(lhs.repartition(width, *tile), "l")
    rhs = _side(rhs.repartition(width, *tile), "r")
    return _tidy(lhs.join(rhs, _on(tile) & accept), keys, tile)


def _with_blocks(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(hot, list(keys), "left").withColumn("_b", F.coalesce("_b", F.lit(1)))


def _block(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col("_b")).cast("int")


HOT_KEYS = 65_536  # rows of a broadcast table of hot keys, at most


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row per key, by equal keys (null equals null).

    ``size`` names the column of ``totals`` that says how many rows a key has. Keys
    with more than 1/HOT_KEYS of these rows are HOT_KEYS at most, whatever the data:
    they are broadcast, so that a hot key stays where its rows are. The others meet by
    a shuffle, in which no key has more than that share. Both tables should be
    written ones, as they are read twice.
    """
    whole = totals.agg(F.sum(size)).first()[0] or 0
    limit = max(1, whole // HOT_KEYS)
    hot = totals.where(F.col(size) > limit)

    def meet(left, right, how):
        right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        out = left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
        return out if how == "left_anti" else out.drop(*[f"_{k}" for k in keys])

    if not hot.take(1):
        return meet(rows, totals, "inner")
    cold = meet(rows, F.broadcast(hot.select(*keys)), "left_anti")
    rest = meet(cold, totals.where(F.col(size) <= limit), "inner")
    return meet(rows, F.broadcast(hot), "inner").unionByName(rest)
