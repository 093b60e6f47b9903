"""Distributed LSD radix sort: ranks by stable counting-sort passes.

Rows have a place each. A pass orders them by one digit of the key and leaves rows of
equal digits as they were. Places are cut into blocks; each block counts its digits.
A row's destination is the number of rows with a smaller digit, plus those of equal
digit in earlier blocks, plus those before it in its own block. The first two are
prefix sums over the (digit, block) counts, the last comes from a counting sort inside
the block. From the least to the most significant digit, the last places are the ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DIGIT_BITS = 10
BLOCK_ROWS = 1 << 14
_SIGN = -(1 << 63)


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` written out with ``place``: 0, 1, 2 ... in the order of its partitions.

    One count per partition passes through the driver."""
    # The generated id is the partition in the high bits and the row's place in it in the low 33.
    marked = scratch.write(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    out = marked.join(F.broadcast(starts), part == F.col("_part"))
    out = scratch.write(out.withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start"))
    scratch.drop(marked)
    return out


def _move(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """Destinations of one block's rows; ``offsets`` has the first destination of each digit in it."""
    at = rows.column("place").to_numpy()
    at = at - at.min()  # a block's places have no gaps
    digit = np.empty(len(at), np.uint16)
    digit[at] = rows.column("_digit").to_numpy()
    count = np.bincount(digit, minlength=1 << DIGIT_BITS)
    order = np.argsort(digit, kind="stable")  # a counting sort for 16-bit numbers
    inside = np.empty(len(at), np.int64)
    inside[order] = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    first = np.zeros(1 << DIGIT_BITS, np.int64)
    first[offsets.column("_digit").to_numpy()] = offsets.column("_first").to_numpy()
    to = (first[digit] + inside)[at]
    return rows.drop(["_block", "_digit"]).set_column(rows.column_names.index("place"), "place", pa.array(to))


def radix_ranks(rows: DataFrame, keys: Sequence[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... in ascending order of ``keys``, the first of most weight.

    Keys are bigint expressions over the columns of ``rows``, without nulls. Digits in
    which all rows agree need no pass. Equal keys take ranks next to each other, in
    the order in which ``rows`` was first written. An empty table stays empty. Each
    pass is written out; the table returned belongs to ``scratch``.
    """
    if "place" in rows.columns or "rank" in rows.columns:
        raise ValueError("rows to rank already have a column 'place' or 'rank'")
    names = rows.columns
    placed = _numbered(rows, scratch)
    unsigned = [k.bitwiseXOR(F.lit(_SIGN)) for k in keys]
    bits = placed.agg(*[f(u).alias(f"{n}{i}") for i, u in enumerate(unsigned) for n, f in (("any", F.bit_or), ("all", F.bit_and))]).first()
    for i in reversed(range(len(keys))):
        varying = ((bits[f"any{i}"] or 0) ^ (bits[f"all{i}"] or 0)) & ((1 << 64) - 1)
        for shift in range(0, 64, DIGIT_BITS):
            if not varying >> shift & ((1 << DIGIT_BITS) - 1):
                continue
            digit = F.shiftrightunsigned(unsigned[i], shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
            block = F.floor(F.col("place") / F.lit(BLOCK_ROWS)).cast("bigint")
            dealt = placed.withColumn("_block", block).withColumn("_digit", digit)
            counts = scratch.write(dealt.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n")))
            smaller, bases = 0, []
            for r in counts.groupBy("_digit").agg(F.sum("_n").alias("n")).orderBy("_digit").collect():  # a row per digit
                bases.append((r["_digit"], smaller))
                smaller += r["n"]
            bases = rows.sparkSession.createDataFrame(bases, "_digit int, _smaller bigint")
            earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
            firsts = counts.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(bases), "_digit")
            firsts = firsts.select("_block", "_digit", (F.col("_smaller") + F.col("_earlier")).alias("_first"))
            moved = scratch.write(dealt.groupBy("_block").cogroup(firsts.groupBy("_block")).applyInArrow(_move, placed.schema))
            scratch.drop(placed, counts)
            placed = moved
    return placed.select(*names, (F.col("place") + 1).alias("rank"))
