"""Exact candidate joins for texts by shared q-grams.

Two texts within an edit bound share at least ``need`` of their padded q-grams,
counted with repeats. With all grams in one global order, a pair that shares
``need`` of them shares one among the first ``size - need + 1`` of each text
(prefix filtering), so only that prefix is joined. The order is by how many
texts hold the gram, rarest first, which keeps common grams out of the join.

A gram that is common and still in the prefix is joined together with a second
one: a pair sharing two grams shares two in a prefix one longer, so common grams
are paired up and each such pair is a key. No candidate is lost.

Texts made of the same pieces, such as addresses of web pages, share so many keys that
they would meet more often than all pairs of texts are. That is counted first; then all
pairs are compared, in tiles, each once. For edit distances tiles are much the faster
(``texts``), and are taken well before that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import direct_pairs, self_pairs
from .settings import HOT_GRAM_ROWS, conf_int, cut_lineage, spread

_EDGE = "\u0001"
_SLOTS = 65_536  # rows of the broadcast frequency table, whatever the data
TILE_GAIN = 64  # pairs of texts that tiles compare in the time of one meeting by a key, at least
FEW_MEETINGS = 1_000_000


def qgrams(text, q: int = 2) -> Column:
    """Padded q-grams of a text, with repeats; ``q - 1`` more than it has characters."""
    text = F.col(text) if isinstance(text, str) else text
    edge = F.lit(_EDGE * (q - 1))
    padded = F.concat(edge, text, edge)
    return F.transform(F.sequence(F.lit(1), F.length(text) + (q - 1)), lambda i: F.substring(padded, i, q))


def gram_size(t: float) -> int:
    """Gram length (2 or 3) for an edit similarity of at least ``t``.

    One edit spoils ``q`` grams, so ``1 - q (1 - t)`` of a text's grams survive.
    Longer grams are rarer, but each edit spoils more of them, and the prefix then
    reaches into the parts that many texts share.
    """
    return 3 if 1 - 3 * (1 - t) >= 0.2 else 2


def word_bigrams(tokens: str) -> Column:
    """Bigrams of each word with its two blanks: blind to the order of words."""
    text = F.concat(F.lit(" "), F.array_join(F.col(tokens), " "), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2))


def gram_pairs(
    values: DataFrame, id_col: str, grams: Column, need: Column, keep: Callable[[], Column], carry=(), tiles: bool = False
) -> DataFrame | None:
    """Pairs of rows that share enough bigrams and pass ``keep``.

    ``need`` is the least number of bigrams (with repeats) a row shares with any
    row it may match. ``id_col`` is unique and ``carry`` columns ride along; all
    come back with ``_l`` and ``_r``, ids in order, once per shared key.

    Bigram frequencies are read first, in one job: a statistics table of bounded
    size, which also tells whether common bigrams need their own join at all. With
    ``tiles`` None comes back where tiles of all pairs (:func:`texts.dense_pairs`) are the
    shorter way.
    """
    spark = values.sparkSession
    hot = conf_int(spark, "hotGramRows", HOT_GRAM_ROWS)
    carry = list(carry)
    base = spread(values, id_col).select(id_col, *carry, need.cast("int").alias("_need"), F.explode(grams).alias("_g"))
    # Repeats of one bigram become separate tokens: first, second, ...
    tokens = (
        base.groupBy(id_col, *carry, "_need", "_g").agg(F.count(F.lit(1)).cast("int").alias("_c"))
        .select(id_col, *carry, "_need", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k"), "_g")
        .select(id_col, *carry, "_need", F.xxhash64("_g", "_k").alias("_tok"))
    )
    slot = F.pmod(F.col("_tok"), F.lit(_SLOTS)).cast("int")
    # Frequencies per hash slot: a consistent order needs no exact counts, and
    # the table has at most _SLOTS rows, so broadcasting it is safe.
    freq = cut_lineage(tokens.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_f")))
    has_hot = bool(freq.where(F.col("_f") > hot).take(1))
    per_row = Window.partitionBy(id_col)
    ranked = cut_lineage(
        tokens.withColumn("_slot", slot).join(F.broadcast(freq), "_slot")
        .select(
            id_col, *carry, "_need", "_tok", "_f",
            F.row_number().over(per_row.orderBy("_f", "_tok")).alias("_rank"),
            (F.count(F.lit(1)).over(per_row) - F.col("_need") + 1).alias("_prefix"),
        ).where(F.col("_rank") <= F.col("_prefix") + 1)
    )
    is_hot = F.col("_f") > hot
    single = F.col("_rank") <= F.col("_prefix")
    # At most ``hot`` rows hold a cold key, so it needs no tiles.
    cold = ranked.where(single & ~is_hot).select("_tok", id_col, *carry)
    shared = None
    if has_hot:
        lone = ranked.where(single & is_hot & (F.col("_need") < 2)).select("_tok", id_col, *carry)
        common = (
            ranked.where(is_hot).groupBy(id_col, *carry)
            .agg(F.array_sort(F.collect_list(F.struct("_rank", "_tok"))).alias("_hot"))
        )

        def pair_up(a, i):
            rest = F.slice(F.col("_hot"), i + 2, F.size("_hot"))
            return F.transform(rest, lambda b: F.xxhash64(a["_tok"], b["_tok"]))

        doubled = common.select(F.explode(F.flatten(F.transform("_hot", pair_up))).alias("_tok"), id_col, *carry)
        shared = doubled.unionByName(lone)
    size = values.count()
    meetings = _meetings([cold] + ([shared] if has_hot else []))
    if tiles and crowded(meetings, size):
        return None
    if meetings > size * (size - 1) / 2:
        return self_pairs(values.select(id_col, *carry), [], id_col, keep=keep, size=size)
    found = direct_pairs(cold, ["_tok"], id_col, keep).drop("_tok")
    if not has_hot:
        return found
    return found.unionByName(self_pairs(shared, ["_tok"], id_col, keep=keep).drop("_tok"))


def crowded(meetings: float, size: int) -> bool:
    """Would all pairs of ``size`` texts, compared in tiles, cost less than so many meetings by keys?"""
    return meetings > max(FEW_MEETINGS, size * (size - 1) / 2 / TILE_GAIN)


def _meetings(keyed: list[DataFrame]) -> float:
    """How often two rows meet in joins by ``_tok``."""
    meet = F.col("_n").cast("double") * (F.col("_n") - 1) / 2
    return sum(rows.groupBy("_tok").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(meet)).first()[0] or 0.0 for rows in keyed)
