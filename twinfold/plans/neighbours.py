"""Similar values of one column, and records that are similar in all columns.

A threshold on a weighted mean bounds every column: with weights summing to W, a
pair at or above t has ``similarity_c >= 1 - (1 - t) * W / w_c`` in column c. So
each column first gets a table of its similar values, over distinct values only.
Each record then looks up, column by column, the values its match may have, drops
combinations whose mean can no longer reach t, and finds the records that hold a
remaining combination by an equi-join. The work follows the number of similar
records, not the square of the table, and copies or common values do not inflate
it: when every column is looked up, a combination names one group of copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scores import lev_sim, weighted_mean
from ..functions.tokens import set_parts, set_ratio, set_ratio_bound
from .blocks import probe_pairs, self_pairs
from .grams import gram_pairs, gram_size, qgrams, word_bigrams
from .groups import all_pairs
from .segments import segment_pairs
from .settings import cut_lineage
from .texts import dense_pairs

EPS = 1e-9
MAX_EDITS = 4  # between texts that are joined by segments


def column_bound(weight: float, total: float, t: float) -> float:
    """Least similarity (0..1) one column needs in a mean of at least ``t``."""
    if weight <= 0:
        return float("-inf")
    return 1.0 - (1.0 - t) * total / weight


def edit_neighbours(
    values: DataFrame, col: str, t: float, size: int, carry: Sequence[str] = (), q: int | None = None
) -> DataFrame:
    """Pairs of distinct texts with edit similarity of at least ``t``, as ``sim``.

    ``values`` holds each text once, in ``col``; ``size`` is about how many. Ends
    come back as ``v_l, v_r``, or as the ``carry`` columns (the first of which is
    unique) when given. All texts are compared when ``t < 0.5``, where a match need
    not share a bigram. ``q`` makes all pairs meet by grams of that length.
    """
    if q is not None and (q < 1 or 1 - q * (1 - t) < -EPS):
        raise ValueError(f"grams of {q} characters could miss matches at {100 * t} percent")
    own = list(carry) or ["v"]
    v = values.select(F.col(col).alias("v"), *carry)
    longer = F.greatest(F.length("v_l"), F.length("v_r"))
    shorter = F.least(F.length("v_l"), F.length("v_r"))
    # A double slack, so that rounding never makes the bound too tight.
    bound = f"cast(floor({1.0 - t!r}D * greatest(length(v_l), length(v_r)) + {EPS!r}D) as int)"
    sim = lev_sim("v_l", "v_r").alias("sim")

    def close():
        return (longer - shorter <= F.expr(bound)) & (F.expr(f"levenshtein(v_l, v_r, {bound})") >= 0)

    ends = [F.col(f"{c}_{s}") for s in "lr" for c in own]
    if t < 0.5:
        found = all_pairs(v, own[0], keep=close, size=size).select(*ends, sim)
    else:
        rest = ["v", *carry[1:]] if carry else []
        # Pairs split by the longer length: up to ``short`` characters few edits
        # are allowed and equal segments find them, beyond it grams do. A text that
        # can be in either kind of pair goes both ways.
        short = 0 if q else _short_length(t)
        near = v.where(F.length("v") <= short)
        few = lambda: (longer <= short) & close()
        many = lambda: (longer > short) & close()
        unique = bool(v.agg(F.count(F.lit(1)) == F.count_distinct(own[0])).first()[0])

        def either(found, rows, above):  # tiles find each pair of texts once, but ids may repeat
            if found is not None:
                return found.select(*ends, sim).distinct()
            found = dense_pairs(rows, own, t, size, above).select(*ends, "sim")
            return found if unique else found.distinct()

        parts = [] if q else [either(segment_pairs(near, own[0], t, short, few, carry=rest, size=near.count()), near, 0)]
        if q or v.where(F.length("v") > short).take(1):
            far = v.where(F.length("v") / F.lit(t) + EPS > short)
            # d edits leave max_len + q - 1 - q d shared grams, and d <= (1 - t) max_len.
            q = q or gram_size(t)
            lengths = F.sequence(F.length("v"), F.floor(F.length("v") / F.lit(t) + EPS).cast("int"))
            need = F.array_min(F.transform(lengths, lambda m: m + (q - 1) - q * F.floor(F.lit(1.0 - t) * m + EPS)))
            parts.append(either(gram_pairs(far, own[0], qgrams("v", q), need, many, carry=rest, tiles=True), far, short))
        found = reduce(DataFrame.unionByName, parts)
        found = found if unique else found.distinct()
    return found.where(F.col("sim") >= t - EPS)


def _short_length(t: float) -> int:
    """Longest text for which a match has few edits: a text then has some dozens of segments to look up."""
    return max([n for n in range(1, 100) if int((1 - t) * n + EPS) <= MAX_EDITS], default=0)


def set_neighbours(values: DataFrame, col: str, t: float, size: int) -> DataFrame:
    """Unordered pairs of distinct word sets with a token-set ratio of at least ``100 t``.

    ``values`` holds each sorted word set once, as an array in ``col``. A pair
    can reach the ratio in two ways, and each has its own candidate join:

    - the common words make up most of one side: that side, less its rarest
      words up to a third of its length, must share one of the rest;
    - the two sides align as texts: then they share bigrams (see ``need``).

    For ``t`` of 2/3 or less the second bound is empty and all distinct pairs
    are compared, in tiles.
    """
    rho = t - 0.005 - EPS  # the ratio is rounded to whole percents
    v = values.where(F.size(col) > 0).select(
        F.array_join(F.col(col), " ").alias("v"), F.col(col).alias("w")
    )
    if rho > 2 / 3:
        found = _by_words(v, rho).unionByName(_by_grams(v, rho)).distinct()
    else:
        found = all_pairs(v.select("v"), "v", size=size).select("v_l", "v_r")
    words = lambda c: F.split(F.col(c), " ")
    parts = found.select("v_l", "v_r", words("v_l").alias("a"), words("v_r").alias("b"))
    common, only_a, only_b = set_parts("a", "b")
    parts = parts.select("v_l", "v_r", common.alias("c"), only_a.alias("x"), only_b.alias("y"))
    # The length bound thins the candidates before any text leaves the JVM.
    parts = parts.where(set_ratio_bound("c", "x", "y") >= 100 * (t - EPS))
    scored = parts.select("v_l", "v_r", set_ratio("c", "x", "y").alias("sim"))
    return scored.where(F.col("sim") >= 100 * (t - EPS))


def _by_words(v: DataFrame, rho: float) -> DataFrame:
    """Pairs where the common words are at least rho / (2 - rho) of one side."""
    share = rho / (2 - rho)
    words = v.select("v", F.length("v").alias("len"), F.explode("w").alias("key"))
    n = words.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    by = Window.partitionBy("v").orderBy("f", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = words.join(n, "key").withColumn("before", F.coalesce(F.sum(F.length("key") + 1).over(by), F.lit(0)))
    # Words are skipped once the earlier (rarer) ones alone outweigh what a
    # match may leave unshared; joined length is the word lengths plus gaps.
    lead = ranked.where(F.col("before") <= (1 - share) * F.col("len") + 1 + EPS).select("key", "v")
    other = lambda: F.col("v_l") != F.col("v_r")
    return _pairs(probe_pairs(lead, words.select("key", "v"), ["key"], "v", keep=other, ordered=False))


def _pairs(found: DataFrame) -> DataFrame:
    """The distinct pairs of values, smaller text first."""
    return found.select(
        F.least("v_l", "v_r").alias("v_l"), F.greatest("v_l", "v_r").alias("v_r")
    ).distinct()


def _by_grams(v: DataFrame, rho: float) -> DataFrame:
    """Pairs whose full sides align well as texts, whatever the word order.

    With both lengths l and m and their alignment L >= rho (l + m) / 2, at least
    3L + 1 - (l + m) bigrams are shared, and m >= l rho / (2 - rho).
    """
    need = F.ceil(F.lit((1.5 * rho - 1) * 2 / (2 - rho)) * F.length("v") + 1 - EPS)

    def fits():
        l, m = F.length("v_l"), F.length("v_r")
        return F.least(l, m) * 2 >= F.lit(rho) * (l + m) - EPS

    return _pairs(gram_pairs(v, "v", word_bigrams("w"), need, fits, carry=["w"]))


def both_ways(pairs: DataFrame, values: DataFrame, col: str, own: Column) -> DataFrame:
    """``v, m, sim``: every value with its similar values, itself included."""
    pairs = cut_lineage(pairs)
    return (
        pairs.select(F.col("v_l").alias("v"), F.col("v_r").alias("m"), "sim")
        .union(pairs.select("v_r", "v_l", "sim"))
        .union(values.select(F.col(col), F.col(col), own.cast("double")))
    )


@dataclass
class Lookup:
    """A column matched through a table ``v, m, sim`` of its similar values."""

    column: str
    weight: float
    table: DataFrame


@dataclass
class Band:
    """A numeric column whose matches differ by at most ``width``."""

    column: str
    origin: float
    width: float


@dataclass
class Residual:
    """A column scored on the joined pair; ``score`` reads the ``_l``/``_r`` columns."""

    weight: float
    score: Column


def match_groups(
    groups: DataFrame,
    lookups: Sequence[Lookup],
    bands: Sequence[Band],
    residuals: Sequence[Residual],
    order: Sequence[tuple[str, int]],
    min_similarity: float,
    unique: bool,
    scale: float = 1.0,
) -> DataFrame:
    """Pairs of groups whose weighted mean is at least ``min_similarity`` percent.

    Column similarities run from 0 to ``scale``. ``unique`` says the looked-up
    columns identify a group. ``order`` lists ``("lookup", i)`` and ``("residual", i)`` in the order the
    mean adds them up. Returns the joined columns and ``similarity`` (percent).
    """
    total = sum(x.weight for x in lookups) + sum(x.weight for x in residuals)
    left, spent, gained = groups, 0.0, F.lit(0.0)
    keys = []
    for i, look in enumerate(lookups):
        table = look.table.select(
            F.col("v").alias(f"_v{i}"), F.col("m").alias(f"_m{i}"), F.col("sim").alias(f"_s{i}")
        )
        left = left.join(table, F.col(look.column) == F.col(f"_v{i}")).drop(f"_v{i}")
        spent += look.weight
        gained = gained + F.col(f"_s{i}") * F.lit(look.weight)
        # What the remaining columns can add at most is their weight.
        floor = (min_similarity / 100 - EPS) * total * scale
        left = left.where(gained + F.lit((total - spent) * scale) >= F.lit(floor))
        keys.append(f"_m{i}")
    right = groups.select("*", *[F.col(x.column).alias(f"_m{i}") for i, x in enumerate(lookups)])
    if bands:
        left, right, names = near_cells(left, right, bands)
        keys += names
    scores, weights = [], []
    for kind, i in order:
        part = F.col(f"_s{i}_l") if kind == "lookup" else residuals[i].score
        scores.append(part)
        weights.append(lookups[i].weight if kind == "lookup" else residuals[i].weight)
    similarity = weighted_mean(scores, weights) * F.lit(100.0 / scale)
    enough = lambda: similarity >= F.lit(float(min_similarity))
    if not bands:
        return probe_pairs(left, right, keys, "gid", keep=enough, unique=unique).withColumn("similarity", similarity)
    once = lambda: once_by_cell("gid") & enough()
    joined = probe_pairs(left, right, keys, "gid", keep=once, unique=unique, ordered=False).withColumn("similarity", similarity)
    return in_order(joined, "gid")


def near_cells(left: DataFrame, right: DataFrame, bands: Sequence[Band]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Grid cells: each right row in its own, each left row in its own and those that touch it on one side.

    Of two cells that touch, one looks into the other; inside a cell ids decide (:func:`once_by_cell`)."""
    names = [f"_c{i}" for i in range(len(bands))]
    here = (0,) * len(bands)
    near = F.array(*[
        F.struct(F.lit(steps == here).alias("_own_cell"), *[(_cell(b) + F.lit(step).cast("bigint")).alias(n) for b, n, step in zip(bands, names, steps)])
        for steps in product((-1, 0, 1), repeat=len(bands)) if steps >= here
    ])
    left = left.select("*", F.inline(near))
    return left, right.select("*", *[_cell(b).alias(n) for b, n in zip(bands, names)]), names


def once_by_cell(id_col: str) -> Column:
    """The condition by which a join over :func:`near_cells` finds each pair once, in any order."""
    return ~F.col("_own_cell_l") | (F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))


def in_order(pairs: DataFrame, id_col: str) -> DataFrame:
    """``pairs`` with the smaller id left; the other columns of the two ends stay where they are."""
    l, r = F.col(f"{id_col}_l"), F.col(f"{id_col}_r")
    return pairs.withColumns({f"{id_col}_l": F.least(l, r), f"{id_col}_r": F.greatest(l, r)}).drop("_own_cell_l")


def _cell(band: Band) -> Column:
    return F.floor((F.col(band.column) - F.lit(band.origin)) / F.lit(band.width)).cast("bigint")
