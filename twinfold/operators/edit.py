"""Edit-distance methods: one column, or a weighted mean over several."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import lev_sim, weighted_mean
from ..plans.grams import gram_size
from ..plans.groups import PairTable, all_pairs, cardinalities, compact, copies, value_groups
from ..plans.neighbours import Lookup, Residual, both_ways, column_bound, edit_neighbours, match_groups
from ..plans.settings import cut_lineage
from ..sources.records import as_text, validate


def levenshtein_pairs(
    df: DataFrame, bdv: str, min_similarity: float | None = None, normalize: Callable[[Column], Column] | None = None
) -> PairTable:
    """Edit similarity of the ``bdv`` texts, case-sensitive and untrimmed.

    Without ``min_similarity`` every pair of distinct texts is scored. With it,
    only texts that share enough bigrams to reach it are compared. ``normalize``
    is applied to the texts first, for instance ``F.lower``.
    """
    validate(df, bdv)
    text = as_text(bdv)
    keyed = df.select("rid", (normalize(text) if normalize else text).alias("c0"))
    return _edit_pairs(keyed, ["c0"], [1.0], min_similarity)


def qgram_candidates(df: DataFrame, col: str, min_similarity: float, q: int | None = None) -> DataFrame:
    """``v_l, v_r, sim``: distinct texts of ``col`` that pass the q-gram filter.

    Exact for ``min_similarity`` from 50 percent up: no pair at or above it is
    missing, and pairs below it are already dropped.
    """
    validate(df, None, [col])
    if not 50 <= min_similarity <= 100:
        raise ValueError("min_similarity must be between 50 and 100")
    values = cut_lineage(df.select(as_text(col).alias("c0")).distinct())
    return edit_neighbours(values, "c0", min_similarity / 100, values.count(), q=q or gram_size(min_similarity / 100))


def weighted_levenshtein_pairs(
    df: DataFrame, weights: dict[str, float], min_similarity: float | None = None,
    bdv: str | None = None, normalize: Callable[[Column], Column] | None = None,
) -> PairTable:
    """Weighted mean of edit similarities over the columns named in ``weights``."""
    validate(df, bdv, weights)
    used = [(c, float(w)) for c, w in weights.items() if float(w) != 0]
    texts = [normalize(as_text(c)) if normalize else as_text(c) for c, _ in used]
    keyed = df.select("rid", *[t.alias(f"c{i}") for i, t in enumerate(texts)])
    return _edit_pairs(keyed, [f"c{i}" for i in range(len(used))], [w for _, w in used], min_similarity)


def _edit_pairs(keyed: DataFrame, cols: Sequence[str], weights: Sequence[float], min_similarity: float | None) -> PairTable:
    """Pairs over text columns ``cols``; shared with the phonetic method."""
    if not cols:
        return constant_pairs(keyed, min_similarity)
    groups, members = value_groups(keyed, cols)
    scores = [lev_sim(f"{c}_l", f"{c}_r") for c in cols]
    mean = weighted_mean(scores, weights) * 100
    if min_similarity is None:
        pairs = compact(all_pairs(groups, "gid"), mean)
    elif len(cols) == 1:
        size = cardinalities(groups, cols)[0]
        near = edit_neighbours(groups, cols[0], min_similarity / 100, size, carry=["gid", "n"])
        pairs = compact(near.where(F.col("sim") * 100 >= min_similarity), F.col("sim") * 100)
    else:
        total, lookups, residuals, order = sum(weights), [], [], []
        sizes = cardinalities(groups, cols)
        for c, w, score, size in zip(cols, weights, scores, sizes):
            bound = column_bound(w, total, min_similarity / 100)
            if bound >= 0.5:
                values = groups.select(c).distinct()
                table = both_ways(edit_neighbours(values, c, bound, size), values, c, F.lit(1.0))
                order.append(("lookup", len(lookups)))
                lookups.append(Lookup(c, w, table))
            else:
                order.append(("residual", len(residuals)))
                residuals.append(Residual(w, score))
        if lookups:
            joined = match_groups(groups, lookups, [], residuals, order, min_similarity, unique=not residuals)
            pairs = compact(joined, F.col("similarity"))
        else:
            keep = lambda: mean >= F.lit(float(min_similarity))
            pairs = compact(all_pairs(groups, "gid", keep=keep), mean)
    return PairTable(pairs, members, copies(groups, F.lit(100.0)))


def constant_pairs(keyed: DataFrame, min_similarity: float | None) -> PairTable:
    """No column carries weight: every pair of records scores 0."""
    one = keyed.select("rid", F.lit(0).alias("c0"))
    groups, members = value_groups(one, ["c0"])
    inside = copies(groups, F.lit(0.0))
    if min_similarity is not None and min_similarity > 0:
        inside = inside.where(F.lit(False))
    return PairTable(inside.where(F.lit(False)), members, inside)
