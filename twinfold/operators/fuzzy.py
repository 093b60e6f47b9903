"""Token-set method: compare sets of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import weighted_mean
from ..functions.tokens import set_parts, set_ratio, token_set
from ..plans.groups import PairTable, all_pairs, cardinalities, compact, copies, value_groups
from ..plans.neighbours import Lookup, Residual, both_ways, column_bound, match_groups, set_neighbours
from ..sources.records import as_text, validate
from .edit import constant_pairs


def fuzzy_pairs(
    df: DataFrame, cols: Sequence[str], weights: dict[str, float] | None = None,
    threshold: float = 80.0, bdv: str | None = None,
) -> PairTable:
    """Weighted mean of token-set ratios, keeping pairs at ``threshold`` or above.

    The ratio depends only on the set of words, so records are grouped by their
    sorted word sets: copies and reordered texts cost nothing extra.
    """
    validate(df, bdv, cols, need_one=True)
    weights = weights or {}
    used = [(c, float(weights.get(c, 1.0))) for c in cols if float(weights.get(c, 1.0)) != 0]
    if not used:
        return constant_pairs(df, threshold)
    names = [f"c{i}" for i in range(len(used))]
    w = [x for _, x in used]
    keyed = df.select("rid", *[token_set(as_text(c)).alias(n) for (c, _), n in zip(used, names)])
    groups, members = value_groups(keyed, names)
    total = sum(w)
    bounds = [column_bound(x, total, threshold / 100) for x in w]
    own = [F.when(F.size(n) > 0, F.lit(100.0)).otherwise(F.lit(0.0)) for n in names]
    inside = copies(groups, weighted_mean(own, w)).where(F.col("similarity") >= threshold)
    final = lambda joined: compact(
        _scored(joined, names), weighted_mean([F.col(f"s_{n}") for n in names], w)
    ).where(F.col("similarity") >= threshold)
    if max(bounds) <= 0:
        pairs = final(all_pairs(groups, "gid"))
        return PairTable(pairs, members, inside)
    lookups, residuals, order = [], [], []
    for n, x, bound, size in zip(names, w, bounds, cardinalities(groups, names)):
        if bound > 0:
            values = groups.select(n).distinct()
            near = set_neighbours(values, n, bound, size).select(
                F.split("v_l", " ").alias("v_l"), F.split("v_r", " ").alias("v_r"), "sim"
            )
            own_score = F.when(F.size(n) > 0, F.lit(100.0)).otherwise(F.lit(0.0))
            order.append(("lookup", len(lookups)))
            lookups.append(Lookup(n, x, both_ways(near, values, n, own_score)))
        else:
            # Joined as if it matched fully, then scored on what is left.
            order.append(("residual", len(residuals)))
            residuals.append(Residual(x, F.lit(100.0)))
    joined = match_groups(groups, lookups, [], residuals, order, threshold, unique=not residuals, scale=100.0)
    pairs = final(joined.drop("similarity")) if residuals else compact(joined, F.col("similarity"))
    return PairTable(pairs, members, inside)


def _scored(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """Joined groups with the ratio of each column as ``s_<column>``."""
    for n in names:
        common, only_a, only_b = set_parts(f"{n}_l", f"{n}_r")
        joined = joined.select("*", common.alias("_c"), only_a.alias("_x"), only_b.alias("_y"))
        joined = joined.select("*", set_ratio("_c", "_x", "_y").alias(f"s_{n}")).drop("_c", "_x", "_y")
    return joined
