"""Phonetic methods: compare how texts sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phonetic import metaphone
from ..plans.blocks import self_pairs
from ..plans.groups import PairTable, compact, copies, value_groups
from ..plans.settings import cut_lineage
from ..sources.records import as_text, validate
from .edit import _edit_pairs, constant_pairs


def phonetic_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rid, c0, c1, ...``: the code of each column."""
    return df.select("rid", *[metaphone(as_text(c)).alias(f"c{i}") for i, c in enumerate(cols)])


def metaphone_pairs(
    df: DataFrame, cols: Sequence[str], weights: dict[str, float] | None = None,
    min_similarity: float | None = None, bdv: str | None = None,
) -> PairTable:
    """Weighted mean of the edit similarity of phonetic codes.

    Records with equal codes form one group, so the comparison runs over
    distinct codes, of which there are far fewer than texts.
    """
    validate(df, bdv, cols)
    weights = weights or {}
    used = [(c, float(weights.get(c, 1.0))) for c in cols if float(weights.get(c, 1.0)) != 0]
    if not used:
        return constant_pairs(df, min_similarity)
    # Coding costs far more than a join: each distinct combination of texts is coded once.
    texts = [f"t{i}" for i in range(len(used))]
    groups, members = value_groups(df.select("rid", *[as_text(c).alias(t) for t, (c, _) in zip(texts, used)]), texts)
    coded = cut_lineage(groups.select("gid", *[metaphone(t).alias(f"c{i}") for i, t in enumerate(texts)]))
    keyed = members.join(coded, "gid").drop("gid")
    return _edit_pairs(keyed, [f"c{i}" for i in range(len(used))], [w for _, w in used], min_similarity)


def phonetic_candidates(df: DataFrame, col: str) -> PairTable:
    """Pairs with the same phonetic code, as pairs of distinct texts.

    ``similarity`` is 100 throughout. Copies of one text stay one group.
    """
    validate(df, None, [col])
    groups, members = value_groups(df.select("rid", as_text(col).alias("c0")), ["c0"])
    coded = groups.select("gid", "n", metaphone("c0").alias("code"))
    pairs = compact(self_pairs(coded, ["code"], "gid"), F.lit(100.0))
    return PairTable(pairs, members, copies(groups, F.lit(100.0)))
