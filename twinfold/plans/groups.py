"""Groups of equal records, and the compact pair table over them.

All scores depend only on the compared values, so records with equal values are
scored once. A pair row then stands for ``n_pairs`` record pairs, and a group of
copies holding a third of the table costs one row instead of a quadratic number.
Nothing is lost: ``PairTable.records`` writes the same pairs out one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import self_pairs
from .settings import cut_lineage


@dataclass
class PairTable:
    """Scored pairs of groups, and which records each group holds.

    ``across``: ``gid_l, gid_r, n_pairs, similarity`` with ``gid_l < gid_r``.
    ``inside``: the same columns with equal ids, for the pairs among the copies
    of one group. ``members``: ``gid, rid``. A group id is the smallest ``rid`` in
    the group.
    """

    across: DataFrame
    members: DataFrame
    inside: DataFrame | None = None
    artifacts: dict = field(default_factory=dict)

    @property
    def pairs(self) -> DataFrame:
        """Both kinds of pair rows."""
        return self.across if self.inside is None else self.across.unionByName(self.inside)

    def records(self) -> DataFrame:
        """Pairs of records ``rid_l, rid_r, similarity`` with ``rid_l < rid_r``."""
        a = self.members.select(F.col("gid").alias("gid_l"), F.col("rid").alias("_a"))
        b = self.members.select(F.col("gid").alias("gid_r"), F.col("rid").alias("_b"))
        singly = (
            self.across.join(a, "gid_l").join(b, "gid_r")
            .select(F.least("_a", "_b").alias("rid_l"), F.greatest("_a", "_b").alias("rid_r"), "similarity")
        )
        if self.inside is None:
            return singly
        same = self.inside.select(F.col("gid_l").alias("gid"), "similarity")
        copies = self_pairs(self.members.join(same, "gid"), ["gid"], "rid")
        return singly.unionByName(copies.select("rid_l", "rid_r", F.col("similarity_l").alias("similarity")))

    def at_least(self, min_similarity: float) -> "PairTable":
        passing = F.col("similarity") >= min_similarity
        inside = None if self.inside is None else self.inside.where(passing)
        return PairTable(self.across.where(passing), self.members, inside, self.artifacts)


def null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def value_groups(keyed: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(groups, members)`` of a table ``rid, cols...``.

    Grouping combines copies before the shuffle, so a hot value sends one row
    per task. The groups are written out once, as every later step reads them.
    """
    groups = cut_lineage(keyed.groupBy(*cols).agg(F.min("rid").alias("gid"), F.count(F.lit(1)).alias("n")))
    ids = groups.select("gid", *cols)
    members = keyed.join(ids, null_safe(keyed, ids, cols)).select("gid", "rid")
    return groups, members


def single_groups(keyed: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Every record its own group, for scores that depend on the record order."""
    groups = cut_lineage(keyed.select(*cols, F.col("rid").alias("gid"), F.lit(1).cast("bigint").alias("n")))
    return groups, keyed.select(F.col("rid").alias("gid"), "rid")


def compact(joined: DataFrame, similarity: Column) -> DataFrame:
    """Rows with ``gid_l, n_l, gid_r, n_r`` as pair rows."""
    return joined.select(
        "gid_l", "gid_r",
        (F.col("n_l") * F.col("n_r")).alias("n_pairs"),
        similarity.cast("double").alias("similarity"),
    )


def copies(groups: DataFrame, similarity: Column) -> DataFrame:
    """The pairs among the copies of each group, as one row per group."""
    return groups.where("n > 1").select(
        F.col("gid").alias("gid_l"), F.col("gid").alias("gid_r"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"),
        similarity.cast("double").alias("similarity"),
    )


def all_pairs(df: DataFrame, id_col: str = "rid", keep=None, size: int | None = None) -> DataFrame:
    """Each unordered pair of rows once, as a join of balanced tiles.

    The output is quadratic by definition; the methods call it on groups of
    distinct values, and only where no threshold allows pruning.
    """
    return self_pairs(df, [], id_col, keep=keep, size=df.count() if size is None else size)


def cardinalities(groups: DataFrame, cols: Sequence[str]) -> list[int]:
    """About how many values each column holds, from one pass; guides plans only."""
    if len(cols) == 1:
        return [groups.count()]
    row = groups.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    return [int(row[c]) for c in cols]


def distinct_value_pairs(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(groups, members, pairs)`` where pairs are all pairs of distinct values."""
    groups, members = value_groups(df.select("rid", *cols), cols)
    return groups, members, all_pairs(groups, "gid")
