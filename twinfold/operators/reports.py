"""Reports over pair tables.

A report takes a :class:`PairTable` or any DataFrame with the same columns. Counts
use ``n_pairs`` where it is present, so copies never have to be written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.groups import PairTable
from ..plans.ranks import with_rank
from ..plans.settings import cut_lineage
from ..sources.records import as_text, validate


def _rows(pairs: PairTable | DataFrame) -> DataFrame:
    return pairs.pairs if isinstance(pairs, PairTable) else pairs


def _record_rows(pairs: PairTable | DataFrame) -> DataFrame:
    return pairs.records() if isinstance(pairs, PairTable) else pairs


def _ends(rows: DataFrame) -> tuple[str, str]:
    for l, r in (("rid_l", "rid_r"), ("gid_l", "gid_r"), ("Record 1", "Record 2"), ("source", "target")):
        if l in rows.columns:
            return l, r
    raise ValueError("no pair columns found")


def attach_records(pairs: PairTable | DataFrame, records: DataFrame, cols: list[str]) -> DataFrame:
    """Record pairs with ``<col>_l`` and ``<col>_r`` looked up by ``rid``."""
    out = _record_rows(pairs)
    wanted = records.select("rid", *cols)
    for s in "lr":
        out = out.join(wanted.select(*[F.col(c).alias(f"{c}_{s}") for c in wanted.columns]), f"rid_{s}")
    return out


def to_report(pairs: PairTable | DataFrame, records: DataFrame, bdv: str) -> DataFrame:
    """``Record 1, Record 2, Similarity (%)`` with labels ``"<bdv> (<id>)"``."""
    validate(records, bdv)
    shown = records["id"] if "id" in records.columns else records["rid"]
    label = F.format_string("%s (%s)", as_text(records[bdv]), shown.cast("string")).alias("label")
    labelled = records.select("rid", label)
    return attach_records(pairs, labelled, ["label"]).select(
        F.col("label_l").alias("Record 1"), F.col("label_r").alias("Record 2"),
        F.col("similarity").alias("Similarity (%)"),
    )


def filter_pairs(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs at or above a similarity; a missing score never passes."""
    return pairs.where(F.col("similarity") >= min_similarity)


def _order(rows: DataFrame):
    l, r = _ends(rows)
    score = "Similarity (%)" if "Similarity (%)" in rows.columns else "similarity"
    return [F.desc_nulls_last(F.col(f"`{score}`")), F.col(f"`{l}`"), F.col(f"`{r}`")]


def rank_pairs(pairs: PairTable | DataFrame) -> DataFrame:
    """Most similar first; ties by position, missing scores last."""
    rows = _rows(pairs)
    return rows.orderBy(*_order(rows))


def ranked_pairs(pairs: PairTable | DataFrame) -> DataFrame:
    """The rows with their ``rank`` in that order, 1 first; no task sorts all of them."""
    rows = _rows(pairs)
    return with_rank(rows, _order(rows))


def top_pairs(pairs: PairTable | DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the ranking; each task keeps only ``n`` rows.

    For a :class:`PairTable` these are pairs of records. A group's id is its least
    record, so the first records of the pairs ``n`` first by group ids are before any of
    the other groups; and of each group only its ``n + 1`` first records can be among
    them, so a large group of copies is not written out.
    """
    if not isinstance(pairs, PairTable):
        return rank_pairs(pairs).limit(n)
    return _top_records(_top_groups(pairs, n), n)


def _top_groups(pairs: PairTable, n: int) -> PairTable:
    """The pairs of groups that can hold the first ``n`` pairs of records, from one look at all pairs."""
    kinds = [pairs.across] + ([] if pairs.inside is None else [pairs.inside])
    best = [cut_lineage(rank_pairs(kind).limit(n)) for kind in kinds]
    return PairTable(best[0], pairs.members, best[1] if len(best) > 1 else None, pairs.artifacts)


def _top_records(found: PairTable, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("gid").orderBy("rid"))
    needed = found.pairs.select(F.explode(F.array("gid_l", "gid_r")).alias("gid")).distinct()  # 4 n groups at most
    first = found.members.join(needed, "gid", "left_semi").withColumn("_at", place).where(F.col("_at") <= n + 1).drop("_at")
    return rank_pairs(PairTable(found.across, first, found.inside).records()).limit(n)


def closest_pairs(compare: Callable[[float | None], PairTable], n: int, start: float = 95.0) -> DataFrame:
    """:func:`top_pairs` of a full comparison, without making one where a threshold will do.

    ``compare`` returns the pairs at a threshold or above, or all for None. The
    threshold falls, by doubled distances from 100, until ``n`` pairs are at it or
    above: no pair below can then be among the first ``n``.
    """
    least = start
    while True:
        found = _top_groups(compare(least), n)
        if least is None or (found.pairs.agg(F.sum("n_pairs")).first()[0] or 0) >= n:
            return _top_records(found, n)
        least = 100 - 2 * (100 - least) if least > 50 else None


def record_universe(pairs: PairTable | DataFrame) -> DataFrame:
    """Every record that appears in a pair, once."""
    if isinstance(pairs, PairTable):
        inside = pairs.pairs.select(F.explode(F.array("gid_l", "gid_r")).alias("gid")).distinct()
        return pairs.members.join(inside, "gid", "left_semi").select("rid")
    l, r = _ends(pairs)
    return pairs.select(F.explode(F.array(F.col(f"`{l}`"), F.col(f"`{r}`"))).alias("record")).distinct()


def similarity_histogram(pairs: PairTable | DataFrame, bins: int = 50) -> DataFrame:
    """``bin, low, high, pairs`` over equal bins of 0..100; 100 is in the last bin."""
    rows = _rows(pairs).where("similarity is not null")
    weight = F.col("n_pairs") if "n_pairs" in rows.columns else F.lit(1)
    at = F.floor(F.col("similarity") * bins / 100).cast("int")
    counted = rows.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(
        F.sum(weight).cast("bigint").alias("pairs")
    )
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = 100.0 / bins
    return grid.join(counted, "bin", "left").select(
        "bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
    )


def similarity_matrix(pairs: PairTable | DataFrame, long: bool = True) -> DataFrame:
    """Similarity by row record and column record.

    The long form ``row, col, similarity`` holds the filled cells; all other
    cells of the square over :func:`record_universe` are blank. The wide form is
    the square itself, one column per record, and is refused above Spark's
    ``spark.sql.pivotMaxValues``.
    """
    rows = _rows(pairs)
    l, r = _ends(rows)
    score = "Similarity (%)" if "Similarity (%)" in rows.columns else "similarity"
    cells = rows.select(
        F.col(f"`{l}`").alias("row"), F.col(f"`{r}`").alias("col"), F.col(f"`{score}`").alias("similarity")
    )
    if long:
        return cells
    most = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = cells.select(F.explode(F.array("row", "col")).alias("row")).distinct()
    found = [x["row"] for x in names.orderBy("row").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} records: use the long form")
    wide = cells.groupBy("row").pivot("col", found).agg(F.first("similarity"))
    return names.join(wide, "row", "left")


def similarity_edges(pairs: PairTable | DataFrame, threshold: float = 80.0) -> DataFrame:
    """``source, target, weight`` of pairs at or above the threshold."""
    rows = filter_pairs(_rows(pairs), threshold)
    l, r = _ends(rows)
    extra = ["n_pairs"] if "n_pairs" in rows.columns else []
    return rows.select(F.col(l).alias("source"), F.col(r).alias("target"), F.col("similarity").alias("weight"), *extra)


def similarity_nodes(edges: DataFrame) -> DataFrame:
    """``node, degree`` of the endpoints; records without an edge are absent."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def record_degrees(pairs: PairTable, threshold: float = 80.0) -> DataFrame:
    """``rid, degree`` of the record graph, from group sizes instead of record pairs."""
    sizes = pairs.members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    across = filter_pairs(pairs.across, threshold)
    to = across.select(F.col("gid_l").alias("node"), F.col("gid_r").alias("gid")).union(
        across.select("gid_r", "gid_l")
    )
    to = to.join(sizes, "gid").groupBy("node").agg(F.sum("size").alias("d"))
    copies = across.limit(0) if pairs.inside is None else filter_pairs(pairs.inside, threshold)
    own = copies.select(F.col("gid_l").alias("node")).join(
        sizes.withColumnRenamed("gid", "node"), "node"
    ).select("node", (F.col("size") - 1).alias("d"))
    total = to.unionByName(own).groupBy("node").agg(F.sum("d").alias("degree")).withColumnRenamed("node", "gid")
    return pairs.members.join(total, "gid").where("degree > 0").select("rid", "degree")
