"""Vector method: text and number columns as one vector per record."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import clip_nonneg, words
from ..plans.blocks import hot_keys
from ..plans.groups import PairTable, value_groups
from ..plans.metric import Placed, bounds, near_pairs, place
from ..plans.sparse import cosine_pairs, least_cosine, sparse_vectors
from ..plans.settings import VECTOR_BLOCK_ROWS, conf_int, cut_lineage, shuffle_width
from ..plans.tiles import METRICS, matrix, strip_distances, unit
from ..sources.records import as_text, validate

_STRIP = 256  # vectors measured at once inside a bucket


def text_vectors(
    df: DataFrame, cols: Sequence[str], encoder: str | Callable[[Column], Column] = "tfidf", dims: int | None = None
) -> DataFrame:
    """``df`` with one vector column ``vec_<col>`` per text column.

    An array column is taken as it is. Texts go through ``encoder``: a function from a
    text column to an array column, such as a ``pandas_udf`` around a model, or
    ``"tfidf"``: term counts times inverse document frequency, folded into ``dims``
    places, which words share. :func:`embedding_pairs` compares texts by all their
    words and needs no such places.
    """
    for c in cols:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.withColumn(f"vec_{c}", F.col(c).cast("array<double>"))
        elif callable(encoder):
            df = df.withColumn(f"vec_{c}", encoder(as_text(c)).cast("array<double>"))
        elif encoder == "tfidf":
            if dims is None:
                raise ValueError("a dense vector of a text needs a number of places (dims) or an encoder")
            counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(
                df.withColumn("_w", words(as_text(c)))
            )
            scaled = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
            df = scaled.withColumn(f"vec_{c}", vector_to_array("_idf")).drop("_w", "_tf", "_idf")
        else:
            raise ValueError(f"Unsupported encoder: {encoder}")
    return df


def column_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``mean_<col>, std_<col>``; the deviation is that of the population."""
    out = []
    for c in cols:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        out += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
    return df.agg(*out)


def scaled_numerics(df: DataFrame, cols: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``scaled_<col>``: missing as 0, standardised, times the weight.

    A constant column becomes 0.
    """
    weights = weights or {}
    m = column_moments(df, cols).first()
    out = []
    for c in cols:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        mean, std = m[f"mean_{c}"] or 0.0, m[f"std_{c}"] or 0.0
        scaled = (x - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
        out.append((scaled * F.lit(float(weights.get(c, 1.0)))).alias(f"scaled_{c}"))
    return df.select("*", *out)


def combine_vectors(df: DataFrame, blocks: dict[str, float], numerics: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``vec``: weighted vector columns, then number columns."""
    def weighted(c: str, w: float) -> Column:
        return F.transform(F.col(c), lambda x: x * F.lit(float(w)))

    parts = [weighted(c, w) for c, w in blocks.items()]
    if numerics:
        parts.append(F.array(*[F.col(c) for c in numerics]))
    if not parts:
        raise ValueError("an embedding needs a vector, text or number column")
    return df.withColumn("vec", F.concat(*parts) if len(parts) > 1 else parts[0])


def record_vectors(
    df: DataFrame, vec_cols: Sequence[str] = (), numeric_cols: Sequence[str] = (),
    weights: dict[str, float] | None = None, encoder="tfidf", dims: int | None = None,
) -> DataFrame:
    """``rid, vec``: the combined vector of each record."""
    if not list(vec_cols) and not list(numeric_cols):
        raise ValueError("an embedding needs a vector, text or number column")
    weights = weights or {}
    rows = text_vectors(df, vec_cols, encoder, dims)
    if numeric_cols:
        rows = scaled_numerics(rows, numeric_cols, weights)
    blocks = {f"vec_{c}": weights.get(c, 1.0) for c in vec_cols}
    return combine_vectors(rows, blocks, [f"scaled_{c}" for c in numeric_cols]).select("rid", "vec")


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, known are {METRICS}")


def own_distance(metric: str) -> Column:
    """Distance between two copies of ``vec``: 0, but 1 for zero vectors by cosine."""
    if metric != "cosine":
        return F.lit(0.0)
    return F.when(F.exists("vec", lambda x: x != 0), F.lit(0.0)).otherwise(F.lit(1.0))


def pair_distance(vectors: DataFrame, metric: str = "cosine", max_distance: float = float("inf")) -> DataFrame:
    """``rid_l, rid_r, distance`` of all pairs up to ``max_distance``."""
    _check(metric)
    rows = vectors.select(F.col("rid").alias("gid"), F.lit(1).cast("bigint").alias("n"), "vec")
    found = near_pairs(place(rows, metric, rows.count()), max_distance)
    return found.select(F.col("gid_l").alias("rid_l"), F.col("gid_r").alias("rid_r"), "distance")


def distance_bounds(distances: DataFrame) -> DataFrame:
    """One row ``min_distance, max_distance``.

    The least covers the whole matrix, so its zero diagonal counts.
    """
    return distances.agg(
        F.least(F.min("distance"), F.lit(0.0)).alias("min_distance"), F.max("distance").alias("max_distance")
    )


def vector_bounds(
    vectors: DataFrame, metric: str = "cosine", groups: DataFrame | None = None, placed: Placed | None = None
) -> DataFrame:
    """The bounds of :func:`distance_bounds` without writing out any pair.

    ``negative`` counts the pairs of records with a distance below zero, ``lowest``
    is the least distance of two records. ``groups`` are the vectors'
    :func:`value_groups` where they are at hand, ``placed`` their blocks.
    """
    _check(metric)
    if groups is None:
        groups, _ = value_groups(vectors.select("rid", "vec"), ["vec"])
    placed = placed or place(groups, metric, groups.count())
    same = groups.where("n > 1").agg(F.max(own_distance(metric)).alias("inside"), F.min(own_distance(metric)).alias("within"))
    both = bounds(placed).withColumn("k", F.lit(1)).join(same.withColumn("k", F.lit(1)), "k")
    return both.select(
        F.least("low", F.lit(0.0)).alias("min_distance"),
        F.greatest("high", "inside").alias("max_distance"), F.coalesce("negative", F.lit(0)).alias("negative"),
        F.least("low", "within").alias("lowest"),
    )


def negative_vector_report(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """:func:`negative_distance_report` over all pairs of records, without writing out any."""
    records = vectors.agg(F.count(F.lit(1)).alias("records")).withColumn("k", F.lit(1))
    found = vector_bounds(vectors, metric).withColumn("k", F.lit(1)).join(records, "k")
    pairs = (F.col("records") * (F.col("records") - 1) / 2).cast("bigint")
    return found.select(pairs.alias("pairs"), "lowest", "negative", (F.col("negative") > 0).alias("any_negative"))


def negative_distances(distances: DataFrame) -> DataFrame:
    """The pairs with a distance below zero (rounding can cause them)."""
    return distances.where("distance < 0")


def negative_distance_report(distances: DataFrame) -> DataFrame:
    """One row ``pairs, lowest, negative, any_negative``: is a distance below zero, and how many are?"""
    return distances.agg(
        F.count(F.lit(1)).alias("pairs"), F.min("distance").alias("lowest"),
        F.count_if(F.col("distance") < 0).alias("negative"), F.coalesce(F.bool_or(F.col("distance") < 0), F.lit(False)).alias("any_negative"),
    )


def embedding_pairs(
    df: DataFrame, vec_cols: Sequence[str] = (), numeric_cols: Sequence[str] = (),
    weights: dict[str, float] | None = None, metric: str = "cosine", min_similarity: float | None = None,
    max_distance: float | str = "global", encoder="tfidf", dims: int | None = None, bdv: str | None = None,
) -> PairTable:
    """Similarity ``(1 - d / max_d) * 100`` of combined vectors.

    ``max_d`` is the largest distance among the records, or a given number. Blocks of
    vectors that cannot hold the farthest pair, or one at ``min_similarity``, are not
    compared (``plans/metric.py``). Texts are TF-IDF vectors over their whole
    vocabulary, joined as such (``plans/sparse.py``), unless ``encoder`` or ``dims``
    makes dense vectors of them; that join knows cosine, texts and numbers.
    """
    validate(df, bdv, [*vec_cols, *numeric_cols])
    _check(metric)
    texts = [c for c in vec_cols if not isinstance(df.schema[c].dataType, T.ArrayType)]
    if texts and encoder == "tfidf" and dims is None:
        if metric != "cosine" or len(texts) < len(vec_cols):
            raise ValueError("texts are compared by cosine and without array columns; give dims or an encoder for dense vectors")
        return _term_pairs(df, texts, numeric_cols, weights or {}, min_similarity, max_distance)
    vectors = record_vectors(df, vec_cols, numeric_cols, weights, encoder, dims)
    groups, members = value_groups(vectors, ["vec"])
    placed = place(groups, metric, groups.count())
    if max_distance == "global":
        row = vector_bounds(vectors, metric, groups, placed).first()
        top = max(row["max_distance"] or 0.0, 0.0) if row else 0.0
    else:
        top = float(max_distance)
    cutoff = float("inf") if min_similarity is None else (1 - min_similarity / 100) * top + 1e-12
    similarity = F.lit(100.0) if top == 0 else (F.lit(1.0) - clip_nonneg("distance") / F.lit(top)) * 100
    inside = groups.where("n > 1").select(
        F.col("gid").alias("gid_l"), F.col("gid").alias("gid_r"), own_distance(metric).alias("distance"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"),
    )
    found = near_pairs(placed, cutoff).withColumn("n_pairs", F.col("n_l") * F.col("n_r"))
    scored = lambda rows: rows.select("gid_l", "gid_r", "n_pairs", similarity.alias("similarity"))
    table = PairTable(scored(found), members, scored(inside), {"vectors": vectors})
    return table if min_similarity is None else table.at_least(min_similarity)


def _term_pairs(df, texts, numeric_cols, weights, min_similarity, max_distance) -> PairTable:
    """:func:`embedding_pairs` by cosine over all words of the texts, and numbers."""
    rows = scaled_numerics(df, numeric_cols, weights) if numeric_cols else df
    numbers = [f"scaled_{c}" for c in numeric_cols]
    keyed = rows.select("rid", *[as_text(c).alias(c) for c in texts], *numbers)
    groups, members = value_groups(keyed, [*texts, *numbers])
    size, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    vectors = sparse_vectors(groups, {c: float(weights.get(c, 1.0)) for c in texts}, numbers, total)
    own = F.when(F.exists("w", lambda x: x != 0), F.lit(0.0)).otherwise(F.lit(1.0))
    inside = vectors.where("n > 1").select("gid", "n", own.alias("distance"))
    if max_distance == "global":
        lowest = least_cosine(vectors, size, several=len(numbers) > 1)
        within = inside.agg(F.max("distance")).first()[0]
        top = max(0.0, within or 0.0, 0.0 if lowest is None else 1.0 - lowest)
    else:
        top = float(max_distance)
    similarity = F.lit(100.0) if top == 0 else (F.lit(1.0) - clip_nonneg("distance") / F.lit(top)) * 100
    least = -2.0 if min_similarity is None else 1.0 - (1 - min_similarity / 100) * top - 1e-12
    found = cosine_pairs(vectors, least, size).withColumn("distance", F.lit(1.0) - F.col("dot"))
    across = found.select("gid_l", "gid_r", (F.col("n_l") * F.col("n_r")).alias("n_pairs"), similarity.alias("similarity"))
    copies = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs")
    inside = inside.select(F.col("gid").alias("gid_l"), F.col("gid").alias("gid_r"), copies, similarity.alias("similarity"))
    table = PairTable(across, members, inside, {"vectors": vectors})
    return table if min_similarity is None else table.at_least(min_similarity)


def ann_pairs(
    vectors: DataFrame, metric: str = "euclidean", max_distance: float = 0.5,
    tables: int = 6, bits: int | None = None, probes: int = 12, seed: int = 42,
) -> DataFrame:
    """Approximate ``rid_l, rid_r, distance`` up to ``max_distance``, by random hyperplanes.

    In each table a vector's key says on which side of ``bits`` hyperplanes through the
    mean it lies. A vector is looked for under its own key and under the ``probes - 1``
    others that lie nearest across the hyperplanes (multi-probe, by margin). Buckets
    are counted, large ones compared in blocks, and all pairs found are measured. Some
    pairs can be missed: :func:`ann_recall` says how many; :func:`pair_distance` misses
    none. ``bits`` is such that a bucket holds some 64 vectors, 5 at least.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}, known are cosine and euclidean")
    rows = cut_lineage(vectors.select("rid", F.col("vec").cast("array<double>").alias("vec"), F.monotonically_increasing_id().alias("_u")))
    placed = hyperplane_keys(rows.select(F.col("_u").alias("rid"), "vec"), tables, bits, probes, seed).withColumnRenamed("rid", "_u")
    keys = ["table", "key"]
    # Vectors come to their buckets and are measured there: few of those that meet are close.
    kept = placed.join(rows.where("rid is not null"), "_u")  # ids may repeat, ``_u`` does not
    limit = conf_int(rows.sparkSession, "vectorBlockRows", VECTOR_BLOCK_ROWS)
    hot = hot_keys(placed, keys, limit)
    if hot is None:
        sides = kept.withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    else:  # a bucket's own vectors and those that look for them, each cut into blocks
        cut = kept.join(hot, keys, "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
        at, every = F.pmod(F.xxhash64("_u"), F.col("_b")).cast("int"), F.sequence(F.lit(0), F.col("_b") - 1)
        here = F.when(F.col("own"), F.transform(every, lambda i: F.struct(i.alias("_i"), at.alias("_j"), F.lit(True).alias("_holds")))).otherwise(
            F.array().cast("array<struct<_i:int,_j:int,_holds:boolean>>"))
        asks = F.transform(every, lambda j: F.struct(at.alias("_i"), j.alias("_j"), F.lit(False).alias("_holds")))
        sides = cut.select("rid", "vec", "_u", *keys, F.inline(F.concat(here, asks)))
    split = hot is not None

    def measure(table: pa.Table) -> pa.Table:
        m, rid, row = matrix(table), table.column("rid").to_numpy(), table.column("_u").to_numpy()
        m = unit(m) if metric == "cosine" else m
        if split:
            holds = np.flatnonzero(table.column("_holds").to_numpy(zero_copy_only=False))
            asks = np.flatnonzero(~table.column("_holds").to_numpy(zero_copy_only=False))
        else:  # each vector of the bucket looks for its own ones, itself among them
            holds, asks = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False)), np.arange(len(m))
        out = [[], [], [], [], []]
        for at in range(0, len(asks) if len(holds) else 0, _STRIP):
            part = asks[at: at + _STRIP]
            x, y = np.nonzero(strip_distances(m[part], m[holds], metric) <= max_distance + 1e-6 * (1 + max_distance))
            a, b = part[x], holds[y]
            a, b = a[rid[a] != rid[b]], b[rid[a] != rid[b]]
            a, b = np.where(rid[a] < rid[b], a, b), np.where(rid[a] < rid[b], b, a)
            d = 1.0 - (m[a] * m[b]).sum(axis=1) if metric == "cosine" else np.sqrt(((m[a] - m[b]) ** 2).sum(axis=1))
            for col, v in zip(out, (rid[a], rid[b], row[a], row[b], d)):
                col.append(v)
        cols = [np.concatenate(c) if c else np.array([]) for c in out]
        names, kinds = ("rid_l", "rid_r", "_l", "_r", "distance"), (pa.int64(),) * 4 + (pa.float64(),)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, cols, kinds)})

    width = shuffle_width(rows.sparkSession)
    measured = sides.repartition(width, *keys, "_i", "_j").groupBy(*keys, "_i", "_j").applyInArrow(
        measure, "rid_l bigint, rid_r bigint, _l bigint, _r bigint, distance double")
    once = measured.where(F.col("distance") <= max_distance).groupBy("rid_l", "rid_r", "_l", "_r").agg(F.min("distance").alias("distance"))
    return once.select("rid_l", "rid_r", "distance")


def hyperplane_keys(rows: DataFrame, tables: int, bits: int | None, probes: int, seed: int) -> DataFrame:
    """``rid, table, key, own``: the buckets in which each vector is looked for; ``own`` is where it lies."""
    size = rows.count()
    bits = bits or max(5, min(24, (size // 64).bit_length()))
    means = [r["m"] for r in rows.select(F.posexplode("vec").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("m")).orderBy("place").collect()]
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, len(means)))
    planes /= np.sqrt((planes ** 2).sum(axis=2, keepdims=True)) if means else 1.0
    offset = planes @ np.array(means)
    moved = min(bits, 8)  # hyperplanes of the least margin that a probe may cross
    flips = (np.arange(1 << moved)[:, None] >> np.arange(moved)) & 1
    probes = min(probes, len(flips))

    def key(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, rid = matrix(pa.Table.from_batches([batch])), batch.column("rid")
            for t in range(tables):
                margin = m @ planes[t].T - offset[t]
                own = ((margin > 0) << np.arange(bits)).sum(axis=1)
                near = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :moved]
                cost = np.take_along_axis(np.abs(margin), near, axis=1) ** 2 @ flips.T
                taken = np.argsort(cost, axis=1, kind="stable")[:, :probes]  # the first crosses nothing
                crossed = (flips[taken] << near[:, None, :]).sum(axis=2)
                keys = own[:, None] ^ crossed
                yield pa.RecordBatch.from_arrays(
                    [rid.take(pa.array(np.repeat(np.arange(len(m)), probes))), pa.array(np.full(keys.size, t), pa.int32()),
                     pa.array(keys.ravel().astype(np.int64)), pa.array(np.tile(np.arange(probes) == 0, len(m)))],
                    names=["rid", "table", "key", "own"])

    return cut_lineage(rows.mapInArrow(key, "rid bigint, table int, key bigint, own boolean"))


def ann_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``exact, found, recall`` for pairs ``rid_l, rid_r`` of an approximate and a full search."""
    both = exact.select("rid_l", "rid_r").join(found.select("rid_l", "rid_r", F.lit(1).alias("hit")), ["rid_l", "rid_r"], "left")
    row = both.agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))
    return row.withColumn("recall", F.when(F.col("exact") > 0, F.col("found") / F.col("exact")).otherwise(F.lit(1.0)))
