"""Near-copies of embeddings with an inverted multi-index.

Vectors of length one are cut into halves, each half has a codebook of its own, and
the pairs of codewords form a grid of cells (Babenko and Lempitsky 2012). All
vectors are indexed by cell. A query visits cells in the order of a lower bound of
its distance to anything in them, from the two halves' sorted lists (multi-sequence
traversal), until the target recall is reached. The bound is the distance to the
border between a codeword's region and the query's own. Where to stop is learned:
sampled vectors get neighbours at exactly the cosine sought, in random directions, and
the stop is the bound that takes in ``TARGET_RECALL`` of them; closer pairs are found
more surely still. With a target of 1 the stop is the distance of that cosine itself,
which loses none. Pairs in visited cells are verified in double precision, a block of
queries against a block of vectors at a time.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import Scratch, below, map_batches

MIN_COSINE = 0.98
CODEWORDS = 32  # per half, at least; with more vectors their root, so that a cell holds some CELL_ROWS
MOST_CODEWORDS = 1024
CELL_ROWS = 256
TARGET_RECALL = 0.9999
SAMPLE_ROWS = 20_000  # vectors that the codebooks are fitted on, about; all are indexed
BLOCK = 1024  # vectors per side of one comparison
_SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def codewords(size: int) -> int:
    """Codewords of a half for an index of ``size`` vectors."""
    return max(CODEWORDS, min(MOST_CODEWORDS, math.ceil(math.sqrt(size / CELL_ROWS))))


def fit_codebook(m: np.ndarray, k: int = CODEWORDS, rounds: int = 10) -> np.ndarray:
    """Codewords by k-means from evenly spaced distinct rows; no more than there are rows."""
    rows = np.unique(m, axis=0)
    words = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(m, words).argmin(axis=1)
        size = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, m)
        words[size > 0] = total[size > 0] / size[size > 0, None]
    return np.unique(words, axis=0)


def _squares(m: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((m * m).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * m @ words.T, 0)


def border_bounds(m: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each row, and the squared distance from it to each codeword's region, at least."""
    d = _squares(m, words)
    own = d.argmin(axis=1)
    apart = np.sqrt(_squares(words, words))[own]
    gap = (d - d[np.arange(len(m)), own][:, None]) / (2 * np.where(apart > 0, apart, np.inf))
    return own, np.maximum(gap - _SLACK, 0) ** 2


def stop_bound(m: np.ndarray, one: np.ndarray, two: np.ndarray, min_cosine: float, target: float) -> float:
    """Bound up to which cells are visited, from simulated neighbours of unit vectors."""
    farthest = 2 - 2 * min_cosine + _SLACK
    if target >= 1 or m.shape[1] < 2:
        return farthest
    aside = np.random.default_rng(0).normal(size=m.shape)
    aside = unit_rows(aside - (aside * m).sum(axis=1, keepdims=True) * m)
    near = min_cosine * m + np.sqrt(max(0.0, 1 - min_cosine ** 2)) * aside
    half, rows = m.shape[1] // 2, np.arange(len(m))
    low = sum(border_bounds(a, words)[1][rows, _squares(b, words).argmin(axis=1)]
              for a, b, words in ((m[:, :half], near[:, :half], one), (m[:, half:], near[:, half:], two)))
    return min(farthest, float(np.quantile(low, target, method="higher")) + _SLACK)


def visit(first: np.ndarray, second: np.ndarray, limit: float):
    """Cells ``(i, j)`` in ascending order of ``first[i] + second[j]`` up to ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap:
        bound, i, j = heappop(heap)
        if bound > limit:
            return
        yield int(a[i]), int(b[j])
        if j + 1 < len(b):
            heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


def _forest(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the links ``u[k], v[k]`` (places in ``ids``)."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = [], []
    for x, y in zip(u.tolist(), v.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out[0].append(int(ids[x]))
            out[1].append(int(ids[y]))
    return out


def _compare(table: pa.Table, min_cosine: float) -> pa.Table:
    """Links of one tile: how many vectors each row meets, and a forest of the links.

    Cells are visited upwards only, so a pair from two cells counts here for both."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    away = table.column("away").to_numpy(zero_copy_only=False)  # a query from another cell
    ids, copies, m = table.column("rep").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("vec"))
    norm = np.sqrt((m * m).sum(axis=1))
    q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
    node, links, to = [], [], []
    if len(q) and len(t):
        near = (m[q] @ m[t].T) / (norm[q][:, None] * norm[t][None, :]) >= min_cosine
        near &= ids[q][:, None] != ids[t][None, :]
        far = away[q]
        for own, found in ((q, near @ copies[t]), (t, near[far].T @ copies[q[far]])):
            some = np.flatnonzero(found)
            node, links, to = node + ids[own][some].tolist(), links + found[some].tolist(), to + [None] * len(some)
        names, place = np.unique(ids, return_inverse=True)
        x, y = np.nonzero(near)
        u, v = _forest(names, place[q[x]], place[t[y]])
        node, links, to = node + u, links + [0] * len(u), to + v
    return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "to": pa.array(to, pa.int64())})


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, target: float = TARGET_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row of ``vectors`` (vec_id, embedding, label).

    Linked are rows of the same label, not null, whose cosine is ``min_cosine`` or
    more. Vectors that are null, zero or of length 0, or hold null or non-finite
    values, link with nothing, nor do vectors of different length. Equal vectors are
    one in the index and counted as many. Rows that repeat a vec_id count as
    vectors of their own, in one component.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = rows.where("usable")
    heads = scratch.write(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    base = heads.select("label", "rep", "copies", F.col("embedding").alias("vec"), F.size("embedding").alias("dim"))
    kind = heads.schema["embedding"].dataType.simpleString()
    books = {}
    for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        picked = base.where(F.col("dim") == r["dim"]).where(below(F.col("rep"), F.lit(min(1.0, SAMPLE_ROWS / r["n"])))).select("vec").toArrow()
        m = unit_rows(_matrix(picked.column("vec"))) if picked.num_rows else np.eye(1, r["dim"])
        half = r["dim"] // 2
        k = codewords(r["n"])
        one, two = fit_codebook(m[:, :half], k) if half else np.zeros((1, 0)), fit_codebook(m[:, half:], k)
        books[r["dim"]] = one, two, stop_bound(m, one, two, min_cosine, target)
    shared = spark.sparkContext.broadcast(books)  # MOST_CODEWORDS rows per half and dimension, at most

    def place(batch):
        dims, vecs = np.array(batch.column("dim").to_pylist()), batch.column("vec")
        cells, seen = np.zeros(len(dims), np.int64), [None] * len(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            m = unit_rows(_matrix(vecs.take(pa.array(at))))
            one, two, limit = shared.value[int(dim)]
            own1, low1 = border_bounds(m[:, :dim // 2], one)
            own2, low2 = border_bounds(m[:, dim // 2:], two)
            cells[at] = own1 * len(two) + own2
            for k, i in enumerate(at):
                seen[i] = [c for c in (x * len(two) + y for x, y in visit(low1[k], low2[k], limit)) if c >= cells[i]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("rep"), batch.column("copies"), vecs, batch.column("dim"), pa.array(cells), pa.array(seen, pa.list_(pa.int64()))],
            names=["label", "rep", "copies", "vec", "dim", "cell", "visits"])

    placed = scratch.write(map_batches(base, place, f"label bigint, rep bigint, copies bigint, vec {kind}, dim int, cell bigint, visits array<bigint>"))
    key = ["label", "dim", "cell"]
    index = placed.select(*key, "rep", "copies", "vec")
    probes = placed.select("label", "dim", F.col("cell").alias("own"), F.explode("visits").alias("cell"), "rep", "copies", "vec")
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(probes.groupBy(*key).agg(F.count(F.lit(1)).alias("asked")), key)
    sizes = scratch.write(sizes.select(*key, F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("asked") / BLOCK).alias("rounds")))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    index = index.join(sizes, key).withColumn("b", deal("blocks")).withColumn("p", every("rounds"))
    probes = probes.join(sizes, key).withColumn("p", deal("rounds")).withColumn("b", every("blocks"))
    tiles = index.withColumn("asks", F.lit(False)).withColumn("away", F.lit(False)).unionByName(
        probes.withColumn("asks", F.lit(True)).withColumn("away", F.col("own") != F.col("cell")).drop("own"))
    found = tiles.select(*key, "b", "p", "rep", "copies", "vec", "asks", "away").groupBy(*key, "b", "p").applyInArrow(
        lambda tile: _compare(tile, min_cosine), "node bigint, links bigint, to bigint")
    found = scratch.write(found)
    counts = found.where("to IS NULL").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    # Equal vec_ids under different vectors meet here through the id itself.
    roots = components(found.where("to IS NOT NULL").select(F.col("node").alias("u"), F.col("to").alias("v")))
    known = heads.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("component"))
    known = scratch.write(known)
    linked = usable.join(known, ["label", "embedding"]).select(
        "vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    scratch.drop(heads, placed, sizes, found)
    return linked.unionByName(alone)


def op2_near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept``."""
    return near_vectors(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(x, y) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.x = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = e.vec_id
"""
