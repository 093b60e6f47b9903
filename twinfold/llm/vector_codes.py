"""Vector code compression: product codes found by equal-average search.

Components become whole numbers, vectors are cut into equal parts, and each part
position has a codebook, improved by rounds of assignment and means. The nearest entry
of a part is searched in order of component sums: by Cauchy and Schwarz the squared
distance of two parts is at least the square of the gap of their sums over their
length, so the search goes outward from the part's own sum and ends when that bound
strictly exceeds the best distance. All parts of a batch search together in numpy.

A round reads the vectors once. Tasks send a row per entry and component; the driver
holds codebooks only.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_totals, map_batches

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def whole_numbers(column: pa.Array, dim: int, parts: int = PARTS) -> np.ndarray:
    """``(rows, parts, length)``: floor(SCALE * x), with zeros at the end up to a multiple of ``parts``.

    Numbers beyond 2**24 either way (2**20 above 64 components a part) become that limit."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    length = -(-dim // parts)
    limit = 1 << (24 if length <= 64 else 20)
    out = np.zeros((len(m), parts * length), np.int64)
    out[:, :dim] = np.clip(np.floor(SCALE * m), -limit, limit)
    return out.reshape(len(m), parts, length)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of ``book`` to each row of ``x``, its squared distance, and how many distances were taken.

    Of entries at the same distance the lowest index wins."""
    order = np.argsort(book.sum(axis=1), kind="stable")
    words, sums, own = book[order], book.sum(axis=1)[order], x.sum(axis=1)
    up = np.searchsorted(sums, own)
    down = up - 1
    far = np.iinfo(np.int64).max
    index, best = np.full(len(x), len(book)), np.full(len(x), far)
    live, taken = np.arange(len(x)), 0
    while True:
        above, below = up[live], down[live]
        rise = np.where(above < len(book), sums[np.minimum(above, len(book) - 1)] - own[live], far)
        fall = np.where(below >= 0, own[live] - sums[np.maximum(below, 0)], far)
        gap = np.minimum(rise, fall)
        # The bound gap ** 2 / length exceeds the best distance where its ceiling does.
        square = np.where(gap < far, gap, 0) ** 2
        goes_on = (gap < far) & (-(-square // max(1, x.shape[1])) <= best[live])
        live, rises = live[goes_on], (rise <= fall)[goes_on]
        if not len(live):
            return index, best, taken
        at = np.where(rises, up[live], down[live])
        d = ((x[live] - words[at]) ** 2).sum(axis=1)
        taken += len(live)
        better = (d < best[live]) | ((d == best[live]) & (order[at] < index[live]))
        best[live[better]], index[live[better]] = d[better], order[at][better]
        up[live[rises]] += 1
        down[live[~rises]] -= 1


def _by_dim(batch: pa.RecordBatch):
    """``(places in the batch, dimension, whole numbers)`` for each dimension in it."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield at, int(dim), whole_numbers(batch.column("embedding").take(pa.array(at)), int(dim))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding, dim`` of the rows whose vector is there and holds finite numbers only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding"))


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[int, np.ndarray]:
    """For each dimension the parts of the ``entries`` smallest vec_ids, as ``(part, entry, component)``."""
    books = {}
    for r in rows.select("dim").distinct().collect():
        order = [F.asc_nulls_last("vec_id"), "embedding", F.asc_nulls_last("label")]
        seed = rows.where(F.col("dim") == r["dim"]).orderBy(*order).limit(entries).select("embedding").collect()
        column = pa.array([s["embedding"] for s in seed], pa.list_(pa.float64()))
        books[r["dim"]] = whole_numbers(column, r["dim"]).transpose(1, 0, 2)
    return books


def improve(rows: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The books with each entry replaced by the floored mean of the parts it is nearest to; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # at most ENTRIES vectors a dimension

    def add_up(batches):
        total = {dim: (np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)) for dim, book in shared.value.items()}
        for batch in batches:
            for _, dim, x in _by_dim(batch):
                book, (n, s) = shared.value[dim], total[dim]
                for p in range(book.shape[0]):
                    index, _, _ = nearest(x[:, p], book[p])
                    n[p] += np.bincount(index, minlength=book.shape[1])
                    for c in range(book.shape[2]):  # sums below 2 ** 53 are exact in doubles
                        s[p, :, c] += np.bincount(index, x[:, p, c], book.shape[1]).astype(np.int64)
        for dim, (n, s) in total.items():
            p, e, c = np.indices(s.shape).reshape(3, -1)
            used = n[p, e] > 0
            p, e, c = p[used], e[used], c[used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), dim), pa.int32()), *(pa.array(v, pa.int32()) for v in (p, e, c)), pa.array(n[p, e]), pa.array(s[p, e, c])],
                names=["dim", "part", "entry", "component", "n", "total"])

    sums = rows.select("embedding", "dim").mapInArrow(add_up, "dim int, part int, entry int, component int, n bigint, total bigint")
    sums = sums.groupBy("dim", "part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = {dim: book.copy() for dim, book in books.items()}
    for r in sums:  # a row per component of a book
        out[r["dim"]][r["part"], r["entry"], r["component"]] = r["total"] // r["n"]
    shared.unpersist()
    return out


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks by dimension from all usable rows of ``vectors``; none for an empty table."""
    rows = usable(vectors)
    books = first_books(rows, entries)
    for _ in range(rounds if books else 0):
        books = improve(rows, books)
    return books


def encode(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, label, dim, code, error`` of every usable row: two hex digits a part, and the squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def work(batch):
        code, error = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
        for at, dim, x in _by_dim(batch):
            found = [nearest(x[:, p], book)[:2] for p, book in enumerate(shared.value[dim])]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            for k, row in zip(at, digits):
                code[k] = row.tobytes().hex()
            error[at] = sum(d for _, d in found)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("dim"), pa.array(code), pa.array(error)],
                                         names=["vec_id", "label", "dim", "code", "error"])

    return map_batches(usable(vectors), work, "vec_id bigint, label bigint, dim int, code string, error bigint")


def decode(codes: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, embedding``: the vectors that ``code`` stands for, at the middle of each whole number."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def work(batch):
        out = []
        for dim, code in zip(batch.column("dim").to_pylist(), batch.column("code").to_pylist()):
            book = shared.value[dim]
            entry = np.frombuffer(bytes.fromhex(code), np.uint8)
            out.append(((book[np.arange(len(entry)), entry].reshape(-1)[:dim] + 0.5) / SCALE).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return map_batches(codes.select("vec_id", "dim", "code"), work, "vec_id bigint, embedding array<double>")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``vec_id, label, dim, code, error, label_error`` of the usable rows, and the codebooks by dimension.

    Rows whose vector is null or holds a null, NaN or infinite component are left out.
    Vectors of each dimension have codebooks of their own; where it is no multiple of
    ``PARTS``, zeros follow (an empty vector has parts without components and code 0).
    Codebooks start from the smallest vec_ids, null ones last, rows of one vec_id by
    vector; with fewer rows than ``entries`` they are smaller. ``label_error`` adds up
    the error over equal labels, null labels together. Repeated rows are coded each.
    ``entries`` is at most 256. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    books = train(vectors, entries, rounds)
    coded = Scratch(vectors.sparkSession).write(encode(vectors, books))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_totals(coded, totals, ["label"], "_n").drop("_n"), books


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, between commas."""
    return sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    coded, books = compress(vectors)
    sums = F.lit(None).cast("string")
    for dim, book in books.items():
        sums = F.when(F.col("dim") == dim, F.lit(digest(book))).otherwise(sums)
    return coded.select("vec_id", "code", "error", "label_error", sums.alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Brute force over all entries; for vectors of one dimension, a multiple of PARTS."""
    steps = [f"""
k AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, label, p, list_slice(e, p * (len(e) // {PARTS}) + 1, (p + 1) * (len(e) // {PARTS})) AS x FROM k, range({PARTS}) r(p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
b0 AS (SELECT p, i, x AS w FROM v JOIN s USING (vec_id))"""]
    near = """
a{r} AS (
    SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min(struct_pack(d := d, i := i)) AS m FROM (
        SELECT vec_id, label, v.p, x, i, list_sum(list_transform(list_zip(x, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v JOIN b{r} b ON b.p = v.p) GROUP BY vec_id, p)"""
    for r in range(ROUNDS):
        steps.append(near.format(r=r))
        steps.append(f"""
c{r} AS (SELECT p, m.i AS i, unnest(x) AS y, generate_subscripts(x, 1) AS c FROM a{r}),
m{r} AS (SELECT p, i, c, sum(y)::BIGINT AS t, count(*)::BIGINT AS n FROM c{r} GROUP BY p, i, c),
n{r} AS (SELECT p, i, list((t - ((t % n) + n) % n) // n ORDER BY c) AS w FROM m{r} GROUP BY p, i),
b{r + 1} AS (SELECT b.p, b.i, coalesce(n.w, b.w) AS w FROM b{r} b LEFT JOIN n{r} n ON n.p = b.p AND n.i = b.i)""")
    steps.append(near.format(r=ROUNDS))
    steps.append(f"""
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM b{ROUNDS}),
f AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.i), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
    FROM a{ROUNDS} GROUP BY vec_id)""")
    return "WITH " + ",".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""


OP12_SQL = _op12_sql()
