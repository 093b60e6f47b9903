"""All pairs of texts within an edit bound, compared in tiles by numpy.

For texts made of the same pieces, where keys that matches share are shared by most other
texts too. Texts go to blocks by length, and only blocks whose lengths are close enough
meet. In a tile, the characters and the bigrams of a text are the places of a vector (the
n-th occurrence of a gram has its own), so that one matrix product says how many grams two
texts share at most; rarer grams share places, which can only raise that number. An edit
spoils one character and two bigrams, so most pairs end there. The others are measured by
the bit-parallel edit distance (Myers 1999, in blocks of 64 characters), many at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settings import conf_int, shuffle_width

EPS = 1e-9
TEXT_BLOCK_ROWS = 8192
_CHARS = 1 << 20  # of the texts of a block, unless a single one is longer
_STRIP = 128  # texts compared at once with a block
_PLACES = 256  # of a gram vector
_BITS = 4 << 20  # words of 64 bits in which a strip keeps where its characters stand
_CHUNK = 8192  # pairs measured at once
_BATCH = 65_536  # pairs a tile hands on at once


def _edge(t: float, length) -> np.ndarray:
    """Edits a pair may have whose longer text has ``length`` characters."""
    return np.floor((1.0 - t) * np.asarray(length, float) + EPS)


def _blocks(values: DataFrame, t: float, rows_each: int) -> tuple[list, list]:
    """``(length, first block, blocks)`` of each length, and which ranges of blocks meet."""
    sizes = sorted((r["l"], r["n"]) for r in values.groupBy(F.length("v").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect())
    ranges, held = [], 0  # lengths from, to, first block, number of blocks
    for length, n in sizes:
        each = max(1, min(rows_each, _CHARS // max(length, 1)))
        if ranges and ranges[-1][3] == 1 and held + n <= each:
            ranges[-1][1], held = length, held + n
            continue
        at = ranges[-1][2] + ranges[-1][3] if ranges else 0
        ranges.append([length, length, at, -(-n // each)])
        held = n
    places = [(length, at, parts) for low, high, at, parts in ranges for length, _ in sizes if low <= length <= high]
    meet = [(a[2], a[3], b[2], b[3]) for k, a in enumerate(ranges) for b in ranges[k:] if a[1] + 1e-6 >= t * b[0]]
    return places, meet


def dense_pairs(values: DataFrame, own: Sequence[str], t: float, size: int, above: int = 0) -> DataFrame:
    """Pairs of texts ``v`` with edit similarity of at least ``t``, each once, with ``sim``.

    ``own`` columns, the first of which is the id, come back with ``_l`` and ``_r``, ids in
    order. The longer text has more than ``above`` characters.
    """
    spark, names = values.sparkSession, list(own)
    width, limit = shuffle_width(spark), conf_int(spark, "textBlockRows", TEXT_BLOCK_ROWS)
    rows = values.select("v", *[c for c in names if c != "v"]).where(F.col(names[0]).isNotNull())
    # Enough tiles to keep every core busy, none above the limits.
    each = max(1, min(limit, -(-size // (int((8 * width) ** 0.5) + 1))))
    places, meet = _blocks(rows, t, each)
    schema = ", ".join(f"{c}_{s} {rows.schema[c].dataType.simpleString()}" for s in "lr" for c in names) + ", sim double"
    if not meet:
        return spark.createDataFrame([], schema)
    cells = F.broadcast(spark.createDataFrame(places, "_len int, _first int, _parts int"))  # a row per length
    held = lambda f, p: F.sequence(F.col(f), F.col(f) + F.col(p) - 1)
    met = spark.createDataFrame(meet, "_fi int, _pi int, _fj int, _pj int")
    met = met.withColumn("_i", F.explode(held("_fi", "_pi"))).withColumn("_j", F.explode(held("_fj", "_pj"))).where("_i <= _j").select("_i", "_j")
    tiles = sum(b * d if a != c else b * (b + 1) // 2 for a, b, c, d in meet)
    sides = met.select(F.col("_i").alias("_own"), "_i", "_j").union(met.where("_i < _j").select("_j", "_i", "_j"))
    placed = rows.join(cells, F.length("v") == F.col("_len"))
    placed = placed.withColumn("_own", F.col("_first") + F.pmod(F.xxhash64(names[0]), F.col("_parts")).cast("int")).drop("_len", "_first", "_parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tile(pa.Table.from_batches(batches), names, t, above)

    # A task a tile, as long as they are few: by bytes alone they would be merged.
    return placed.join(sides, "_own").repartition(max(1, min(tiles, 16 * width)), "_i", "_j").groupBy("_i", "_j").applyInArrow(work, schema)


def _grams(codes: np.ndarray, start: np.ndarray, size: np.ndarray, q: int) -> np.ndarray:
    """For each text, at how many of the places it has a gram of ``q`` characters (edges padded), as float32.

    ``codes`` counts the characters from 1 on; 0 stands before and after each text."""
    n, count = len(size), size + q - 1
    text = np.repeat(np.arange(n), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # of the gram in its text
    gram = np.zeros(len(at), np.int64)
    for k in range(q):
        place = at + k - (q - 1)
        inside = (place >= 0) & (place < size[text])
        gram = gram * (int(codes.max(initial=0)) + 1) + np.where(inside, codes[np.where(inside, start[text] + place, 0)], 0)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    repeat = np.arange(len(gram)) - np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    _, token, seen = np.unique(gram * (int(repeat.max(initial=0)) + 1) + repeat, return_inverse=True, return_counts=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(len(seen))
    single = _PLACES // 2
    rank = np.where(rank < single, rank, single + rank % (_PLACES - single))[token]
    return np.bincount(text * _PLACES + rank, minlength=n * _PLACES).reshape(n, _PLACES).astype(np.float32)


def _tile(table: pa.Table, names: Sequence[str], t: float, above: int) -> Iterator[pa.RecordBatch]:
    """The close pairs of the tile's two blocks."""
    texts = table.column("v").to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    if not size.any():
        return
    start = np.cumsum(size) - size
    alphabet, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    codes = codes + 1
    ids = table.column(names[0])
    if pa.types.is_integer(ids.type):
        ids = ids.to_numpy()
    else:
        values = np.array(ids.to_pylist(), dtype=object)
        ids = np.unique(values, return_inverse=True)[1]
    block = table.column("_own").to_numpy()
    first, second = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
    by_length = lambda rows: rows[np.argsort(size[rows], kind="stable")]
    left = by_length(np.flatnonzero(block == first))
    right = left if first == second else by_length(np.flatnonzero(block == second))
    kinds = [(q, _grams(codes, start, size, q)) for q in (1, 2) if 1 - q * (1 - t) > EPS]
    sides = [(q, m[left], m[right]) for q, m in kinds]
    edits = _edge(t, np.arange(size.max(initial=0) + 1))
    lengths = size[right]
    out, waiting = [], 0

    def batch():
        a, b, d = (np.concatenate(x) for x in zip(*out))
        swap = ids[a] > ids[b]
        l, r = np.where(swap, b, a), np.where(swap, a, b)
        ends = [table.column(c).take(pa.array(x)).combine_chunks() for x in (l, r) for c in names]
        sim = 1.0 - d / np.maximum(size[a], size[b])
        return pa.RecordBatch.from_arrays([*ends, pa.array(sim)], names=[*(f"{c}_{s}" for s in "lr" for c in names), "sim"])

    at = 0
    while at < len(left):
        part = left[at: at + _STRIP]
        words = -(-int(size[part[-1]]) // 64)
        part = part[: max(1, _BITS // max(1, words * (len(alphabet) + 1)))]
        low, high = np.searchsorted(lengths, t * size[part[0]] - 1e-6), np.searchsorted(lengths, size[part[-1]] / t + 1e-6, "right")
        if first == second:
            low = at
        cols, longer_col = right[low:high], lengths[low:high]
        shared = [(q, x[at: at + len(part)] @ y[low:high].T) for q, x, y in sides]
        rows_hit, cols_hit = [], []
        cuts = np.flatnonzero(np.diff(size[part], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # texts of one length
            longer = np.maximum(size[part[lo]], longer_col)
            most = edits[longer]
            can = (np.abs(size[part[lo]] - longer_col) <= most) & (longer > above)
            hit = np.repeat(can[None, :], hi - lo, axis=0)
            for q, both in shared:
                hit &= both[lo:hi] >= (longer + (q - 1) - q * most)[None, :]
            x, y = np.nonzero(hit)
            rows_hit.append(x + lo)
            cols_hit.append(y)
        x, y = np.concatenate(rows_hit), np.concatenate(cols_hit)
        if first == second:
            once = y > x  # both count from the strip's first row
            x, y = x[once], y[once]
        if len(x):
            apart = ids[part[x]] != ids[cols[y]]
            x, y = x[apart], y[apart]
            a, b = part[x], cols[y]
            d = _distances(codes, start, size, part, x, b, words, len(alphabet) + 1)
            close = d <= edits[np.maximum(size[a], size[b])]
            if close.any():
                out.append((a[close], b[close], d[close]))
                waiting += int(close.sum())
        at += len(part)
        if waiting >= _BATCH:
            yield batch()
            out, waiting = [], 0
    if out:
        yield batch()


def _distances(codes, start, size, part, x, b, words: int, letters: int) -> np.ndarray:
    """Edit distances of the texts ``part[x]`` to the texts ``b``."""
    stands = np.zeros((len(part), max(words, 1), letters), np.uint64)
    text = np.repeat(np.arange(len(part)), size[part])
    at = np.arange(len(text)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
    np.bitwise_or.at(stands, (text, at // 64, codes[start[part][text] + at]), np.uint64(1) << (at % 64).astype(np.uint64))
    stands = stands.ravel()
    order = np.argsort(-size[b], kind="stable")
    out = np.empty(len(b), np.int64)
    for lo in range(0, len(order), _CHUNK):
        some = order[lo: lo + _CHUNK]
        out[some] = _measured(stands, max(words, 1), letters, size[part][x[some]], x[some], codes, start[b[some]], size[b[some]])
    return out


def _measured(stands, words: int, letters: int, m, x, codes, start, n) -> np.ndarray:
    """Edit distances of patterns ``x`` of ``m`` characters to texts of ``n`` each, the longest first."""
    one, zero = np.uint64(1), np.uint64(0)
    score = m.copy()
    up = [np.full(len(x), ~zero) for _ in range(words)]
    down = [np.zeros(len(x), np.uint64) for _ in range(words)]
    last = (m - 1) // 64
    final = one << ((m - 1) % 64).astype(np.uint64)
    marks = [np.where(last == w, final, zero) for w in range(words)]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")  # texts longer than each place
    for j, k in enumerate(live):
        cell = x[:k] * (words * letters) + codes[start[:k] + j]
        rise, fall = one, zero
        for w in range(words):
            eq, p, q = stands[cell + w * letters], up[w][:k], down[w][:k]
            vertical = eq | q
            eq |= fall
            across = (((eq & p) + p) ^ p) | eq
            more, less = q | ~(across | p), p & across
            score[:k] += (more & marks[w][:k]) != 0
            score[:k] -= (less & marks[w][:k]) != 0
            more_out, less_out = more >> np.uint64(63), less >> np.uint64(63)
            more, less = (more << one) | rise, (less << one) | fall
            up[w][:k], down[w][:k] = less | ~(vertical | more), more & vertical
            rise, fall = more_out, less_out
    return np.where(m > 0, score, n)
