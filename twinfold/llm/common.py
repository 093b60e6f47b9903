"""What the operators of this package share: folds, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settings import shared_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def below(key: Column, rate: Column) -> Column:
    """A reproducible draw: true for about ``rate`` of the keys."""
    return F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 31)) < F.ceil(rate * F.lit(float(1 << 31)))


class Scratch:
    """Tables written to the shared folder on behalf of one operator.

    A written table is computed once and outlives its executors. ``drop`` deletes
    tables that later steps no longer read; what is left belongs to the result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


ENCODED_AT_ONCE = 16_384  # keys of a memo
MEMO_BYTES = 32 << 20  # of a generation of a memo, about
LONGEST_KEY = 256  # characters of a text that a memo keeps


HOT_KEYS = 65_536  # rows of a broadcast table of hot keys, at most


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row per key, by equal keys (null equals null).

    ``size`` names the column of ``totals`` that says how many rows a key has. Keys
    with more than 1/HOT_KEYS of these rows are HOT_KEYS at most, whatever the data:
    they are broadcast, so that a hot key stays where its rows are. The others meet by
    a shuffle, in which no key has more than that share. Both tables should be
    written ones, as they are read twice.
    """
    whole = totals.agg(F.sum(size)).first()[0] or 0
    hot = totals.where(F.col(size) > max(1, whole // HOT_KEYS))

    def meet(left, right, how):
        right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = left.join(right, same, how)
        return out if how == "left_anti" else out.drop(*[f"_{k}" for k in keys])

    if not hot.take(1):
        return meet(rows, totals, "inner")
    cold = meet(rows, F.broadcast(hot.select(*keys)), "left_anti")
    rest = meet(cold, totals.where(F.col(size) <= max(1, whole // HOT_KEYS)), "inner")
    return meet(rows, F.broadcast(hot), "inner").unionByName(rest)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema, scan: bool = False) -> DataFrame:
    """``work`` on every Arrow batch, where the rows are; empty batches are passed over.

    ``scan`` says that ``df`` is read from files as it is: if they are fewer than the
    cores, the rows are dealt out first. (Asking a plan with joins for its number of
    partitions would run it.)
    """

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from work(batch)
        finally:
            give_back()

    return (spread(df) if scan else df).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def row_slices(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in batches of about ``limit`` bytes of text that share its memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = size = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, size + limit, "right")))
        yield batch.slice(at, to - at)
        at, size = to, int(ends[to - 1])


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; one long text is a range by itself."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Memo:
    """A bounded map from short texts to what an encoder gives for them.

    Two generations: when the young one is full it becomes the old one, so that
    frequent entries survive. Each holds ``MEMO_BYTES`` or so, whatever the texts are:
    long keys are encoded each time. Emptied at the end of a partition (``map_batches``).
    """

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode = encode
        self.clear()
        _memos().append(self)

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def fetch(self, lists: list[list[str]]) -> list[list]:
        """What each key of each list encodes to."""
        get = self.young.get
        found = [list(map(get, keys)) for keys in lists]
        holes = [i for i, values in enumerate(found) if None in values]
        if holes:
            table = self.look_up({k for i in holes for k, v in zip(lists[i], found[i]) if v is None})
            for i in holes:
                found[i] = [table[k] if v is None else v for k, v in zip(lists[i], found[i])]
        return found

    def look_up(self, keys: set[str]) -> dict:
        """What each key encodes to."""
        out = dict(zip(keys, map(self.young.get, keys)))
        wanted = [k for k, v in out.items() if v is None]
        again = {k: v for k, v in zip(wanted, map(self.old.get, wanted)) if v is not None}
        new, collects = [k for k in wanted if k not in again] if again else wanted, gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            self._keep(again)
            out.update(again)
            for at in range(0, len(new), ENCODED_AT_ONCE):
                part = new[at: at + ENCODED_AT_ONCE]
                found = dict(zip(part, self.encode(part), strict=True))
                self._keep(found)
                out.update(found)
        finally:
            if collects:
                gc.enable()
        return out

    def _keep(self, entries: dict) -> None:
        for k, v in entries.items():
            if len(k) <= LONGEST_KEY:
                self.young[k] = v
                self.size += 200 + len(k) + (len(v) if isinstance(v, bytes) else 0)
                if self.size > MEMO_BYTES:
                    self.old, self.young, self.size = self.young, {}, 0


@lru_cache(maxsize=1)
def _memos() -> list[Memo]:
    """The memos of this Python worker.

    Functions of this package travel by value, with copies of the globals they name;
    a cached function travels by name, so that all of them see the same list."""
    return []


def give_back() -> None:
    """Return to the system what a Python worker no longer needs; workers live on from one stage to the next."""
    for memo in _memos():
        memo.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the text each is in.

    A word is a longest run of letters and digits, in lower case.
    """
    lowered = [t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lowered])
    inside = _word_characters()[code]
    edge = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = code[inside].astype(np.uint64)
    first = np.zeros(len(inside), np.int64)
    first[edge] = 1
    word = np.cumsum(first[inside]) - 1
    starts = np.searchsorted(word, np.arange(len(edge)))
    place = np.arange(len(code)) - starts[word]
    spread_out = mix(code * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mix(np.add.reduceat(spread_out, starts)), row[edge]


def windows(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the place of each run's first word."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k: k + size]
    at = np.flatnonzero(owner[:size] == owner[n - 1:])
    return mix(h[at]), at
