"""Language-model scores from class-based n-grams (Brown et al. 1992).

A word ``w`` after classes ``a, b`` has probability p(class | a, b) * p(unit | class)
* p(word | unit). Units are what is clustered: every frequent word is a unit of its
own; rarer words share one per ending (their last two bytes), so a word never seen
has a class, too. Exchange clustering moves units between classes while the
likelihood of their neighbours grows. Class trigrams are interpolated with bigrams
and unigrams; within a shared unit, absolute discounting sets probability aside for
unseen words.

What the driver holds is bounded by shares of the corpus, not by its size: units
make up ``UNIT_SHARE`` of all tokens or more, neighbours ``CONTEXT_SHARE``, pairs
of them ``PAIR_SHARE`` (the others are summed up by unit), words with broadcast counts ``KNOWN_SHARE``, endings are two
bytes. Counts of all other words stay in a table that is joined by word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, map_batches, texts_of

CLASSES = 64
UNIT_SHARE, CONTEXT_SHARE, PAIR_SHARE, KNOWN_SHARE = 1e-5, 1e-3, 5e-7, 1e-6
ENDING = 2
EXCHANGES = 8  # rounds over all units, at most
PRIOR_3, PRIOR_2 = 50.0, 10.0  # weight of the shorter history, in tokens
_FLUSH = 400_000
_SLICE = 1 << 20  # tokens handled at once
END = b""  # a word is never empty


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    out = text.encode("utf-8", "replace").lower().split()  # bytes split at 0x20 and 0x09-0x0D
    out.append(END)
    return out


@dataclass(frozen=True)
class Units:
    """Words with their own counts, and the unit of every word."""

    words: list[bytes]
    counts: np.ndarray
    unit: np.ndarray
    endings: dict[bytes, int]
    other: int  # unit of words with a rare ending
    sizes: np.ndarray  # tokens per unit
    shared: np.ndarray  # tokens of a unit that several words share
    kinds: np.ndarray  # distinct words among them
    total: int
    distinct: int
    discount: float


class _Index(dict):
    """Word to its place in ``Units.words``; a word without one gives ``~unit``."""

    def __init__(self, units: Units):
        super().__init__(zip(units.words, range(len(units.words))))
        self.units = units

    def __missing__(self, word: bytes) -> int:
        return ~self.units.endings.get(word[-ENDING:], self.units.other)


_held: list = [None, None]


def _index(shared) -> tuple[Units, _Index]:
    """The broadcast units and their index, built once per Python worker."""
    units = shared.value
    if _held[0] is not units:
        _held[:] = [units, _Index(units)]
    return _held[0], _held[1]


def count_words(docs: DataFrame, train: Column) -> DataFrame:
    """``word, n`` of all tokens of the training rows."""
    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts_of(batch):
                seen.update(tokens(text))
                if len(seen) > _FLUSH:
                    yield rows()
        if seen:
            yield rows()

    return docs.where(train).select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def make_units(counts: DataFrame) -> Units:
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    total = whole["n"]
    own = (F.col("n") >= UNIT_SHARE * total) | (F.col("word") == F.lit(END))
    known = counts.where((F.col("n") >= KNOWN_SHARE * total) | own).orderBy("word").toArrow()
    ends = counts.where(~own).groupBy(F.substring("word", -ENDING, ENDING).alias("e")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).orderBy("e").toArrow()
    words, n = [bytes(w) for w in known.column("word").to_pylist()], known.column("n").to_numpy()
    unit = np.full(len(words), -1)
    alone = np.flatnonzero((n >= UNIT_SHARE * total) | np.array([w == END for w in words], bool))
    unit[alone] = np.arange(len(alone))
    end_n, end_v = ends.column("n").to_numpy(), ends.column("v").to_numpy()
    frequent = np.flatnonzero(end_n >= UNIT_SHARE * total)
    texts = [bytes(e) for e in ends.column("e").to_pylist()]
    endings = {texts[i]: len(alone) + k for k, i in enumerate(frequent)}
    other = len(alone) + len(frequent)
    sizes, shared, kinds = np.zeros(other + 1), np.zeros(other + 1), np.zeros(other + 1)
    sizes[:len(alone)] = n[alone]
    at = np.array([endings.get(t, other) for t in texts], np.int64)
    np.add.at(shared, at, end_n)
    np.add.at(kinds, at, end_v)
    rest = np.flatnonzero(unit < 0)
    unit[rest] = [endings.get(words[i][-ENDING:], other) for i in rest]
    d = whole["n1"] / (whole["n1"] + 2 * whole["n2"]) if whole["n1"] else 0.5
    return Units(words, n, unit, endings, other, sizes + shared, shared, kinds, total, whole["v"], min(max(d, 0.1), 0.95))


def _sequences(texts: list[str], shared, start: int):
    """``(units, document)`` of the tokens of texts, ``start`` copies of the end before each, in slices."""
    units, index = _index(shared)
    first = index.get(END, ~units.other)
    held, size = [], 0
    for i, text in enumerate(texts):
        places = [first] * start + list(map(index.__getitem__, tokens(text)))
        held.append((i, places))
        size += len(places)
        if size >= _SLICE or i == len(texts) - 1:
            place = np.array([p for _, x in held for p in x], np.int64)
            doc = np.repeat([k for k, _ in held], [len(x) for _, x in held])
            yield place, _unit_of(units, place), doc
            held, size = [], 0


def _unit_of(units: Units, place: np.ndarray) -> np.ndarray:
    if not len(units.words):
        return ~place
    return np.where(place >= 0, units.unit[np.maximum(place, 0)], ~place)


def neighbours(docs: DataFrame, train: Column, units: Units, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts ``(unit, context, n)``; contexts are frequent units, left and right apart.

    All other neighbours of a unit are one context a side, in which its pairs below
    ``PAIR_SHARE`` are counted, too: every pair of tokens counts once for each of them.
    """
    frequent = np.flatnonzero(units.sizes >= CONTEXT_SHARE * max(1, units.total))
    context = np.full(len(units.sizes), len(frequent))
    context[frequent] = np.arange(len(frequent))
    width = len(frequent) + 1

    def count(batch):
        for _, unit, doc in _sequences(texts_of(batch), shared, 1):
            together = doc[1:] == doc[:-1]
            left, right = unit[:-1][together], unit[1:][together]
            key = np.concatenate([right * (2 * width) + context[left], left * (2 * width) + width + context[right]])
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    rows = map_batches(docs.where(train).select("text"), count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rest = F.col("key") - F.pmod("key", F.lit(width)) + width - 1
    rows = rows.groupBy(F.when(F.col("n") >= PAIR_SHARE * units.total, F.col("key")).otherwise(rest).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy().astype(float)
    return key // (2 * width), key % (2 * width), n


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(unit: np.ndarray, context: np.ndarray, n: np.ndarray, sizes: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit: exchange clustering for the likelihood of contexts given the class.

    Starts from units dealt out by frequency; then each unit in turn moves to the
    class that gains most, until a round moves none or ``EXCHANGES`` rounds are over.
    """
    order = np.argsort(-sizes, kind="stable")
    of = np.zeros(len(sizes), np.int64)
    of[order] = np.arange(len(sizes)) % classes
    if not len(unit):
        return of
    by_unit = np.lexsort((context, unit))
    unit, context, n = unit[by_unit], context[by_unit], n[by_unit]
    cuts = np.searchsorted(unit, np.arange(len(sizes) + 1))
    table = np.zeros((int(context.max()) + 1, classes))
    np.add.at(table, (context, of[unit]), n)
    whole = table.sum(axis=0)
    for _ in range(EXCHANGES):
        moved = 0
        for u in order:
            lo, hi = cuts[u], cuts[u + 1]
            if lo == hi:
                continue
            x, k, own = context[lo:hi], n[lo:hi], of[u]
            mass = k.sum()
            table[x, own] -= k
            whole[own] -= mass
            now = table[x]
            gain = (_nlogn(now + k[:, None]) - _nlogn(now)).sum(axis=0) - _nlogn(whole + mass) + _nlogn(whole)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[u] = best
            table[x, best] += k
            whole[best] += mass
        if not moved:
            break
    return of


def class_trigrams(docs: DataFrame, train: Column, of: np.ndarray, shared, classes: int) -> np.ndarray:
    """Counts of three classes in a row; two ends stand before each text."""
    def count(batches):
        total = np.zeros(classes ** 3, np.int64)
        for batch in batches:
            for _, unit, doc in _sequences(texts_of(batch), shared, 2):
                c = of[unit]
                keep = doc[2:] == doc[:-2]
                total += np.bincount(((c[:-2] * classes + c[1:-1]) * classes + c[2:])[keep], minlength=classes ** 3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["key", "n"])

    rows = docs.where(train).select("text").mapInArrow(count, "key bigint, n bigint")
    rows = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes ** 3)
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(classes, classes, classes)


def transitions(n3: np.ndarray) -> np.ndarray:
    """log10 p(c | a, b), interpolated with p(c | b) and p(c)."""
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 0.5) / (n1 + 0.5).sum()
    p2 = (n2 + PRIOR_2 * p1) / (n2.sum(axis=1, keepdims=True) + PRIOR_2)
    p3 = (n3 + PRIOR_3 * p2[None]) / (n3.sum(axis=2, keepdims=True) + PRIOR_3)
    return np.log10(p3)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Null and empty texts consist of the end alone. Repeated rows are each scored;
    a row without doc_id is scored, too. Without training rows all probabilities
    are those of the smoothing.
    """
    scratch = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = scratch.write(count_words(docs, train))
    units = make_units(counts)
    shared = spark.sparkContext.broadcast(units)
    of = exchange(*neighbours(docs, train, units, shared), units.sizes)
    classes = CLASSES
    step = transitions(class_trigrams(docs, train, of, shared, classes)).ravel()
    in_class = np.bincount(of, weights=units.sizes + 0.5, minlength=classes)
    emit = np.log10((units.sizes + 0.5) / in_class[of])
    norm = units.total + units.distinct + 1
    unseen = np.where(units.shared > 0, units.discount * units.kinds / np.maximum(units.shared, 1), 1.0)
    alone = units.shared[units.unit] == 0 if len(units.words) else np.zeros(0, bool)
    word_emit = np.where(alone, 0.0, np.log10(np.maximum(units.counts - units.discount, 1e-9) / np.maximum(units.shared[units.unit], 1)))
    word_base = np.log10((units.counts + 1) / norm)
    tables = spark.sparkContext.broadcast((of, step, emit, unseen, word_emit, word_base))

    def local(batch):
        of, step, emit, unseen, word_emit, word_base = tables.value
        texts, rows = texts_of(batch), batch.column("row")
        size = len(texts)
        n, known, base, value = (np.zeros(size) for _ in range(4))
        rare = [[], [], [], [], []]

        def rare_rows():
            count, out = len(rare[0]), [pa.array(x, t) for x, t in zip(rare, (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64()))]
            for col in rare:
                col.clear()
            ids = pa.nulls(count).cast(batch.column("doc_id").type)
            return pa.RecordBatch.from_arrays([out[0], ids, out[1], out[2], pa.array(np.zeros(count, np.int64)), out[3], out[4]], names=_NAMES)

        for place, unit, doc in _sequences(texts, shared, 2):
            c = of[unit]
            keep = np.zeros(len(c), bool)
            keep[2:] = doc[2:] == doc[:-2]
            at = np.flatnonzero(keep)
            own, found = doc[at], place[at] >= 0
            n += np.bincount(own, minlength=size)
            value += np.bincount(own, step[(c[at - 2] * classes + c[at - 1]) * classes + c[at]] + emit[unit[at]], minlength=size)
            have = place[at][found]
            known += np.bincount(own[found], minlength=size)
            base += np.bincount(own[found], word_base[have], minlength=size)
            value += np.bincount(own[found], word_emit[have], minlength=size)
            for k in np.unique(own[~found]):
                index = _index(shared)[1]
                for word, times in Counter(w for w in tokens(texts[k]) if w not in index).items():
                    u = ~index[word]
                    for col, x in zip(rare, (rows[int(k)].as_py(), word, times, float(units_shared[u]), float(unseen[u]))):
                        col.append(x)
            if len(rare[0]) > _FLUSH // 4:
                yield rare_rows()
        void = pa.nulls(size)
        yield pa.RecordBatch.from_arrays(
            [rows, batch.column("doc_id"), void.cast(pa.binary()), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
             pa.array(base), pa.array(value)], names=_NAMES)
        if rare[0]:
            yield rare_rows()

    units_shared = units.shared
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    parts = scratch.write(map_batches(numbered, local, f"row bigint, doc_id {kind}, word binary, n bigint, known bigint, x double, y double"))
    heads = parts.where("word IS NULL")
    # In a row of a rare word: n its number, x the tokens of its unit, y the unit's probability of unseen words.
    met = parts.where("word IS NOT NULL").select("row", "word", F.col("n").alias("times"), "x", "y").join(counts, "word", "left")
    seen = F.col("n").isNotNull()
    within = F.when(seen, (F.col("n") - F.lit(units.discount)) / F.col("x")).otherwise(F.col("y"))
    rest = met.groupBy("row").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("known_2"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(norm)))).alias("base_2"),
        F.sum(F.col("times") * F.log10(within)).alias("score_2"))
    joined = heads.join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select("doc_id", F.col("n").alias("n_tokens"), plus("known", "known_2").alias("n_known"),
                         F.lit(units.total).cast("bigint").alias("train_tokens"), plus("x", "base_2").alias("base_score"),
                         plus("y", "score_2").alias("score"))


_NAMES = ["row", "doc_id", "word", "n", "known", "x", "y"]


def op4_class_lm(docs: DataFrame) -> DataFrame:
    """Scores of every document; counts come from those outside fold 2 of 7."""
    out = score(docs, fold("doc_id", 7) != 2)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
