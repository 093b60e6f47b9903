"""Language identification with bit-sliced Bloom filters of character n-grams.

One slot array holds all languages: bit ``l`` of a slot belongs to the filter of
language ``l``. Looking an n-gram up in ``k`` slots and taking their AND gives the
set of all languages that contain it. A document goes to the language with most
n-grams, after the hits that its filter's fill would give by chance are taken off.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, fold, map_batches, mix, row_slices, slices, texts_of

ORDERS = (2, 3, 4)
SAMPLE_DOCS = 4000  # documents per language that the filters are learned from, about
MIN_SHARE = 2e-5  # of a language's n-grams of one order; so at most 50,000 enter per order
BITS_PER_GRAM = 16
PROBES = 2
MIN_CONTAINED = 0.1  # below this share of known n-grams a document is in no learned language
_CHARS = 1 << 20
_AT_ONCE = 1 << 18  # characters whose n-grams are held at once, about: some 80 bytes each
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                  dtype=np.uint64)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    slots: np.ndarray  # [words of 64 languages, slots]
    false_hits: np.ndarray  # chance that a filter claims an n-gram it does not hold

    @property
    def mask(self) -> int:
        return self.slots.shape[1] - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(texts: list[str]):
    """``(row, order, hash)`` arrays of all n-grams of lower-case words, spaces at the ends of words."""
    lowered = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]  # letters and the characters beside them
    code, row, letter = np.where(letter, code, 32)[keep].astype(np.uint64), row[keep], letter[keep]
    for n in ORDERS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        h = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            h += code[k: k + size] * _SEEDS[k]
        inner = row[:size] == row[n - 1:]
        for k in range(1, n - 1):
            inner &= letter[k: k + size]
        if n == 2:
            inner &= letter[:size] | letter[1:]
        yield n, row[:size][inner], mix(h[inner])


def _pieces(texts: list[str]):
    """Texts cut to at most ``_CHARS`` at white space, so that every n-gram is in one piece only.

    Where so many characters have no white space among them, the cut falls anywhere: the
    few n-grams across it are lost, of a million."""
    step = max(ORDERS) - 1
    for i, text in enumerate(texts):
        if len(text) <= _CHARS:
            yield i, text
            continue
        at = 0
        while at < len(text):  # cut at white space, so that no word is divided
            end = min(len(text), at + _CHARS)
            cut = max(text.rfind(" ", at + step, end), text.rfind("\n", at + step, end)) if end < len(text) else end
            end = cut if cut > at else end
            yield i, text[at:end]
            at = end


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts, each key once."""
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in found]))
    return keys, counts


def _count(batch: pa.RecordBatch):
    langs = batch.column("lang")
    for lang in sorted(set(langs.to_pylist())):
        found = {n: [] for n in ORDERS}
        for part in row_slices(batch.filter(pc.equal(langs, lang)), _AT_ONCE):
            own = [p for _, p in _pieces(texts_of(part))]
            for lo, hi in slices(own, _AT_ONCE):
                for n, _, h in _grams(own[lo:hi]):
                    found[n].append(np.unique(h, return_counts=True))
                    if sum(len(k) for k, _ in found[n]) > _CHARS:
                        found[n] = [_summed(found[n])]
        for n, parts in found.items():
            if parts:
                keys, counts = _summed(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)),
                     pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "order", "gram", "n"])


def learn(docs: DataFrame, train: Column) -> Filters:
    """Filters from the training rows with a language and a text.

    Learned from about ``SAMPLE_DOCS`` documents of each language, drawn by a hash
    of doc_id. An n-gram enters a filter when it is at least ``MIN_SHARE`` of that
    language's n-grams of its order, so the collected table is bounded by the
    number of languages, however large the corpus is.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters((), np.zeros((1, 64), np.uint64), np.zeros(0))
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    sample = rows.where(below(F.col("doc_id"), rates[F.col("lang")])).select("lang", "text")
    counts = map_batches(sample, _count, "lang string, order int, gram bigint, n bigint")
    counts = counts.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    # Totals are a few rows; the join back keeps one row per n-gram that is frequent enough.
    totals = {(r["lang"], r["order"]): r["n"] for r in counts.groupBy("lang", "order").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for (k, o), n in totals.items() for x in (f"{k} {o}", n * MIN_SHARE)])
    kept = counts.where(F.col("n") >= least[F.concat_ws(" ", "lang", "order")]).select("lang", "gram").toArrow()
    return _build(tuple(sorted(sizes)), kept.column("lang").to_numpy(zero_copy_only=False), kept.column("gram").to_numpy().view(np.uint64))


def _build(languages: tuple[str, ...], lang: np.ndarray, gram: np.ndarray) -> Filters:
    at = np.searchsorted(np.array(languages, dtype=object), lang) if len(lang) else np.zeros(0, np.int64)
    largest = int(np.bincount(at, minlength=len(languages)).max()) if len(lang) else 1
    size = 1 << max(10, int(np.ceil(np.log2(max(1, largest) * BITS_PER_GRAM))))
    slots = np.zeros((-(-len(languages) // 64), size), np.uint64)
    for p in range(PROBES):
        where = (gram >> np.uint64(32 * p)) & np.uint64(size - 1)
        np.bitwise_or.at(slots, (at // 64, where.astype(np.int64)), np.uint64(1) << (at % 64).astype(np.uint64))
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(languages, slots, fill ** PROBES)


def identify(texts: list[str], filters: Filters):
    """``(best language number or -1, score, share of n-grams it contains)`` arrays."""
    pieces = list(_pieces(texts))
    hits = np.zeros((len(filters.languages), len(texts)))
    total = np.zeros(len(texts))
    for lo, hi in slices([p for _, p in pieces], _AT_ONCE):
        owner = np.array([i for i, _ in pieces[lo:hi]])
        for _, row, h in _grams([p for _, p in pieces[lo:hi]]):
            doc = owner[row] if len(row) else row
            total += np.bincount(doc, minlength=len(texts))
            for word in range(filters.slots.shape[0]):
                found = None
                for p in range(PROBES):
                    got = filters.slots[word][((h >> np.uint64(32 * p)) & np.uint64(filters.mask)).astype(np.int64)]
                    found = got if found is None else found & got
                for bit in range(min(64, len(filters.languages) - 64 * word)):
                    hits[64 * word + bit] += np.bincount(
                        doc[(found >> np.uint64(bit)) & np.uint64(1) == 1], minlength=len(texts))
    if not filters.languages:
        return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), total
    false = filters.false_hits[:, None]
    real = np.maximum(hits - total * false, 0) / np.maximum(1 - false, 1e-9)
    best = real.argmax(axis=0)
    top = real[best, np.arange(len(texts))]
    score = np.where(top > 0, top / np.maximum(real.sum(axis=0), 1e-300), 0.0)
    return best, np.clip(score, 0, 1), np.clip(top / np.maximum(total, 1), 0, 1), total


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score, contained`` of every row of ``docs`` (doc_id, text).

    Null texts and texts without a letter give ``und`` with score 0, and so does
    every text when no language could be learned. Ties go to the language first
    in the alphabet. Repeated rows are each predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: see learn

    def work(batch):
        f = shared.value
        for part in row_slices(batch, _CHARS):
            texts = texts_of(part)
            best, score, contained, _ = identify(texts, f)
            und = np.array([not has_letter(t) for t in texts]) | (best < 0)
            names = [None if u else f.languages[b] for u, b in zip(und, best)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n or "und" for n in names], pa.string()),
                 pa.array(np.where(und, 0.0, score)), pa.array(np.where(und, 0.0, contained))],
                names=["doc_id", "lang_pred", "score", "contained"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double, contained double",
                       scan=True)


def op10_language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, contained``; learned from folds other than 2 of 4."""
    found = predict(docs, learn(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "contained")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language; all columns stay.

    A text without a letter goes, and one of whose n-grams less than
    ``MIN_CONTAINED`` are in the best language's filter.
    """
    filters = learn(docs, fold("doc_id", 4) != 2)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch):
        for part in row_slices(batch, _CHARS):
            texts = texts_of(part)
            best, _, contained, _ = identify(texts, shared.value)
            keep = (best >= 0) & (contained >= MIN_CONTAINED) & np.array([has_letter(t) for t in texts])
            yield part.filter(pa.array(keep))

    return map_batches(docs, work, docs.schema, scan=True)
