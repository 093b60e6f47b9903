"""Importance resampling towards a target: documents are drawn as the target's word runs weigh them.

Features of a text are its runs of one to three words, hashed to buckets by CRC-32. A
bucket's gain is the logarithm of its share in the target over its share in the
corpus, in thousandths; a document weighs the sum of its features' gains, looked up in
an array. Gumbel noise from a hash of doc_id is added, so that taking the highest
scores draws without replacement in proportion to the weights. The order of all
scores comes from a distributed radix sort (``radix``).

The CRC of a run of words is put together from those of its words: appending n bytes
to a text multiplies its CRC by a fixed matrix, kept as four tables of bytes for each
n, so that numpy gets all runs of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches
from .radix import radix_ranks

BUCKETS = 10_000
LONGEST_RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
_CHARS = 1 << 20  # bytes of text taken apart at once
_LONG_WORD = 64
# Words are what is left between bytes that are no digit, letter or part of a non-ASCII character.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def segments(raws: list[bytes]) -> Iterator[tuple[int, list[bytes], int]]:
    """``(text number, words, lead)``: texts in segments of about ``_CHARS`` bytes.

    The first ``lead`` words are the last of the segment before, for runs across the cut.
    """
    for i, raw in enumerate(raws):
        folded, at, lead = raw.translate(_FOLD), 0, []
        while True:
            end = folded.find(b" ", at + _CHARS) if len(folded) - at > _CHARS else -1
            words = lead + (folded[at:] if end < 0 else folded[at:end]).split()
            yield i, words, len(lead)
            if end < 0:
                break
            at, lead = end, words[len(words) - min(LONGEST_RUN - 1, len(words)):]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of a single byte step, and the effect of 0 to ``_LONG_WORD`` appended zero bytes by byte of the CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    grown = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(_LONG_WORD):
        grown.append(step[grown[-1] & 255] ^ (grown[-1] >> 8))
    return step, np.stack(grown)


def _join(head: np.ndarray, crc: np.ndarray, size: np.ndarray, words: list[bytes]) -> np.ndarray:
    """CRC of ``head`` + word for each word, given the CRC of each."""
    table, n = _tables()[1], np.minimum(size, _LONG_WORD)
    out = crc.copy()
    for byte in range(4):
        out ^= table[n, byte, (head >> np.uint32(8 * byte)) & np.uint32(255)]
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = crc32(words[k], int(head[k]))
    return out


def _blank(crc: np.ndarray) -> np.ndarray:
    """CRC of the text with a blank after it."""
    step, state = _tables()[0], ~crc
    return ~(step[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def features(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text number, bucket)`` of all features, and the number of each new word's text, some texts at a time."""
    held, size = [], 0
    for segment in segments(raws):
        held.append(segment)
        size += sum(map(len, segment[1]))
        if size >= _CHARS:
            yield _features(held)
            held, size = [], 0
    if held:
        yield _features(held)


def _features(held: list[tuple[int, list[bytes], int]]):
    words = list(chain.from_iterable(w for _, w, _ in held))
    counts = np.array([len(w) for _, w, _ in held], np.int64)
    text = np.repeat(np.array([i for i, _, _ in held], np.int64), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    new = place >= np.repeat(np.array([lead for _, _, lead in held], np.int64), counts)
    crc = np.fromiter(map(crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner, bucket, run = [text[new]], [crc[new]], crc
    for n in range(1, LONGEST_RUN):
        run = np.concatenate([run[:1], _join(_blank(run[:-1]), crc[1:], size[1:], words[1:])])
        ends = new & (place >= n)  # a run of n + 1 words ends here
        owner.append(text[ends])
        bucket.append(run[ends])
    return np.concatenate(owner), np.concatenate(bucket) % np.uint32(BUCKETS), owner[0]


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket. Tasks add up their own; the driver gets a row per bucket."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket, _ in features(_raws(batch)):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, for each bucket."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that the id decides; a null id reads as empty text."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def work(batch):
        ids = batch.column("doc_id").to_pylist()
        words, size, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
        for owner, bucket, word in features(_raws(batch)):
            words += np.bincount(word, minlength=len(ids))
            size += np.bincount(owner, minlength=len(ids))
            weight += np.bincount(owner, shared.value[bucket], len(ids)).astype(np.int64)  # whole numbers, far below 2 ** 53
        score = weight + np.array([noise(i, seed) for i in ids], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, size, weight, score))],
                                         names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint", scan=True)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows of ``min_words`` words or more, the floor(percent * N / 100) highest
    scores are drawn and ranked 1, 2, 3 ...; other rows have no rank. Ties go to the
    smaller doc_id, a null one last; rows that repeat a doc_id are documents of their
    own, and where their scores are equal too, which of them comes first is open. Null
    texts have no features. An empty target or corpus gives the gains of smoothing
    alone. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = scratch.write(weigh(docs, gain, seed))
    fit = scored.where(F.col("n_words") >= min_words)
    size, top = fit.agg(F.count(F.lit(1)), F.coalesce(F.max("score"), F.lit(0))).first()
    drawn = size * percent // 100
    # Counted down from the highest score, digits beyond the range of scores are all zero and need no pass.
    keys = [F.lit(top) - F.col("score"), F.col("doc_id").isNull().cast("bigint"), F.coalesce("doc_id", F.lit(0).cast("bigint"))]
    ranked = radix_ranks(fit, keys, scratch)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn; all columns stay."""
    drawn = resample(docs, target, percent).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_importance_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 byte by byte: a distinct feature's bytes are those of its words with blanks between them.
OP11_SQL = rf"""
WITH t AS (
    SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
texts AS (
    SELECT row_number() OVER () AS r, 0 AS side, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
w AS (
    SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
runs AS (
    SELECT r, side, array_to_string(list_slice(ws, i, i + n), ' ') AS run
    FROM (SELECT r, side, ws, n, unnest(range(1, len(ws) - n + 1)) AS i FROM w, range({LONGEST_RUN}) x(n))),
seen AS (SELECT r, side, run, count(*) AS n FROM runs GROUP BY ALL),
sums AS (
    SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket
    FROM (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM seen)), t),
f AS (SELECT r, side, bucket, sum(n) AS n FROM seen JOIN sums USING (run) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM f GROUP BY bucket),
g AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {BUCKETS}))::DOUBLE / ((s + 1) * (sum(t) OVER () + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM b),
d AS (
    SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
x AS (
    SELECT doc_id, len(ws) >= {MIN_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM w LEFT JOIN d ON d.r = w.r WHERE side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS size FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * size // 100 THEN place END AS rank FROM o
"""
