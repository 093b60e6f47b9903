"""Text quality by compression: which labelled text makes a document shorter?

Two zstandard dictionaries are built, from text labelled good and text labelled
bad. Each document is compressed with both; the difference of the two sizes over
the document's own size, calibrated on labelled rows that no dictionary has seen,
is the probability that the document is good. The calibration also takes how far
the text shrinks at all: endless repetition leaves no difference to see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, below, fold, map_batches, texts_of

SAMPLE_DOCS = 4000  # labelled documents per class for a dictionary, and as many to calibrate, about
SAMPLE_PIECES = 20_000  # pieces per class that a dictionary is trained on, at most
PIECE_BYTES = 400
DICTIONARY_BYTES = 200_000
LEVEL = 3
_FRAME = 20  # bytes added to a text's size, so that tiny texts get no extreme ratio


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the difference, the logarithm of the smaller size over the text's, and 1


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)


def gains(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: bytes that the good dictionary saves over the bad one as a share of the
    text, the logarithm of the smaller size as a share of it, and 1."""
    first, second = _compressor(good), _compressor(bad)
    out = np.ones((len(texts), 3))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        a, b = len(first.compress(raw)), len(second.compress(raw))
        out[i, 0] = (b - a) / (len(raw) + _FRAME)
        out[i, 1] = np.log((min(a, b) + _FRAME) / (len(raw) + _FRAME))
    return out


def _dictionary(pieces: list[bytes]) -> bytes:
    if not pieces:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: their text itself serves
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve, by Newton steps; a weak prior keeps them finite."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    m = x / scale
    w = np.zeros(x.shape[1])
    prior = np.diag([1e-2] * (len(w) - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        slope = (m * (weight * p * (1 - p))[:, None]).T @ m + prior
        step = np.linalg.solve(slope, m.T @ (weight * (y - p)) - prior @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w / scale)


def _pieces(batch: pa.RecordBatch):
    doc, quality, piece, draw = [], [], [], []
    for key, q, text in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), texts_of(batch)):
        raw = text.encode("utf-8", "replace")
        for at in range(0, len(raw), PIECE_BYTES):
            doc.append(key)
            quality.append(q)
            piece.append(raw[at: at + PIECE_BYTES])
            draw.append(crc32(f"{key} {at}".encode()))
    yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(piece, pa.binary()), pa.array(draw, pa.int64())],
                                     names=["quality", "piece", "draw"])


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> QualityModel | None:
    """Fit on labelled rows that ``train`` selects; None when either class has no text.

    About ``SAMPLE_DOCS`` documents of each class make a dictionary and as many
    others calibrate, drawn by a hash of doc_id, so what is collected and
    broadcast is bounded. Dictionaries are trained on ``SAMPLE_PIECES`` pieces of the
    drawn texts, or all if they have fewer; calibration takes whole texts.
    """
    marked = labels.where(train & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rates = F.create_map(*[F.lit(x) for q, n in sizes.items() for x in (q, min(1.0, 2 * SAMPLE_DOCS / n))])
    drawn = marked.where(below(F.col("doc_id"), rates[F.col("quality")]))
    drawn = drawn.withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 0)
    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))
    pieces = scratch.write(map_batches(sample.where("fits").select("doc_id", "text", "quality"), _pieces,
                                       "quality int, piece binary, draw bigint"))
    good, bad = (
        _dictionary([bytes(r["piece"]) for r in pieces.where(F.col("quality") == q).orderBy("draw", "piece")
                     .limit(SAMPLE_PIECES).select("piece").collect()]) for q in (1, 0)
    )
    scratch.drop(pieces)

    def measure(batch):
        x = gains(texts_of(batch), good, bad)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("quality")],
                                         names=["gain", "size", "quality"])

    seen = map_batches(sample.where("NOT fits").select("text", "quality"), measure,
                       "gain double, size double, quality int").toPandas()
    scratch.drop(sample)
    x, y = np.column_stack([seen["gain"], seen["size"], np.ones(len(seen))]), seen["quality"].to_numpy()
    if len(set(y)) < 2:
        return QualityModel(good, bad, (1.0, 0.0, 0.0))
    weight = np.array([sizes[q] / max(1, (y == q).sum()) for q in (0, 1)])[y]
    return QualityModel(good, bad, _calibrate(x, y, weight * len(y) / weight.sum()))


def scores(texts: list[str], model: QualityModel | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    z = gains(texts, model.good, model.bad) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id, score, predicted`` of every row; null and empty texts get the calibrated prior.

    Without a model (labels of one class only) every score is 0.5. Repeated rows
    are each scored; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def work(batch):
        s = scores(texts_of(batch), shared.value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                         names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, predicted int", scan=True)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of fold 1 of 3 are never read."""
    found = score(docs, learn(docs, labels, fold("doc_id", 3) != 1))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored 0.5 or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fold("doc_id", 3) != 1))

    def work(batch):
        yield batch.filter(pa.array(scores(texts_of(batch), shared.value) >= 0.5))

    return map_batches(docs, work, docs.schema, scan=True)
