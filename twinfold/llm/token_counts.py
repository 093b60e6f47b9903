"""Token counts of whole texts; huge ones are encoded in overlapping chunks and spliced.

A chunk edge disturbs tokens only near it. The splitting expression of a byte-level
BPE is matched from left to right without memory: what follows a match depends on
the text from its end on. So if two neighbouring chunks both begin a match at the
same place, far enough from the end of the left chunk that neither a look-ahead nor
a special string can reach beyond it, then the left chunk's tokens before that place
and the right chunk's tokens after it are those of the whole text. Where an overlap
has no such place, it is widened, at last to the whole text.

Other texts are cut where a single space or line feed stands between characters
that are no white space: a match always begins there. Equal stretches are encoded
once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Memo, Scratch, map_batches, slices, texts_of

CHUNK = 32_768  # characters; longer texts are huge
OVERLAP = 1_024
GUARD = 32  # characters before a chunk's end that count as disturbed
LIMIT = 1024
_CHARS = 1 << 21


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=4)
def guard(path: str) -> int:
    """``GUARD``, or more when a special string is longer."""
    longest = max([len(t.content) for t in tokenizer(path).get_added_tokens_decoder().values()], default=0)
    return max(GUARD, 2 * longest)


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


# Characters whose normal form and lower case are the same by all rules: printable ASCII and Latin letters.
PLAIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ň]+")
BYTE_CHARACTERS = _byte_characters()
# Fixed value: the public splitting expression of byte-level BPE.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=4)
def _direct(path: str):
    """Model and special strings, where words can be given to the model itself: bytes by the public expression."""
    steps = json.loads(tokenizer(path).to_str())
    split = steps["pre_tokenizer"] or {}
    if steps["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    return tokenizer(path).model, [t["content"] for t in steps["added_tokens"]]


def word_counts(words: list[str], path: str, before: str) -> list[int]:
    """Tokens of each word after ``before``, which words that begin with a line feed lack."""
    model, special = _direct(path) or (None, [])
    out, rest, mapped = [0] * len(words), [], before.translate(BYTE_CHARACTERS)
    for k, word in enumerate(words):
        if model and word.isascii() and word.isalpha():
            out[k] = len(model.tokenize(mapped + word))
        elif model and PLAIN.fullmatch(word) and not any(s in word for s in special):
            parts = _SPLIT.findall(before + word)
            out[k] = sum([len(model.tokenize(p.encode().decode("latin-1").translate(BYTE_CHARACTERS))) for p in parts])
        else:
            rest.append(k)
    full = [words[k] if words[k][:1] == "\n" else before + words[k] for k in rest]
    for k, e in zip(rest, tokenizer(path).encode_batch_fast(full, add_special_tokens=False)):
        out[k] = len(e.ids)
    return out


@lru_cache(maxsize=4)
def _memo(path: str, before: str) -> Memo:
    return Memo(lambda words: word_counts(words, path, before))


_UNEVEN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> list[str]:
    """Parts that encode independently; each after the first has lost the space before it,
    unless it begins with a line feed."""
    if _UNEVEN.search(text):
        return _SINGLE_SPACE.split(text)
    return text.replace("\n", " \n").split(" ")


def count_tokens(texts: list[str], path: str) -> list[int]:
    out = []
    for lo, hi in slices(texts, _CHARS):
        parts = [stretches(t) for t in texts[lo:hi]]
        heads = _memo(path, "").fetch([[p[0] for p in parts]])[0]
        words = _memo(path, " ").fetch([p[1:] for p in parts])
        out += [head + sum(rest) for head, rest in zip(heads, words)]
    return out


def boundaries(text: str, path: str) -> tuple[list[int], list[int], int]:
    """Places where a match of the splitting expression begins, the tokens before each, and all tokens."""
    e = tokenizer(path).encode(text, add_special_tokens=False)
    words, offsets = e.word_ids, e.offsets
    place, before, last = [], [], object()
    for i, (w, (start, _)) in enumerate(zip(words, offsets)):
        if w is None or w != last:
            place.append(start)
            before.append(i)
        last = w if w is not None else object()
    return place, before, len(words)


def _chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """``(start, chunk with the overlap after it, does it reach the end)``"""
    for at in range(0, len(text), chunk):
        end = at + chunk + overlap >= len(text)
        yield at, text[at:at + chunk + overlap], end
        if end:
            return


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``, tokens as the library gives them.

    Null texts are empty and have none. Repeated rows are each counted; other
    columns are not read. No truncation, padding or added tokens; special strings
    inside a text are handled as the library does by default.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def short(batch):
        texts = texts_of(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count_tokens(texts, path), pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text")
    huge = rows.where(F.length("text") > CHUNK)
    counted = map_batches(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= CHUNK), short,
                          f"doc_id {kind}, n_bytes bigint, n_tokens bigint", scan=True)
    # A key of its own for each row, written down: doc_id may be null or repeated.
    todo = scratch.write(huge.withColumn("row", F.monotonically_increasing_id()))
    parts, chunk, overlap = [counted], CHUNK, OVERLAP
    while not todo.isEmpty():
        encoded = scratch.write(_encoded(todo, path, chunk, overlap))  # read by several joins
        done = scratch.write(_spliced(encoded, chunk))
        sizes = todo.join(done, "row", "left").select("row", "doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens")
        parts.append(scratch.write(sizes.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")))
        rest = scratch.write(sizes.where("n_tokens IS NULL").select("doc_id", "text", "row"))
        scratch.drop(todo, encoded, done)
        todo, chunk, overlap = rest, chunk * 8, overlap * 8
    scratch.drop(todo)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _encoded(todo: DataFrame, path: str, chunk_size: int, overlap: int) -> DataFrame:
    """``row, at, total, begin, stop`` of each chunk: its tokens, and the places where neighbours may meet."""
    edge = guard(path)

    def cut(batch):
        for row, text in zip(batch.column("row").to_pylist(), texts_of(batch)):
            for at, chunk, end in _chunks(text, chunk_size, overlap):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([at]), pa.array([end]), pa.array([chunk])],
                                                 names=["row", "at", "end", "chunk"])

    def encode(batch):
        row, at = batch.column("row"), batch.column("at")
        begin, stop, total = [], [], []
        for first, last, text in zip(at.to_pylist(), batch.column("end").to_pylist(), texts_of(batch, "chunk")):
            place, before, n = boundaries(text, path)
            total.append(n)
            low, high = [], []
            for p, b in zip(place, before):
                if first and p < overlap:
                    low.append({"place": first + p, "before": b})
                if not last and chunk_size <= p <= len(text) - edge:
                    high.append({"place": first + p, "before": b})
            begin.append(low)
            stop.append(high)
        marks = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))
        yield pa.RecordBatch.from_arrays([row, at, pa.array(total, pa.int64()), pa.array(begin, marks), pa.array(stop, marks)],
                                         names=["row", "at", "total", "begin", "stop"])

    marks = "array<struct<place:bigint,before:bigint>>"
    chunks = map_batches(todo.select("row", "text"), cut, "row bigint, at bigint, end boolean, chunk string")
    return map_batches(chunks.repartition("row", "at"), encode, f"row bigint, at bigint, total bigint, begin {marks}, stop {marks}")


def _spliced(encoded: DataFrame, chunk_size: int) -> DataFrame:
    """``row, n_tokens`` of the rows whose chunks all meet in a stable place."""
    # The chunk on the right starts one chunk size further on; both ends meet at the first common place.
    right = encoded.select("row", (F.col("at") - chunk_size).alias("at"), F.explode("begin").alias("r"))
    left = encoded.select("row", "at", F.explode("stop").alias("l"))
    meet = left.join(right, ["row", "at"]).where("l.place = r.place").groupBy("row", "at").agg(
        F.min(F.struct("l.place", F.col("l.before").alias("left"), F.col("r.before").alias("right"))).alias("m"))
    own = encoded.groupBy("row").agg(F.count(F.lit(1)).alias("chunks"), F.sum("total").alias("total"),
                                     F.max(F.struct("at", "total")).alias("end"))
    seams = meet.join(encoded.select("row", "at", "total"), ["row", "at"]).groupBy("row").agg(
        F.count(F.lit(1)).alias("seams"), F.sum(F.col("m.left") - F.col("total") - F.col("m.right")).alias("cut"))
    joined = own.join(seams, "row", "left").where(F.coalesce("seams", F.lit(0)) == F.col("chunks") - 1)
    return joined.select("row", (F.col("total") + F.coalesce("cut", F.lit(0))).alias("n_tokens"))


def op8_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``."""
    return token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
