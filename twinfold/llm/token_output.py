"""Token ids in a compressed binary format: static range asymmetric numeral systems.

All files of one output share a frequency table of the ids, counted over the whole
corpus and scaled to a power of two. A frame holds whole documents in ascending
order of doc_id. Its ids are cut into blocks that decode independently: up to
``LANES`` coder states take turns, id by id, so that numpy codes a row of ids at a
time. A block starts with its final states, a checkpoint every ``CHECKPOINT`` rows
allows decoding from the middle, and CRC-32 sums guard block and frame.

Texts are encoded once: the ids are written down in a plain table, from which they are
counted and put in order.

Layout, little-endian. Frame: ``TKF2``, crc32 of what follows, counts of documents, of
those without doc_id (they come first) and of blocks (uint32 each); doc ids (int64),
numbers of ids (int64), sizes of the blocks in bytes (uint32), blocks. Block: header (number of ids, lanes, number of
words, number of checkpoints, crc32 of the ids, uint32 each), lane states (uint64),
checkpoints (their words read so far, uint32, then states), words (uint32).
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settings import shared_folder
from .common import Memo, Scratch, map_batches, slices, texts_of
from .token_counts import BYTE_CHARACTERS, PLAIN, tokenizer

MAGIC = b"TKF2"
LANES = 1024
ROWS_PER_BLOCK = 256
CHECKPOINT = 64  # rows
FRAME_TOKENS = 1 << 20  # a frame is closed once it has as many
_CHARS = 1 << 23
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


@dataclass(frozen=True)
class Table:
    """Scaled frequencies of the ids 0 .. n-1, their running sums, and the id of each slot."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray


def make_table(counts: np.ndarray) -> Table:
    """Frequencies that sum to a power of two, at least 1 for each id that occurs."""
    present = np.flatnonzero(counts)
    bits = max(12, min(24, int(max(1, len(present))).bit_length() + 4))
    freq = np.zeros(len(counts), np.int64)
    if len(present):
        share = counts[present] / counts[present].sum()
        f = np.maximum(1, np.floor(share * (1 << bits)).astype(np.int64))
        order = np.argsort(-f, kind="stable")
        excess, k = int(f.sum()) - (1 << bits), 0
        while excess:  # large frequencies give or take what rounding left over
            i = order[k % len(order)]
            change = max(1, int(f[i]) // 64)
            give = min(excess, change, int(f[i]) - 1) if excess > 0 else -min(-excess, change)
            f[i] -= give
            excess -= give
            k += 1
        freq[present] = f
    start = np.cumsum(freq) - freq
    slot = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)
    return Table(bits, freq.astype(np.uint64), start.astype(np.uint64), slot)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 16)))
    rows = -(-n // lanes)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(lanes, _LOW, np.uint64)
    words, marks, written = [], [], 0
    for t in range(rows - 1, -1, -1):
        row = ids[t * lanes:(t + 1) * lanes]
        x = state[:len(row)]
        f = table.freq[row]
        full = x >= (f << top)
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        words.append(out)
        written += len(out)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[:len(row)] = (q << bits) + (x - q * f) + table.start[row]
        if t and t % CHECKPOINT == 0:
            marks.append((written, state.tobytes()))
    body = [state.tobytes()]
    body += [np.uint32(written - done).tobytes() + kept for done, kept in reversed(marks)]
    body += [np.concatenate(words[::-1]).tobytes()] if words else []
    head = np.array([n, lanes, written, len(marks), crc32(ids.astype("<u4").tobytes())], "<u4")
    return head.tobytes() + b"".join(body)


def decode_block(data: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block from place ``first`` up to ``last``; the whole block is checked against its sum."""
    n, lanes, count, checkpoints, checksum = (int(v) for v in np.frombuffer(data, "<u4", 5))
    last = n if last is None else min(last, n)
    at = 20
    state = np.frombuffer(data, "<u8", lanes, at).copy()
    at += 8 * lanes
    begin = min(first // lanes // CHECKPOINT, checkpoints)
    read = 0
    if begin:
        spot = at + (begin - 1) * (4 + 8 * lanes)
        read = int(np.frombuffer(data, "<u4", 1, spot)[0])
        state = np.frombuffer(data, "<u8", lanes, spot + 4).copy()
    words = np.frombuffer(data, "<u4", count, at + checkpoints * (4 + 8 * lanes)).astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = []
    for t in range(begin * CHECKPOINT, -(-last // lanes)):
        size = min(lanes, n - t * lanes)
        x = state[:size]
        low = x & mask
        row = table.slot[low.astype(np.int64)]
        out.append(row)
        x = table.freq[row] * (x >> bits) + low - table.start[row]
        need = np.flatnonzero(x < _LOW)
        x[need] = (x[need] << _WORD) | words[read:read + len(need)]
        read += len(need)
        state[:size] = x
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if first == 0 and last == n and crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block of token ids does not match its checksum")
    skip = begin * CHECKPOINT * lanes
    return ids[first - skip:last - skip]


def encode_frame(docs: list[tuple[int | None, np.ndarray]], table: Table) -> bytes:
    ids = np.concatenate([d[1] for d in docs])
    size = LANES * ROWS_PER_BLOCK
    blocks = [encode_block(ids[k:k + size], table) for k in range(0, len(ids), size)]
    nameless = sum(d[0] is None for d in docs)
    body = np.array([len(docs), nameless, len(blocks)], "<u4").tobytes() + np.array([d[0] or 0 for d in docs], "<i8").tobytes()
    body += np.array([len(d[1]) for d in docs], "<i8").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes()
    body += b"".join(blocks)
    return MAGIC + np.uint32(crc32(body)).tobytes() + body


def decode_frame(data: bytes, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of a frame's documents, in order."""
    body = memoryview(data)[8:]
    if data[:4] != MAGIC or crc32(body) != int(np.frombuffer(data, "<u4", 1, 4)[0]):
        raise ValueError("not a frame of token ids, or a damaged one")
    docs, nameless, blocks = (int(v) for v in np.frombuffer(body, "<u4", 3))
    keys = [None] * nameless + np.frombuffer(body, "<i8", docs, 12).tolist()[nameless:]
    sizes = np.frombuffer(body, "<i8", docs, 12 + 8 * docs)
    lengths = np.frombuffer(body, "<u4", blocks, 12 + 16 * docs)
    at, parts = 12 + 16 * docs + 4 * blocks, []
    for size in lengths.tolist():
        parts.append(decode_block(bytes(body[at:at + size]), table))
        at += size
    ids = np.concatenate(parts)
    ends = np.cumsum(sizes)
    for key, lo, hi in zip(keys, (ends - sizes).tolist(), ends.tolist()):
        yield key, ids[lo:hi]


@lru_cache(maxsize=2)
def _direct(path: str):
    """Splitting expression, BPE model and special strings, where words can be given to the model itself.

    Only for the steps known here: NFC, white space, lower case; one expression; bytes.
    """
    steps = json.loads(tokenizer(path).to_str())
    normal = [n.get("type") for n in (steps["normalizer"] or {}).get("normalizers", [])]
    split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = normal == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in split] == ["Split", "ByteLevel"]
    if not known or split[0]["behavior"] != "Removed" or not split[0]["invert"] or split[1]["add_prefix_space"] or split[1]["use_regex"]:
        return None
    return regex.compile(split[0]["pattern"]["Regex"]), tokenizer(path).model, [t["content"] for t in steps["added_tokens"]]


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    """Type code of the numbers that ids are kept as before they are compressed: 16 bits where all ids fit."""
    return "H" if tokenizer(path).get_vocab_size() <= 1 << 16 else "I"


def piece_ids(pieces: list[str], path: str) -> list[bytes]:
    """Ids of what the splitting expression finds, in lower case, from the model itself; a line feed has none."""
    model, kind = _direct(path)[1], id_type(path)
    marked = (p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARACTERS) for p in pieces)
    return [array(kind, [t.id for t in model.tokenize(p)] if p != "\n" else []).tobytes() for p in marked]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Memo:
    return Memo(lambda pieces: piece_ids(pieces, path))


def _plain_ids(words: pa.StringArray, path: str) -> pa.LargeBinaryArray:
    """:func:`word_ids` of plain words: words that differ in case or in the signs around them share their pieces."""
    together = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
    split = regex.compile(_direct(path)[0].pattern + "|\n")
    pieces = pa.array(split.findall(together.lower()), pa.string()).dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    ids = pa.array(_pieces(path).fetch([distinct])[0], pa.large_binary()).take(pieces.indices)
    _, starts, data = ids.buffers()
    starts = np.frombuffer(starts, np.int64, len(ids) + 1)
    feed = distinct.index("\n") if len(words) > 1 else -1
    between = np.flatnonzero(pieces.indices.to_numpy() == feed)  # the ends of all words but the last
    cuts = np.concatenate([[0], starts[between], starts[-1:]])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts.tobytes()), data or pa.py_buffer(b"")])


def word_ids(words: pa.StringArray, path: str) -> pa.LargeBinaryArray:
    """Ids of each word in numbers of :func:`id_type`, as the library gives them."""
    direct, plain = _direct(path), np.zeros(len(words), bool)
    if direct:
        fit = pc.match_substring_regex(words, f"^{PLAIN.pattern[:-1]}*$")
        for text in direct[2]:
            fit = pc.and_not(fit, pc.match_substring(words, text))
        plain = fit.to_numpy(zero_copy_only=False)
    rest = tokenizer(path).encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
    parts = [pa.array([array(id_type(path), e.ids).tobytes() for e in rest], pa.large_binary())]
    if plain.any():
        parts.append(_plain_ids(words.filter(pa.array(plain)), path))
    place = np.where(plain, (~plain).sum() + np.cumsum(plain) - 1, np.cumsum(~plain) - 1)
    return pa.concat_arrays(parts).take(pa.array(place))


def token_ids(texts: list[str], path: str, end_id: int) -> list[bytes]:
    """Ids of whole texts in numbers of :func:`id_type`, the end id after each.

    The tokenizer drops white space, so what blanks and line feeds part encodes by itself:
    each distinct word of some texts is encoded once, and Arrow puts the ids in order."""
    end, out = array(id_type(path), [end_id]).tobytes(), []
    for lo, hi in slices(texts, _CHARS):
        parts = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts[lo:hi]], pa.string()), " ")
        words = parts.flatten().dictionary_encode()
        ids = word_ids(words.dictionary, path).take(words.indices)
        _, starts, data = ids.buffers()
        cuts = np.frombuffer(starts, np.int64, len(ids) + 1)[parts.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        out += [bytes(data[a:b]) + end for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``; null texts have the end id only."""
    def work(batch):
        ids = token_ids(texts_of(batch), path, end_id)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, work, "doc_id bigint, ids binary", scan=True)


def count_ids(ids: DataFrame, path: str, end_id: int) -> np.ndarray:
    """How often each id occurs; as long as the vocabulary."""
    size, kind = max(tokenizer(path).get_vocab_size(), end_id + 1), id_type(path)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for own in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(own, kind), minlength=size) if len(own) > size else 0
            short = b"".join(own for own in batch.column("ids").to_pylist() if len(own) <= size)
            total += np.bincount(np.frombuffer(short, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


FRAME_FIELDS = "part int, part_start bigint, n_docs bigint, n_tokens bigint, data binary"


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Write the texts of ``docs`` to ``folder`` as frames in ascending order of doc_id.

    Null texts are empty: they have the end id only. Rows without doc_id come first;
    rows that repeat a doc_id stand next to each other, ordered by a hash of their
    ids. The counts of the ids are written to ``folder/table``, the frames to
    ``folder/frames``.
    """
    spark, kind = docs.sparkSession, id_type(path)
    if end_id >= 1 << (8 * array(kind).itemsize):
        raise ValueError("the end id is beyond the vocabulary")
    scratch = Scratch(spark)
    # The row's number splits a doc_id that very many equal rows share.
    ids = scratch.write(encoded(docs, path, end_id).withColumn("body", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()))
    counts = count_ids(ids, path, end_id)
    counted = pa.table({"id": pa.array(np.arange(len(counts))), "n": pa.array(counts)})
    spark.createDataFrame(counted).coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(make_table(counts))  # as long as the vocabulary

    def pack(batches):
        held, size, start, part = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for key, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append((key, np.frombuffer(own, kind)))
                size += len(held[-1][1])
                if size >= FRAME_TOKENS:
                    yield _frame(part, start, held, size, shared.value)
                    held, size, start = [], 0, start + size
        if held:
            yield _frame(part, start, held, size, shared.value)

    order = ["doc_id", "body", "row"]
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    packed = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(pack, FRAME_FIELDS)
    packed.write.option("compression", "none").parquet(f"{folder}/frames")
    scratch.drop(ids)


def _frame(part: int, start: int, docs: list, size: int, table: Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(docs)], pa.int64()),
         pa.array([size], pa.int64()), pa.array([encode_frame(docs, table)], pa.binary())],
        names=["part", "part_start", "n_docs", "n_tokens", "data"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``folder``, from its frames.

    Frames decode in parallel. Where one begins follows from the ids of the parts
    before its own (one number for each writing task) and of the frames before it.
    """
    counted = spark.read.parquet(f"{folder}/table").orderBy("id").toArrow()
    table = spark.sparkContext.broadcast(make_table(counted.column("n").to_numpy()))
    frames = spark.read.schema(FRAME_FIELDS).parquet(f"{folder}/frames")
    base, bases = 0, {}
    for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases[r["part"]] = base
        base += r["n"]

    def unpack(batch):
        for part, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "data"))):
            at += bases[part]
            keys, starts, sizes, sums = [], [], [], []
            for key, ids in decode_frame(data, table.value):
                keys.append(key)
                starts.append(at)
                sizes.append(len(ids))
                sums.append(crc32(ids.astype("<u4").tobytes()))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(frames.select("part", "part_start", "data"), unpack,
                       "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_output(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the ids written to files and read back from them."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, end_id, folder)
    return read_tokens(spark, folder)
