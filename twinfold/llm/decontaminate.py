"""Benchmark decontamination: rare word bigrams point from documents to test items,
Smith-Waterman alignment tells copies, edited ones too, from chance.

An alignment of M matches and E errors scores M - E and holds at least M - 1 - E pairs
of neighbouring matches. So a score of half the item's n words needs n / 2 - 1 of its
n - 1 bigrams, at places that a third of them cannot lie beyond: E is n / 2 at most,
and so is the width of the band of diagonals that the matches are on.

1. Bigrams of the items are counted in the documents, by documents.
2. An item's seeds are its rarest bigrams, so many of them that a document which holds
   enough bigrams must hold ``SUPPORT`` seeds, or as many as it needs (pigeonhole).
   Rarity orders the seeds; no document is lost for what its bigrams have in common
   with others.
3. Documents are searched for seeds. A seed names a document, an item and a diagonal; a
   band of diagonals with enough different seeds is a place. Bigrams that very many
   documents hold are met in blocks.
4. Only documents with a place are read once more; the words around it are aligned
   with the item's words.

Bit sets of bounded size, of the bigrams and of the documents with a place, are tested
where the documents are read. They can pass too many, never too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, mix, slices, texts_of, windows, word_hashes

WORDS = 2
MIN_SCORE = 0.5  # of the score of an unchanged copy of the whole item
SUPPORT = 3
FILTER_BITS = 28  # of a bit set, in powers of two, at most: 32 MB
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
HOT_ROWS = 4096  # documents that hold a bigram in one block
HOT_KEYS = 65_536  # rows of a broadcast table of common bigrams, at most
_CHARS = 1 << 20
_CUT_WORDS = 1 << 20


def align(window: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and the place in ``window`` where it ends."""
    steps = np.arange(len(window) + 1) * GAP
    row = np.zeros(len(window) + 1)
    best, end = 0.0, 0
    for word in item:
        fit = np.maximum(row[1:] + GAP, row[:-1] + np.where(window == word, MATCH, MISMATCH))
        new = np.concatenate([[0.0], np.maximum(fit, 0.0)])
        row = np.maximum.accumulate(new - steps) + steps  # a gap in the item, of any length
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def can_reach(window: np.ndarray, item: np.ndarray) -> bool:
    """Whether enough of the item's words occur in ``window``, in any order, for ``MIN_SCORE``."""
    return int(np.isin(item, window).sum()) * MATCH >= MIN_SCORE * len(item)


def _item_words(batch: pa.RecordBatch):
    texts = texts_of(batch)
    words, owner = word_hashes(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(words.view(np.int64)))
    yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "words"])


def _grams(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of the words, and the place of each; a text of one word has that as its only gram."""
    gram, at = windows(words, owner, WORDS)
    lone = np.flatnonzero(np.bincount(owner)[owner] == 1) if len(owner) else np.zeros(0, np.int64)
    single, _ = windows(words[lone], np.arange(len(lone)), 1)
    return np.concatenate([gram, single]), np.concatenate([at, lone])


def _item_grams(batch: pa.RecordBatch):
    words = [w.view(np.uint64) for w in _rows(batch.column("words"))]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    sizes = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    gram, at = _grams(flat, owner)
    begin = np.cumsum(sizes) - sizes
    yield pa.RecordBatch.from_arrays(
        [batch.column("item").take(pa.array(owner[at])), pa.array(gram.view(np.int64)), pa.array(at - begin[owner[at]]), pa.array(sizes[owner[at]])],
        names=["item", "gram", "place", "size"])


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column without nulls as arrays, without copies."""
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return (flat[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()))


class BitSet:
    """64-bit keys as a bit set, 16 bits or more a key up to ``2 ** FILTER_BITS`` bits."""

    def __init__(self, keys: DataFrame, col: str):
        self.bits = max(16, min(FILTER_BITS, (16 * keys.count()).bit_length()))
        self.words = keys.select(self.slot(col).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("bits"))

    def slot(self, col: str):
        return F.col(col).bitwiseAND(F.lit((1 << self.bits) - 1))

    def array(self) -> np.ndarray:
        found, out = self.words.toArrow(), np.zeros(1 << (self.bits - 6), np.int64)
        out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
        return out.view(np.uint64)

    def sift(self, rows: DataFrame, col: str) -> DataFrame:
        """The rows whose key may be in the set; the broadcast table has a row per 64 bits."""
        met = rows.withColumn("_s", self.slot(col)).join(F.broadcast(self.words), F.shiftright("_s", 6) == F.col("w"))
        return met.where(F.expr("shiftright(bits, CAST(_s & 63 AS INT)) & 1") == 1).drop("_s", "w", "bits")


def _search(docs: DataFrame, keys: DataFrame):
    """A function over batches of ``docs``: for some texts at a time, from ``lo`` to ``hi``, the text of each word,
    the grams that may be in ``keys``, and the word that each starts at."""
    known = BitSet(keys, "gram")
    shared, mask = docs.sparkSession.sparkContext.broadcast(known.array()), np.uint64((1 << known.bits) - 1)

    def hits(batch):
        texts, bits = texts_of(batch), shared.value
        for lo, hi in slices(texts, _CHARS):
            words, owner = word_hashes(texts[lo:hi])
            gram, at = _grams(words, owner)
            slot = (gram & mask).astype(np.int64)
            hit = (bits[slot >> 6] >> (gram & np.uint64(63))) & np.uint64(1) == 1
            yield lo, hi, owner, gram[hit], at[hit]

    return hits


def _document_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, f``: how many documents hold each gram of the items; a task sends a row per gram."""
    hits = _search(docs, grams.select("gram").distinct())

    def count(batches):
        total: dict = {}
        for batch in batches:
            for _, _, owner, gram, at in hits(batch) if batch.num_rows else ():
                order = np.lexsort((gram, owner[at]))
                gram, text = gram[order], owner[at][order]
                first = np.ones(len(gram), bool)
                first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                for g, n in zip(*(x.tolist() for x in np.unique(gram[first].view(np.int64), return_counts=True))):
                    total[g] = total.get(g, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "f"])

    return docs.select("text").mapInArrow(count, "gram bigint, f bigint").groupBy("gram").agg(F.sum("f").alias("f"))


def seeds_of(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``item, gram, place, size, support, f``: the rarest grams of each item that its matches cannot all do without.

    ``support`` is how many of them a match has at least."""
    need = F.ceil(F.lit(MIN_SCORE) * F.col("size")).cast("int") - 1
    support = F.greatest(F.lit(1), F.least(F.lit(SUPPORT), need))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("f", "gram", "place"))
    # Grams that no document holds count too: a match must do without them.
    ranked = grams.join(counts, "gram", "left").withColumn("f", F.coalesce("f", F.lit(0))).withColumn("rank", rank)
    lead = F.greatest(F.col("size") - 1, F.lit(1)) - need + support
    return ranked.withColumn("support", support).where((F.col("rank") <= lead) & (F.col("f") > 0)).drop("rank")


def _common(seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """``gram, blocks``: grams in very many documents, which are met in blocks.

    They are those with more than 1/HOT_KEYS of all hits, so HOT_KEYS at most."""
    sizes = scratch.write(seeds.select("gram", "f").distinct())
    whole = sizes.agg(F.sum("f")).first()[0] or 0
    blocks = F.ceil(F.col("f") / F.lit(HOT_ROWS)).cast("bigint").alias("blocks")
    common = scratch.write(sizes.where(F.col("f") > max(HOT_ROWS, whole // HOT_KEYS)).select("gram", blocks))
    scratch.drop(sizes)
    return common


def _blocks(common: DataFrame):
    """A function over hits, their grams and a hash of each one's document: the block of its gram that a hit is in.

    Hits get their block where they are found, so that they are joined only once, with seeds."""
    rows = common.orderBy("gram").toArrow()
    shared = common.sparkSession.sparkContext.broadcast((rows.column("gram").to_numpy(), rows.column("blocks").to_numpy()))

    def block(gram, document):
        grams, blocks = shared.value
        if not len(grams):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        return (document % np.where(grams[at] == gram, blocks[at], 1).astype(np.uint64)).astype(np.int64)

    return block


def _met(hits: DataFrame, seeds: DataFrame, common: DataFrame) -> DataFrame:
    """Hits with the seeds of their gram and block; seeds of common grams are in all blocks."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1))
    seeds = seeds.join(F.broadcast(common), "gram", "left").withColumn("block", every).drop("blocks", "f")
    return hits.join(seeds.withColumnRenamed("place", "at"), ["gram", "block"])


def leak_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, body, item_id, score, first_word, last_word``: :func:`leaks` by rows.

    ``body`` is a hash of the text; with doc_id it names a row, or equal ones."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").withColumn("body", F.xxhash64("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    items = map_batches(items, _item_words, "item_id bigint, words array<bigint>").where(F.size("words") > 0)
    items = scratch.write(items.withColumn("item", F.monotonically_increasing_id()))
    grams = scratch.write(map_batches(items.select("item", "words"), _item_grams, "item bigint, gram bigint, place bigint, size bigint"))
    counts = scratch.write(_document_counts(docs, grams))
    seeds = scratch.write(seeds_of(grams, counts))
    found_in, common = _search(docs, seeds.select("gram").distinct()), _common(seeds, scratch)
    block_of = _blocks(common)

    def search(batch):
        ids = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
        document = mix(batch.column("body").to_numpy().view(np.uint64) ^ mix(ids))
        for lo, hi, owner, gram, at in found_in(batch):
            begin, size = np.searchsorted(owner, np.arange(hi - lo)), np.bincount(owner, minlength=hi - lo)
            own, gram = lo + owner[at], gram.view(np.int64)
            row = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("body").take(row), pa.array(gram), pa.array(block_of(gram, document[own])),
                 pa.array(at - begin[owner[at]]), pa.array(size[owner[at]])], names=["doc_id", "body", "gram", "block", "place", "length"])

    hits = map_batches(docs, search, "doc_id bigint, body bigint, gram bigint, block bigint, place bigint, length bigint", scan=True)
    # Bands of diagonals overlap by half, so that one of them holds all of a match.
    half = F.floor((F.col("size") + 1) / 2)
    band = F.floor((F.col("place") - F.col("at")) / half)
    met = _met(hits, seeds, common).where("size >= 3 OR length = size")
    met = met.select("doc_id", "body", "item", "size", "support", "at", F.explode(F.array(band - 1, band)).alias("band"))
    places = met.groupBy("doc_id", "body", "item", "size", "support", "band").agg(F.count_distinct("at").alias("n")).where("n >= support")
    places = scratch.write(places.select("doc_id", "body", "item", ((F.col("band") - 1) * half).alias("lo"),
                                         ((F.col("band") + 3) * half + F.col("size")).alias("hi")))
    wanted = scratch.write(places.groupBy("doc_id", "body").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("wanted")))

    def cut(batch):
        texts, lists = texts_of(batch), batch.column("wanted").to_pylist()
        doc, body = batch.column("doc_id"), batch.column("body")
        for lo, hi in slices(texts, _CHARS):
            words, owner = word_hashes(texts[lo:hi])
            cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
            held, size = [], 0
            for k in range(lo, hi):
                own = words[cuts[k - lo]:cuts[k - lo + 1]].view(np.int64)
                for item, start, end in _joined(lists[k], len(own)):
                    held.append((k, item, start, own[start:end]))
                    size += end - start
                    if size >= _CUT_WORDS:
                        yield _windows(doc, body, held)
                        held, size = [], 0
            if held:
                yield _windows(doc, body, held)

    def judge(batch):
        kept, score, low, high = [], [], [], []
        for k, (window, words, first) in enumerate(zip(_rows(batch.column("window")), _rows(batch.column("words")), batch.column("first").to_pylist())):
            if not can_reach(window, words):
                continue
            best, end = align(window, words)
            if best < MIN_SCORE * len(words):
                continue
            back, start = align(window[:end][::-1], words[::-1])
            kept.append(k)
            score.append(best / len(words))
            low.append(first + end - start)
            high.append(first + end - 1)
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in ("doc_id", "body", "item_id")), pa.array(score, pa.float64()),
                                          pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                         names=["doc_id", "body", "item_id", "score", "first_word", "last_word"])

    picked = BitSet(wanted, "body").sift(docs, "body")
    same = [F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("d.body") == F.col("w.body")]
    texts = picked.dropDuplicates(["doc_id", "body"]).alias("d").join(wanted.hint("merge").alias("w"), same)
    parts = map_batches(texts.select("d.doc_id", "d.body", "d.text", "w.wanted"), cut,
                        "doc_id bigint, body bigint, item bigint, first bigint, window array<bigint>")
    judged = map_batches(parts.join(items, "item"), judge,
                         "doc_id bigint, body bigint, item_id bigint, score double, first_word bigint, last_word bigint")
    found = _best(judged, "doc_id", "body", "item_id")
    found = scratch.write(found)
    scratch.drop(items, grams, counts, seeds, common, places, wanted)
    return found


def _joined(places: list[dict], size: int) -> Iterator[tuple[int, int, int]]:
    """``(item, start, end)`` within a text of ``size`` words, with places that overlap made one."""
    item, start, end = None, 0, 0
    for p in sorted(places, key=lambda p: (p["item"], p["lo"])):
        if p["item"] != item or p["lo"] > end:
            if item is not None:
                yield item, start, min(end, size)
            item, start, end = p["item"], max(0, p["lo"]), p["hi"]
        end = max(end, p["hi"])
    if item is not None:
        yield item, start, min(end, size)


def _windows(doc: pa.Array, body: pa.Array, held: list[tuple]) -> pa.RecordBatch:
    row, item, first, window = zip(*held)
    row = pa.array(row)
    ends = np.concatenate([[0], np.cumsum([len(w) for w in window])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(window)))
    return pa.RecordBatch.from_arrays([doc.take(row), body.take(row), pa.array(item, pa.int64()), pa.array(first, pa.int64()), lists],
                                      names=["doc_id", "body", "item", "first", "window"])


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("first_word")).alias("o"), "last_word")).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.score", (-F.col("b.o")).alias("first_word"), "b.last_word")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` of each document that holds an item.

    ``score`` is the alignment score over the item's number of words, 1 for an
    unchanged copy; rows are those of ``MIN_SCORE`` and more, the best place for
    each pair, the first of equal ones. All pairs of that score are found. Texts
    without words, null ones included, hold nothing and are no item. An item of one
    or two words, too short to be told from chance, is found where it is the whole
    text. Rows that repeat a doc_id or an item_id count as one document or item with
    the best score, as do all rows without one: their doc_id or item_id is null.
    """
    return _best(leak_rows(docs, items), "doc_id", "item_id")


def op1_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All leaks of ``items`` into ``docs``, see :func:`leaks`."""
    return leaks(docs, items)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, those without doc_id too; all columns stay."""
    found = leak_rows(docs, items).select("doc_id", "body").distinct().alias("leak")
    own = docs.alias("own")
    same = F.col("own.doc_id").cast("bigint").eqNullSafe(F.col("leak.doc_id")) & (F.xxhash64("own.text") == F.col("leak.body"))
    return own.join(found, same, "left_anti")
