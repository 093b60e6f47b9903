"""Near-copies of documents by ProbMinHash: weighted shingles, bands, exact verification.

Similarity is the probability Jaccard of the counts of five-word shingles (for
counts of one it is the plain Jaccard). A shingle of count ``w`` arrives at
random slots as a Poisson process of rate ``w``; each slot keeps its earliest
arrival, and a shingle is given up once it comes later than every slot's best.
Two documents agree in a slot with the probability Jaccard as probability.

Documents with equal counts are one before any pair is formed. Documents that
share a band are candidates; a 192-bit sketch drops those far below the threshold
(five standard deviations) and the rest are verified on their whole texts. The pairs
of a bucket are never written out: its members meet a leader first, in several
rounds; then documents outside the leader's class are compared with the others block
by block, in one task each, and there a pair is skipped once its classes have met.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import star_forest
from .common import Scratch, map_batches, mix, slices, texts_of, windows, word_hashes

WORDS = 5
MIN_SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
# At similarity 0.8 sketches differ in 19 of 192 bits, with a standard deviation of 4.2.
MAX_BITS = 40
LEADER_ROUNDS = 2
BLOCK = 512  # documents per side of one comparison
FILTER_BITS = 24
_CHARS = 1 << 20
_STEP, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingle hash, count, text)``; a text of fewer than five words is one shingle."""
    words, owner = word_hashes(texts)
    keys, at = windows(words, owner, WORDS)
    doc = owner[at] if len(at) else np.zeros(0, np.int64)
    sizes = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
        h = sizes[i:i + 1].astype(np.uint64)
        for w in words[ends[i] - sizes[i]: ends[i]]:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
        keys, doc = np.append(keys, h), np.append(doc, i)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(np.append(starts, len(keys))), doc[starts]


def prob_minhash(keys: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures ``[docs, slots]``: the shingle that arrives first in each slot (0 without shingles)."""
    best = np.full(docs * slots, np.inf)
    first = np.zeros(docs * slots, np.uint64)
    time = np.zeros(len(keys))
    weight, step = counts.astype(float), 0
    latest = np.full(docs, np.inf)
    while len(keys):
        draw = mix(keys + np.uint64((int(_STEP) * (step + 1)) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / weight
        alive = time < latest[doc]
        keys, doc, time, weight, draw = keys[alive], doc[alive], time[alive], weight[alive], draw[alive]
        slot = doc * slots + (mix(draw ^ _SLOT) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        first[slot[won]] = keys[won]
        step += 1
        if step <= 4 or step % 4 == 0:
            active = np.unique(doc)
            latest[active] = best.reshape(docs, slots)[active].max(axis=1)
    return first.reshape(docs, slots)


def _sign(batch: pa.RecordBatch):
    texts, ids = texts_of(batch), batch.column("doc_id")
    for lo, hi in slices(texts, _CHARS):
        n = hi - lo
        keys, counts, doc = shingles(texts[lo:hi])
        sig = prob_minhash(keys, counts, doc, n)
        some = np.bincount(doc, minlength=n) > 0
        heads = [np.zeros(n, np.uint64) for _ in range(2)]
        for k, head in enumerate(heads):
            np.add.at(head, doc, mix(keys + np.uint64(k) * _SLOT + counts.astype(np.uint64) * _STEP))
        band = np.zeros((n, BANDS), np.uint64)
        for k in range(ROWS):
            band = band * np.uint64(0xD6E8FEB86659FD93) + sig[:, k::ROWS]
        band = mix(band + np.arange(BANDS, dtype=np.uint64)[None, :] * _SLOT).view(np.int64)
        bits = np.packbits((mix(sig ^ _STEP) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).reshape(n, 3)
        gone = ~some
        yield pa.RecordBatch.from_arrays(
            [ids.slice(lo, n)] + [pa.array(h.view(np.int64), mask=gone) for h in heads]
            + [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)),
                                        pa.array(band[some].ravel()))]
            + [pa.array(bits[:, k]) for k in range(3)],
            names=["doc_id", "bag1", "bag2", "bands", "s1", "s2", "s3"])


def probability_jaccard(a_keys, a_counts, b_keys, b_counts) -> float:
    """Sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    common, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = a_counts[i].astype(float), b_counts[j].astype(float)
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    own_a, own_b = a_counts.sum() - a.sum(), b_counts.sum() - b.sum()
    # At d, elements of a larger ratio count with a, those before it with b.
    return float((1.0 / ((own_a + np.cumsum(a[::-1])[::-1]) / a + (own_b + np.cumsum(b) - b) / b)).sum())


def _verify(batch: pa.RecordBatch):
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    texts: dict = dict(zip(a, texts_of(batch, "text_a")))
    texts.update(zip(b, texts_of(batch, "text_b")))
    ids = list(texts)
    bags: dict = {}
    for lo, hi in slices([texts[i] for i in ids], _CHARS):
        keys, counts, doc = shingles([texts[i] for i in ids[lo:hi]])
        cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            bags[ids[lo + k]] = keys[cuts[k]:cuts[k + 1]], counts[cuts[k]:cuts[k + 1]]
    sim = np.array([probability_jaccard(*bags[x], *bags[y]) for x, y in zip(a, b)])
    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], names=["a", "b", "similarity"])


def _pick(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids``, one row each.

    A bit set of hashed ids, of fixed size, keeps most other texts out of the shuffle.
    """
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def sift(batch):
        s = batch.column("s").to_numpy()
        yield batch.filter(pa.array((shared.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1)).select([0, 1])

    near = map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("s")), sift, "doc_id bigint, text string")
    return scratch.write(near.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    found = map_batches(pairs.join(left, "a").join(right, "b"), _verify, "a bigint, b bigint, similarity double")
    return found.where(F.col("similarity") >= MIN_SIMILARITY - 1e-9).select("a", "b")


def _compare(table: pa.Table) -> pa.Table:
    """Links that join classes, between the documents of one tile outside the leader's class and the others."""
    ids, own, group = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "minor", "c"))
    sketch = np.column_stack([table.column(f"s{k}").to_numpy() for k in (1, 2, 3)]).view(np.uint64)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
    band, asks = table.column("band")[0].as_py(), table.column("asks").to_numpy(zero_copy_only=False)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    far = np.zeros((len(x), len(y)), np.int64)
    for k in range(3):
        far += np.bitwise_count(sketch[x, k][:, None] ^ sketch[y, k][None, :])
    # Two documents outside the leader's class meet in two tiles; the lesser id asks.
    at = np.nonzero((far <= MAX_BITS) & (group[x][:, None] != group[y][None, :]) & (~own[y][None, :] | (ids[x][:, None] < ids[y][None, :])))
    left, right = x[at[0]], y[at[1]]
    same = bands[left] == bands[right]
    here = bands[left, same.argmax(axis=1)] == band  # a pair is compared in its first common band
    left, right = left[here], right[here]
    if not len(left):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    needed, texts = np.unique(np.concatenate([left, right])), table.column("text")
    keys, counts, doc = shingles([texts[k].as_py() or "" for k in needed.tolist()])
    vocabulary, word = np.unique(keys, return_inverse=True)
    ends = np.searchsorted(doc, np.arange(len(needed) + 1))
    size, mass = np.diff(ends), np.bincount(doc, counts, minlength=len(needed))
    plain = mass == size  # no shingle twice: the probability Jaccard is the plain one
    names, place = np.unique(group, return_inverse=True)
    parent, a, b = np.arange(len(names)), [], []
    for i in np.unique(left):
        k, row = np.searchsorted(needed, i), np.zeros(len(vocabulary))
        row[word[ends[k]:ends[k + 1]]] = counts[ends[k]:ends[k + 1]]
        others = right[np.searchsorted(left, i):np.searchsorted(left, i, side="right")]
        others = others[parent[place[others]] != parent[place[i]]]
        if not len(others):
            continue
        m = np.searchsorted(needed, others)
        first = np.cumsum(size[m]) - size[m]
        at = np.repeat(ends[m] - first, size[m]) + np.arange(size[m].sum())
        mine = row[word[at]]
        both = np.add.reduceat(mine > 0, first).astype(float)
        share = np.minimum(np.add.reduceat(mine, first) / mass[k], np.add.reduceat(np.where(mine > 0, counts[at], 0), first) / mass[m])
        sim = np.where(plain[m] & plain[k], both / (size[m] + size[k] - both), -1.0)
        for n in np.flatnonzero((sim < 0) & (share >= MIN_SIMILARITY - 1e-9)):  # no similarity exceeds the common share
            x, y = slice(ends[k], ends[k + 1]), slice(ends[m[n]], ends[m[n] + 1])
            sim[n] = probability_jaccard(keys[x], counts[x], keys[y], counts[y])
        for j in others[sim >= MIN_SIMILARITY - 1e-9]:
            if parent[place[j]] != parent[place[i]]:
                parent[parent == parent[place[j]]] = parent[place[i]]
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


_UNNAMED = 1 << 62  # keys from here on stand for texts without doc_id


def _key():
    """doc_id, or for a row without one a key that its text decides: equal texts are one document."""
    unnamed = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_UNNAMED - 1)) + F.lit(_UNNAMED)
    return F.coalesce(F.col("doc_id").cast("bigint"), unnamed)


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of every row: the least doc_id that links of 0.8 or more reach.

    Texts without a word, null ones included, link with nothing; rows that repeat
    a doc_id are one document. Rows without doc_id are compared like others, those of
    one text as one document; class_id is null where no row of the class has an id.
    Ids are below 2**62. Links between documents of one class may stay unchecked,
    since they change no class.
    """
    named = lambda c: F.when(F.col(c) < _UNNAMED, F.col(c)).alias(c)
    return keyed_classes(docs).select(named("doc_id"), named("class_id"))


def keyed_classes(docs: DataFrame) -> DataFrame:
    """:func:`near_classes` by the keys of rows, which no row lacks."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(_key().alias("doc_id"), "text")
    signed = scratch.write(map_batches(docs, _sign, "doc_id bigint, bag1 bigint, bag2 bigint, bands array<bigint>,"
                                                    " s1 bigint, s2 bigint, s3 bigint", scan=True))
    bags = signed.where("bag1 IS NOT NULL AND doc_id IS NOT NULL")
    heads = scratch.write(bags.groupBy("bag1", "bag2").agg(F.min("doc_id").alias("rep")))
    kept = bags.join(heads.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    kept = scratch.write(kept.drop("bag1", "bag2"))
    rows = kept.select("doc_id", F.explode("bands").alias("band"))
    shared = scratch.write(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"))
    crowd = scratch.write(rows.join(shared, "band").join(kept.drop("bands"), "doc_id"))
    texts = _pick(docs, crowd.select("doc_id").distinct(), scratch)
    spent = [kept, shared, crowd, texts]
    classes = None  # node, root of every document that is not the least of its class
    crowded = crowd.withColumn("c", F.col("doc_id"))
    head = F.struct("doc_id", "s1", "s2", "s3", "c")
    for turn in range(LEADER_ROUNDS + 1):
        buckets = crowded.groupBy("band").agg(
            F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"),
            F.min_by(head, F.xxhash64("doc_id", F.lit(turn))).alias("lead"))
        buckets = scratch.write(buckets.where("low < high AND n > 2" if turn else "low < high"))
        spent.append(buckets)
        if buckets.isEmpty():
            break
        met = crowded.join(buckets.select("band", "lead", "n"), "band")
        if turn < LEADER_ROUNDS:
            lead = F.col("lead.doc_id")
            bits = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"lead.s{k}"))) for k in (1, 2, 3))
            pairs = met.where((F.col("c") != F.col("lead.c")) & (bits <= MAX_BITS))
            pairs = pairs.select(F.least("doc_id", lead).alias("a"), F.greatest("doc_id", lead).alias("b")).distinct()
            found = scratch.write(_verified(pairs, texts))
        else:
            found = scratch.write(_tiles(met, kept, texts).applyInArrow(_compare, "a bigint, b bigint"))
        spent.append(found)
        if classes is not None and found.isEmpty():
            continue
        links = found.toDF("u", "v")
        links = links if classes is None else links.union(classes)  # classes so far stand for the links that made them
        classes = star_forest(links).toDF("node", "root")
        crowded = crowd.join(classes, F.col("doc_id") == F.col("node"), "left").select(
            "band", "doc_id", "s1", "s2", "s3", F.coalesce("root", "doc_id").alias("c"))
    members = signed.select("doc_id", "bag1", "bag2").join(heads, ["bag1", "bag2"], "left")
    if classes is not None:
        members = members.join(classes, F.col("rep") == F.col("node"), "left")
    else:
        members = members.withColumn("root", F.lit(None).cast("bigint"))
    scratch.drop(*spent)
    return members.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"))


def _tiles(met: DataFrame, kept: DataFrame, texts: DataFrame):
    """Members of unsettled buckets, dealt to tiles: a block outside the leader's class against a block of all."""
    met = met.withColumn("minor", F.col("c") != F.col("lead.c")).drop("lead")
    sizes = met.groupBy("band").agg(F.ceil(F.count_if("minor") / BLOCK).alias("asking"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("all"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    met = met.join(sizes, "band")
    asking = met.where("minor").withColumn("p", deal("asking")).withColumn("q", every("all")).withColumn("asks", F.lit(True))
    others = met.withColumn("q", deal("all")).withColumn("p", every("asking")).withColumn("asks", F.lit(False))
    rows = asking.unionByName(others).drop("n", "asking", "all")
    rows = rows.join(kept.select("doc_id", "bands"), "doc_id").join(texts, "doc_id")
    return rows.groupBy("band", "p", "q")


def op7_near_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept``: one row per document; the least doc_id of a class is kept."""
    return near_classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first of their class or have no class; all columns stay.

    A class whose rows all lack a doc_id keeps one row of one of its texts; such a
    text without a word is in no class, and all rows of it stay."""
    copies = keyed_classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("key")).distinct().alias("copy")
    mark = f"_key{uuid.uuid4().hex}"
    kept = docs.withColumn(mark, _key()).alias("own").join(copies, F.col(f"own.{mark}") == F.col("copy.key"), "left_anti")
    twins = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return kept.where(~twins).unionByName(kept.where(twins).dropDuplicates([mark])).drop(mark)
