"""Learned operators: held-out accuracy, exact counts, and probabilities that sum to one."""

import math
import random
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinfold.llm import class_lm, language_id, quality
from twinfold.llm.common import Memo, fold, table

SF = "/root/testdata/sf0.01"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 !!"), (10**6 + 3, "É" * 3000), (10**6 + 4, "the and of " * 60_000)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return table(spark, SF, "documents").unionByName(odd).withColumn("score", F.lit("clash")).cache()


def test_language(spark, docs):
    found = {r.doc_id: r for r in language_id.op10_language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(found) == len(truth)
    held = [i for i in truth if crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i in truth)
    known = [i for i in held if truth[i]]
    assert np.mean([found[i].lang_pred == truth[i] for i in known]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i, _ in ODD[:3]] == ["und"] * 3 and found[10**6 + 4].lang_pred == "en"
    kept = language_id.keep_known(docs)
    gone = set(truth) - {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and {i for i, _ in ODD[:3]} <= gone <= {i for i, _ in ODD}


def test_filters_hold_every_gram_and_few_others():
    rng = np.random.default_rng(0)
    gram = rng.integers(0, 2**63, 6_000).astype(np.uint64)
    lang = np.array(["a", "b", "c"], dtype=object)[np.arange(6_000) % 3]
    f = language_id._build(("a", "b", "c"), lang, gram)

    def found(x):
        out = np.full(len(x), ~np.uint64(0))
        for p in range(language_id.PROBES):
            out &= f.slots[0][((x >> np.uint64(32 * p)) & np.uint64(f.mask)).astype(np.int64)]
        return out

    for k in range(3):
        assert ((found(gram[k::3]) >> np.uint64(k)) & np.uint64(1) == 1).all()
        other = (found(rng.integers(0, 2**63, 200_000).astype(np.uint64)) >> np.uint64(k)) & np.uint64(1)
        assert other.mean() == pytest.approx(f.false_hits[k], rel=0.2)


def test_ngrams_are_counted_whole_and_few_are_held_at_once():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1500)] + [None, ""]
    langs = [["x", "y"][i % 2] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts, pa.string())], names=["lang", "text"])
    language_id._letters()
    tracemalloc.start()
    got = list(language_id._count(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts[:-2])) > 2_500_000 and peak < 50_000_000
    want = Counter()
    for lang, text in zip(langs, texts):
        for n, _, h in language_id._grams([text or ""]):
            want.update((lang, n, g) for g in h.view(np.int64).tolist())
    rows = [r for b in got for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r[:3]: r[3] for r in rows} == want and len(rows) == len(want)


def test_quality(spark, docs):
    labels = table(spark, SF, "labels")
    found = {r.doc_id: r for r in quality.op9_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    held = [i for i in truth if crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i in found)
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.93
    # Labels of the held-out fold change nothing.
    turned = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.op9_quality(docs, turned).collect()}
    assert again == {i: r.score for i, r in found.items()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found.values())
    assert {r.score for r in quality.op9_quality(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_language_model_counts_and_gain(docs):
    found = {r.doc_id: r for r in class_lm.op4_class_lm(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r.doc_id) for w in (r.text or "").encode().lower().split() + [b""])
    n, v, gain = sum(count.values()), len(count), [0.0, 0.0]
    for r in rows:
        words, got = (r.text or "").encode().lower().split() + [b""], found[r.doc_id]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held(r.doc_id), len(words), sum(w in count for w in words), n)
        assert got.base_score == pytest.approx(base, rel=1e-9)
        if held(r.doc_id):
            gain[0] += got.score
            gain[1] += got.base_score
    assert gain[0] > 0.9 * gain[1]  # log-probabilities: a tenth better at least


def test_model_probabilities_sum_to_one():
    n3 = np.random.default_rng(1).integers(0, 9, (6, 6, 6)).astype(float)
    assert np.allclose((10 ** class_lm.transitions(n3)).sum(axis=2), 1)
    # Within a shared unit: known words by discounted counts, one share for all unseen ones.
    counts, d = np.array([1, 1, 2, 5]), 0.6
    assert ((counts - d) / counts.sum()).sum() + d * len(counts) / counts.sum() == pytest.approx(1)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    unit, context, n = [], [], []
    for u in range(60):  # three kinds of units, each with its own contexts
        for x in range(10):
            unit.append(u)
            context.append((u % 3) * 10 + x)
            n.append(float(rng.integers(5, 50)))
    of = class_lm.exchange(np.array(unit), np.array(context), np.array(n), np.arange(60.0), classes=3)
    assert all(len(set(of[k::3])) == 1 for k in range(3)) and len(set(of)) == 3


def test_nothing_to_learn_from(spark, docs):
    none = docs.limit(0)
    labels = table(spark, SF, "labels")
    assert language_id.op10_language_id(none).count() == quality.op9_quality(none, labels).count() == class_lm.op4_class_lm(none).count() == 0
    bare = docs.where("doc_id >= 1000000")  # no language is given
    assert {r.lang_pred for r in language_id.op10_language_id(bare).collect()} == {"und"}


def test_clusters_see_every_token_and_pair(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}x{i % 7}" for i in range(90)], [1 / (i + 1) for i in range(90)], k=rng.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for name, share in (("UNIT_SHARE", 0.01), ("CONTEXT_SHARE", 0.02), ("PAIR_SHARE", 0.005), ("KNOWN_SHARE", 0.005)):
        monkeypatch.setattr(class_lm, name, share)
    train = F.lit(True)
    units = class_lm.make_units(class_lm.count_words(df, train))
    tokens = [len(class_lm.tokens(t)) for t in texts]
    assert units.sizes.sum() == units.total == sum(tokens) and len(units.sizes) < 90
    unit, context, n = class_lm.neighbours(df, train, units, spark.sparkContext.broadcast(units))
    # One end stands before each text, and a pair counts for both of its tokens.
    assert n.sum() == 2 * sum(tokens) and len({*zip(unit.tolist(), context.tolist())}) == len(n)
    left = [sum(k for u, c, k in zip(unit, context, n) if u == x and c < context.max() // 2 + 1) for x in range(len(units.sizes))]
    assert left == units.sizes.tolist()


def test_memo_is_bounded_and_keeps_what_is_used():
    calls = []
    memo = Memo(lambda keys: calls.extend(keys) or [k.upper() for k in keys], 4)
    for batch in ("abc", "ade", "afg", "ahi"):
        found = memo.look_up(set(batch))
        assert all(found[k] == k.upper() for k in batch) and len(memo.young) + len(memo.old) <= 10
    assert calls.count("a") == 1
