"""Importance resampling, vector codes and line dedup against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import common, line_dedup, radix, resample, vector_codes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# Line dedup


def brute_lines(docs, min_chars=40, min_docs=5):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(upper)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs
                and i != max((d for d in holders[key(x)] if d is not None), default=None) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return sorted(out, key=repr)


def line_docs():
    rng = random.Random(5)
    long = ["".join(rng.choice("abÉ中xyz ") for _ in range(n)).strip() + "end of it, really" for n in (40, 41, 60, 300)]
    edge = ["k" * 39, "K" * 40, "É" * 40, "é" * 40]
    docs = []
    for i in range(60):
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f"  {x}\t\r", f"\x0b{x} "]) for x in rng.sample(long + edge, rng.randrange(6))]
        lines += [f"own line {i} " + "of some length that nobody else has at all"] * rng.randrange(3) + ["", "short"] * rng.randrange(2)
        rng.shuffle(lines)
        docs.append((i * 7 - 50, "\n".join(lines)))
    hot = "This line is in every one of these documents, and often twice."
    docs += [(1000 + i, f"{hot}\nbody {i}\n{hot.upper()} ") for i in range(80)]
    docs += [(None, None), (None, f"{hot}\nx"), (2000, ""), (2001, "\n\n"), (1003, f"{hot}\nanother row of this id"), (1003, f"{hot}\nanother row of this id"),
             (3000, "\n".join([hot] * 3 + ["z" * 50_000] + [f"{k} filler" for k in range(20_000)]))]
    return docs


def test_line_dedup_equals_brute_force_and_sql(spark, monkeypatch):
    docs = line_docs()
    df = spark.createDataFrame([(*d, 1, 2, "p") for d in docs], "doc_id bigint, text string, n_lines int, h int, pos string")
    want = brute_lines(docs)
    assert sum(r[2] for r in want) > 200
    names = "doc_id", "n_lines", "n_dropped", "kept_sha256"
    assert rows_of(line_dedup.op13_line_dedup(df), *names) == want
    monkeypatch.setattr(common, "HOT_KEYS", 20)  # some keys hot, some not
    assert rows_of(line_dedup.op13_line_dedup(df), *names) == want
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(line_dedup.OP13_SQL).fetchall(), key=repr) == want


def test_line_dedup_of_empty_and_other_bounds(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "A \nc"), (3, "a")], "doc_id bigint, text string")
    assert rows_of(line_dedup.dedup_lines(df, 1, 2), "doc_id", "text", "n_lines", "n_dropped") == [(1, "b", 2, 1), (2, "c", 2, 1), (3, "a", 1, 0)]
    assert line_dedup.op13_line_dedup(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a\nb")], "doc_id bigint, text string")
    assert {r.n_dropped for r in line_dedup.dedup_lines(nulls, 1, 1).collect()} == {0}


# Vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, w)), k) for k, w in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for _, _, v in kept:
                held[near(cut(v, p), book)[1]].append(cut(v, p))
            for k, xs in held.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    text = sha(",".join(str(c) for book in books for w in book for c in w))
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in kept]
    by_label = Counter()
    for _, label, f in found:
        by_label[label] += sum(x for x, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), by_label[label], text) for i, label, f in found), key=repr)


CODES = "vec_id", "code", "error", "label_error", "codebooks_sha256"


@pytest.mark.parametrize("seed,dim", [(1, 32), (2, 16), (3, 48)])
def test_vector_codes_equal_brute_force_and_sql(spark, monkeypatch, seed, dim):
    rng = np.random.default_rng(seed)
    rows = [(int(i) * 3 - 200, [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([0.02, 0.5])], int(rng.integers(4))) for i in rng.permutation(220)]
    rows += [(900 + k, rows[0][1], 1) for k in range(60)] + [(2000, [0.0] * dim, None), (2001, [-1.0 / 256] * dim, None)]
    bad = [(3000, None, 1), (3001, [None] + [0.1] * (dim - 1), 1), (3002, [float("nan")] * dim, 1), (3003, [float("-inf")] + [0.0] * (dim - 1), None)]
    df = spark.createDataFrame([(*r, "c") for r in rows + bad], "vec_id bigint, embedding array<float>, label int, code string")
    want = brute_codes(rows)
    assert rows_of(vector_codes.op12_vector_codes(df), *CODES) == want
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    assert rows_of(vector_codes.op12_vector_codes(df), *CODES) == want
    con = duckdb.connect()
    con.register("embeddings", df.drop("code").toArrow())
    assert sorted(con.execute(vector_codes.OP12_SQL).fetchall(), key=repr) == want


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    few = [(1, [0.5] * 16, 0), (1, [0.25] * 16, 0), (None, [0.1] * 16, None)]
    got = vector_codes.op12_vector_codes(spark.createDataFrame(few, schema))
    assert rows_of(got, *CODES) == brute_codes(few)
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [], 0), (3, [1.0] * 20, 1), (4, [1e300] * 16, 1), (5, [-1e300] * 16, 1)], schema)
    got = {r.vec_id: r for r in vector_codes.op12_vector_codes(mixed).collect()}
    assert {i: (r.error, len(r.code)) for i, r in got.items()} == {i: (0, 32) for i in range(1, 6)} and got[4].code != got[5].code
    assert vector_codes.op12_vector_codes(mixed.limit(0)).count() == 0
    coded, books = vector_codes.compress(spark.createDataFrame(few, schema))
    back = {tuple(r.embedding) for r in vector_codes.decode(coded, books).collect()}
    assert all(min(abs(b[0] - x) for b in back) <= 1 / 256 for x in (0.5, 0.25, 0.1))


def test_equal_average_search_is_exact_and_skips():
    rng = np.random.default_rng(0)
    for length, spread in ((1, 3), (4, 5), (4, 100), (7, 2)):
        x, book = rng.integers(-spread, spread, (400, length)), rng.integers(-spread, spread, (64, length))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        index, best, taken = vector_codes.nearest(x, book)
        assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
        if spread == 100:
            assert taken < 0.7 * d.size


# Importance resampling


def brute_resample(docs, target):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def runs(text):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        return len(w), [crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bags = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for _, _, x in bags for b in x), Counter(b for x in target for b in runs(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, n, x in bags:
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(map(gain, x))
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


DRAW = "doc_id", "n_features", "weight", "score", "rank"


@pytest.mark.parametrize("block,chars", [(1 << 14, 1 << 20), (64, 50)])
def test_resampling_equals_brute_force_and_sql(spark, monkeypatch, block, chars):
    monkeypatch.setattr(radix, "BLOCK_ROWS", block)
    monkeypatch.setattr(resample, "_CHARS", chars)
    rng = random.Random(9)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)] + ["中文", "x" * 100]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(rng.randrange(-500, 10**12), text(rng.randrange(15, 60))) for _ in range(110)] + [(77, "w1 " * 40)] * 90
    docs += [(None, "w2 " * 30), (None, None), (78, ""), (79, "..."), (80, "w3 " * 20), (81, "w3 " * 19), (82, text(5000))]
    target = ["w1 w2 w3 " * 9, None, "", text(80)]
    df = spark.createDataFrame([(*d, 5, 6, 7) for d in docs], "doc_id bigint, text string, place int, rank int, _block int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    want = brute_resample(docs, target)
    assert sum(r[4] is not None for r in want) >= 9
    assert rows_of(resample.op11_importance_resampling(df, bench), *DRAW) == want
    if block > 64:
        con = duckdb.connect()
        con.register("documents", df.select("doc_id", "text").toArrow())
        con.register("benchmark", bench.toArrow())
        assert sorted(con.execute(resample.OP11_SQL).fetchall(), key=repr) == want
        assert {r.doc_id for r in resample.draw(df, bench).collect()} == {r[0] for r in want if r[4]}
        assert resample.draw(df, bench).columns == df.columns


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, "one two " * 12) for i in range(40)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(resample.op11_importance_resampling(docs, none), *DRAW) == brute_resample([tuple(r) for r in docs.collect()], [])
    assert resample.op11_importance_resampling(docs.limit(0), none).count() == 0


def test_radix_ranks_are_a_stable_sort(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK_ROWS", 32)
    rng = random.Random(3)
    rows = [(rng.choice([-5, 0, 3, 2**62, -(2**63), 2**63 - 1]), rng.randrange(-2000, 2000)) for _ in range(500)]
    rows += [(0, 1)] * 200  # equal keys
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = sorted((r["rank"], r.a, r.b) for r in radix.radix_ranks(df, [F.col("a"), F.col("b")], common.Scratch(spark)).collect())
    assert [r[0] for r in got] == list(range(1, 701)) and [r[1:] for r in got] == sorted(rows)
