"""Near-copies of documents and vectors, benchmark passages and licences, against brute force."""

import itertools
import random
import textwrap

import numpy as np
import pytest
from near_brute import bag, components, slow_jaccard

from twinfold.llm import decontaminate, license_scan, minhash_near, vector_near
from twinfold.llm.common import word_hashes


def near_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            edited = [w if rng.random() > 0.01 else rng.choice(words) for w in base]
            out.append(" ".join(edited))
    hot = [rng.choice(words) for _ in range(60)]
    out += [" ".join(hot[:k] + [f"x{k}"] + hot[k + 1:]) for k in range(0, 60, 2)] + [" ".join(hot)] * 3
    return out + ["same line " * 30, "same line " * 31, "one two three", "One, two; three!", "one two", "", "  ", "...", None]


@pytest.mark.parametrize("block", [512, 4])
def test_near_documents_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_near, "BLOCK", block)
    monkeypatch.setattr(minhash_near, "LEADER_ROUNDS", 1 if block == 4 else 2)
    texts = near_texts()
    bags = [bag(t or "") for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if bags[i] and bags[j] and slow_jaccard(bags[i], bags[j]) >= 0.8 - 1e-9]
    want = components(range(len(texts)), links)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, class_id int, _copy string")
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_near.op7_near_documents(df).collect()}
    assert got == {i: (c, c == i) for i, c in want.items()}
    kept = minhash_near.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if c == i}


def test_fast_probability_jaccard_is_the_definition():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ({k: rng.randrange(1, 5) for k in rng.sample(range(20), rng.randrange(1, 15))} for _ in range(2))
        x, y = (tuple(np.array(v) for v in zip(*sorted(m.items()))) for m in (a, b))
        assert minhash_near.probability_jaccard(*x, *y) == pytest.approx(slow_jaccard(a, b), abs=1e-12)


def test_signatures_estimate_the_probability_jaccard():
    keys, counts, doc = minhash_near.shingles(["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q q"])
    sig = minhash_near.prob_minhash(keys, counts, doc, 2, slots=4096)
    a, b = (dict(zip(keys[doc == k].tolist(), counts[doc == k].tolist())) for k in (0, 1))
    assert (sig[0] == sig[1]).mean() == pytest.approx(slow_jaccard(a, b), abs=0.04)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_near, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    rows = []
    for i in range(300):
        v = centre[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(40)]  # a group of copies
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1),
             (404, rows[0][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1), (408, [float("inf")] + [1.0] * 15, 1)]
    usable = {i: (np.array(v), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0])
             and usable[a][0] @ usable[b][0] / (np.linalg.norm(usable[a][0]) * np.linalg.norm(usable[b][0])) >= 0.98]
    root = components([r[0] for r in rows], links)
    count = {i: sum(i in l for l in links) for i in root}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_near.op2_near_vectors(df).collect()}
    assert got == {i: (count[i], c, c == i) for i, c in root.items()} and len(links) > 900
    # The exact stop bound gives the same, and an empty table gives none.
    exact = {r.vec_id: r.n_links for r in vector_near.near_vectors(df, target=1.0).collect()}
    assert exact == count
    assert vector_near.op2_near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_near_vectors_equal_sql(spark, monkeypatch, seed):
    import duckdb

    monkeypatch.setattr(vector_near, "CELL_ROWS", 1)  # a cell for few vectors
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        v = rng.normal(size=32)
        for _ in range(rng.integers(1, 6)):  # copies around cosine 0.98, on either side
            rows.append((len(rows) * 2 - 100, (v + rng.normal(size=32) * rng.choice([0.05, 0.14, 0.2])).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(5)] + [(2000, None, 1), (2001, rows[0][1], None), (2002, [0.0] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = sorted(con.execute(vector_near.OP2_SQL).fetchall())
    assert sum(r[1] for r in want) > 60
    extra = df.selectExpr("vec_id", "embedding", "label", "1 AS rep", "2 AS cell", "3 AS n_links")
    assert sorted(tuple(r) for r in vector_near.op2_near_vectors(extra).collect()) == want


def test_near_vectors_of_repeated_and_missing_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (2, b, 0), (None, a, 0), (None, a, 0), (3, [0.0, 0.0, 1.0], 0)]
    got = sorted((tuple(r) for r in vector_near.op2_near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None), (None, 0, None, None), (3, 0, 3, True)], key=repr)


def test_cells_are_visited_in_order():
    a, b = np.array([0.3, 0.0, 0.1]), np.array([0.0, 0.25])
    got = list(vector_near.visit(a, b, 0.3))
    assert got == [(1, 0), (2, 0), (1, 1), (0, 0)]


def test_leaks(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    edited = items[3].split()
    edited[7], edited[19] = "new", "other"
    del edited[12]
    edited.insert(25, "more")
    docs = [noise(200), noise(50) + " " + items[1] + " " + noise(40), items[2].upper().replace(" ", ",  "), noise(30) + " " + " ".join(edited),
            None, "", "two words", noise(20) + " " + " ".join(items[5].split()[:8]), items[1] + "\n" + items[4]] + [noise(300)] * 30
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id bigint, text string, _leak int")
    bench = spark.createDataFrame([*enumerate(items), (20, None), (21, "a b")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op1_decontaminate(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (8, 1), (8, 4)}
    assert got[(1, 1)].score == 1.0 and (got[(1, 1)].first_word, got[(1, 1)].last_word) == (50, 79)
    assert 0.7 < got[(3, 3)].score < 1.0
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {1, 2, 3, 8}
    assert decontaminate.op1_decontaminate(df, bench.limit(0)).count() == 0
    assert decontaminate.op1_decontaminate(df.limit(0), bench).count() == 0


def test_edited_copies_beside_a_full_one(spark):
    """What many edited copies share is common, and still points to their item."""
    item = [f"k{i}" for i in range(30)]
    edited = list(item)
    for k in (5, 14, 23):
        edited[k] = f"new{k}"
    docs = ["a b c " + " ".join(item)] + ["d e " + " ".join(edited) + f" f{i}" for i in range(50)] + [" ".join(item[:3]) + f" g{i} h i j" for i in range(20)]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r.score for r in decontaminate.op1_decontaminate(df, bench).collect()}
    assert got == {0: 1.0, **{i: pytest.approx(0.8) for i in range(1, 51)}}
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == set(range(51, 71))


def edited_copy(rng, words, item, rate):
    out = []
    for w in item:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice(words)] if x < 2 * rate / 3 else [w, rng.choice(words)] if x < rate else [w]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_leaks_that_alignment_of_everything_finds(spark, monkeypatch, seed):
    """200 documents with 50 items: edited at random, among stock phrases that most of them share."""
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 16)
    monkeypatch.setattr(decontaminate, "HOT_KEYS", 50)
    monkeypatch.setattr(decontaminate, "_CUT_WORDS", 300)
    rng = random.Random(seed)
    words, stock = [f"v{i}" for i in range(60)], "which of the following is the best answer to this".split()
    items = [stock[:rng.randrange(11)] + [rng.choice(words) for _ in range(rng.randrange(3, 30))] for _ in range(46)]
    items += [items[0][:3], [x for w in items[1] for x in (w, w)], ["v1"], ["v1", "v2"]]
    docs = []
    for _ in range(196):
        own = [rng.choice(words) for _ in range(rng.randrange(40))] + stock * rng.randrange(3)
        for _ in range(rng.randrange(3)):
            own += edited_copy(rng, words, rng.choice(items[:48]), rng.choice([0, 0.2, 0.4, 0.6])) + [rng.choice(words) for _ in range(rng.randrange(9))]
        docs.append(own)
    interleaved = [x for k, w in enumerate(items[2]) for x in ([w, "new"] if k % 2 else [w])]
    docs += [interleaved, ["v1"], ["v1", "v2"], ["v1", "v2", "v3"]]
    numbered = lambda lists: {i: word_hashes([" ".join(x)])[0].view(np.int64) for i, x in enumerate(lists)}
    d, q = numbered(docs), numbered(items)
    want = {}
    for (i, x), (j, y) in itertools.product(d.items(), q.items()):
        if len(y) < 3:
            score = float(len(x) == len(y) and (x == y).all())
        else:
            score = decontaminate.align(x, y)[0] / len(y)
        if score >= 0.5:
            want[i, j] = score
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.op1_decontaminate(df, bench).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 150


def test_hits_are_joined_with_seeds_only(spark, monkeypatch):
    """Hits of common grams get their block where they are found: no join of its own, however many there are."""
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 4)
    monkeypatch.setattr(decontaminate, "HOT_KEYS", 50)
    plans, met = [], decontaminate._met

    def seen(hits, *args):
        out = met(hits, *args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(decontaminate, "_met", seen)
    text = "which of the following is the best answer to this"
    df = spark.createDataFrame([(i if i % 5 else None, f"{text} d{i}") for i in range(60)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.op1_decontaminate(df, bench).collect()} == {None, *(i for i in range(60) if i % 5)}
    assert decontaminate.keep_clean(df, bench).count() == 0
    assert [p.count("Join LeftOuter") for p in plans] == [1, 1]  # of seeds and common grams


def test_seeds_are_the_rarest_bigrams(spark):
    grams = spark.createDataFrame([(1, g, g, 12) for g in range(11)], "item bigint, gram bigint, place bigint, size bigint")
    counts = spark.createDataFrame([(g, 1 + (7 * g) % 11) for g in range(11)], "gram bigint, f bigint")
    got = {r.gram: r.support for r in decontaminate.seeds_of(grams, counts).collect()}
    # 5 of 11 bigrams are in every match, so 3 of the 9 rarest are.
    assert got == {g: 3 for g in range(11) if 1 + (7 * g) % 11 <= 9}


def odd_ids(spark, texts):
    """Texts under null, negative and repeated ids."""
    rows = [(i, t, "s", 1) for i in (None, None, -5, -5, 7) for t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, body string, item_id int")


def test_leaks_without_and_with_odd_ids(spark):
    item = " ".join(f"q{i}" for i in range(12))
    df = odd_ids(spark, [f"a b {item} c", "clean text here", None, ""])
    bench = spark.createDataFrame([(3, item), (3, item), (None, "q0 q1 q2 q3"), (-4, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.op1_decontaminate(df, bench).collect()}
    assert got == {(i, j, 1.0) for i in (None, -5, 7) for j in (3, None)}
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == 15 and not any(item in (r.text or "") for r in kept.collect())


def test_very_long_and_repeated_texts_hold_leaks(spark):
    rng = random.Random(1)
    item = [f"q{i}" for i in range(20)]
    long = " ".join([f"n{rng.randrange(900)}" for _ in range(60_000)] + item + [f"n{rng.randrange(900)}" for _ in range(60_000)])
    df = spark.createDataFrame([(1, long), (1, long), (2, " ".join(item * 500))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: (r.score, r.first_word) for r in decontaminate.op1_decontaminate(df, bench).collect()}
    assert got == {1: (1.0, 60_000), 2: (1.0, 0)}


def test_near_documents_without_and_with_odd_ids(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    near = base[:70] + ["x"] + base[71:]
    other = [f"u{i}" for i in range(40)]
    texts = [" ".join(t) for t in (base, near, other)]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, ""), (None, None),
                                (-3, texts[0]), (9, texts[0]), (9, texts[0])], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash_near.op7_near_documents(df).collect()), key=repr)
    assert got == sorted([(None, -3, None)] * 3 + [(None, None, None)] * 4 + [(-3, -3, True), (9, -3, False), (9, -3, False)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in minhash_near.keep_first(df).collect()), key=repr)
    assert kept == sorted([(-3, texts[0]), (None, texts[2]), (None, ""), (None, None)], key=repr)


def test_licences_of_odd_ids(spark):
    df = odd_ids(spark, ["Released under the MIT License.", "plain"])
    got = sorted(((r.doc_id, r.own_license) for r in license_scan.op6_license_scan(df.withColumnRenamed("body", "source")).collect()), key=repr)
    assert got == sorted([(None, "MIT")] * 4 + [(-5, "MIT")] * 4 + [(7, "MIT")] * 2, key=repr)


def test_places_passed_over_score_too_little():
    rng = random.Random(2)
    passed = 0
    for _ in range(300):
        x, y = (np.array([rng.randrange(9) for _ in range(rng.randrange(1, 9))]) for _ in range(2))
        if not decontaminate.can_reach(x, y):
            passed += 1
            assert decontaminate.align(x, y)[0] < decontaminate.MIN_SCORE * len(y)
    assert passed > 50


def test_alignment_is_smith_waterman():
    rng = random.Random(1)
    for _ in range(40):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h = np.zeros((len(y) + 1, len(x) + 1))
        for i, j in itertools.product(range(1, len(y) + 1), range(1, len(x) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if y[i - 1] == x[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(np.array(x), np.array(y))[0] == h.max()


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", mit + "\n" + "words of a long text " * 200), ("a/b/c/x.txt", "plain text"), ("a/b/y.txt", f"# {apache}\nplain"),
             ("a/b/COPYING.txt", apache), ("z/w.txt", "no licence here"), ("top.txt", None), (None, mit), ("a/b/c/x.txt", "plain text"), ("q.txt", "")]
    df = spark.createDataFrame([(*f, "m") for f in files], "path string, text string, license string")
    got = {(r.path, r.own_license, r.license, r.inherited_from) for r in license_scan.license_scan(df).collect()}
    assert got == {("a/LICENSE", "MIT", "MIT", None), ("a/b/c/x.txt", None, "Apache-2.0", "a/b"), ("a/b/y.txt", "Apache-2.0", "Apache-2.0", None),
                   ("a/b/COPYING.txt", "Apache-2.0", "Apache-2.0", None), ("z/w.txt", None, None, None), ("top.txt", None, None, None),
                   (None, None, None, None), ("q.txt", None, None, None)}
    assert license_scan.license_scan(df).count() == len(files) and license_scan.license_scan(df.limit(0)).count() == 0


def test_licence_texts_of_several_lines(spark):
    from twinfold.llm.license_texts import TEXTS

    wrapped = lambda name, whole, mark: mark + f"\n{mark}".join(textwrap.wrap(next(t for n, t, w in TEXTS if (n, w) == (name, whole)), 60))
    code = "\nx = compute(y)\n" * 300
    files = [("m/any.txt", "Copyright (c) 2020 Someone\n\n" + wrapped("MIT", False, "")), ("m/x.py", "plain"), ("b/any.txt", wrapped("BSD-3-Clause", False, "")),
             ("b2/any.txt", wrapped("BSD-2-Clause", False, " * ")), ("g/x.py", "#!/bin/sh\n" + wrapped("GPL-3.0", False, "# ") + code), ("g/y.py", "plain"),
             ("f/any.txt", wrapped("GPL-2.0", True, "   ") + "\n\nPreamble\n" + code), ("f/y.py", "plain"), ("n.txt", "free software and any warranty " * 9)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.own_license, r.license) for r in license_scan.license_scan(df).collect()}
    assert got == {"m/any.txt": ("MIT", "MIT"), "m/x.py": (None, "MIT"), "b/any.txt": ("BSD-3-Clause",) * 2, "b2/any.txt": ("BSD-2-Clause",) * 2,
                   "g/x.py": ("GPL-3.0",) * 2, "g/y.py": (None, None), "f/any.txt": ("GPL-2.0",) * 2, "f/y.py": (None, "GPL-2.0"), "n.txt": (None, None)}
