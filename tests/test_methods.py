import itertools
import random
from datetime import datetime, timedelta

import pytest
from brute import lev_sim, record_pairs, same, tfidf_cosine, token_set, words
from people_rows import PEOPLE
from pyspark.sql import functions as F

from twinfold.operators import classifier, composite, edit, fuzzy, lsh, phonetic
from twinfold.plans.groups import all_pairs
from twinfold.sources import with_rid


def names(rng, n, alphabet="abc", low=0, high=9):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)]


def frame(spark, texts, *more):
    rows = [(i, t, *[m[i] for m in more]) for i, t in enumerate(texts)]
    schema = "rid bigint, t string" + "".join(f", c{i} string" for i in range(len(more)))
    return spark.createDataFrame(rows, schema)


def test_levenshtein_known_values(people):
    got = record_pairs(edit.levenshtein_pairs(people, "name"))
    assert len(got) == 12 * 11 // 2
    assert got[(5, 6)] == pytest.approx(77.777778, abs=1e-6)
    assert got[(6, 7)] == pytest.approx(88.888889, abs=1e-6)
    assert got[(3, 4)] == 87.5 and got[(8, 9)] == 80.0
    assert got[(10, 11)] == pytest.approx(66.666667, abs=1e-6)
    assert got[(1, 2)] == got[(1, 12)] == got[(2, 12)] == 100.0


def test_levenshtein_edge_texts(spark):
    df = spark.createDataFrame([(0, ""), (1, ""), (2, "a"), (3, None), (4, "nan"), (5, "é"), (6, "e")], "rid bigint, t string")
    got = record_pairs(edit.levenshtein_pairs(df, "t"))
    assert got[(0, 1)] == 100.0 and got[(0, 2)] == 0.0
    assert got[(3, 4)] == 100.0  # a missing text reads as "nan"
    assert got[(5, 6)] == 0.0  # one code point of one
    assert record_pairs(edit.levenshtein_pairs(df, "t", 90.0)) == {(0, 1): 100.0, (3, 4): 100.0}
    assert edit.levenshtein_pairs(df.where("rid = 2"), "t").pairs.count() == 0


@pytest.mark.parametrize("least", [30.0, 50.0, 75.0, 90.0])
def test_levenshtein_pruned_equals_exhaustive(spark, small_blocks, least):
    rng = random.Random(int(least))
    texts = names(rng, 70) + names(rng, 30, "xy", 12, 30)
    texts += [t[:-1] + "q" for t in texts[70:90]] + texts[:10]
    got = record_pairs(edit.levenshtein_pairs(frame(spark, texts), "t", least))
    want = {
        (i, j): s for i, j in itertools.combinations(range(len(texts)), 2)
        if (s := lev_sim(texts[i], texts[j]) * 100) >= least
    }
    same(got, want)


def test_long_texts_use_bigrams(spark, small_blocks):
    rng = random.Random(5)
    base = names(rng, 9, "abcdefgh", 44, 60)
    texts = base + [t[:20] + "zz" + t[24:] for t in base] + [t[3:] for t in base] + [t + t[:4] for t in base]
    for least in (60.0, 75.0, 87.0):
        got = record_pairs(edit.levenshtein_pairs(frame(spark, texts), "t", least))
        want = {
            (i, j): s for i, j in itertools.combinations(range(len(texts)), 2)
            if (s := lev_sim(texts[i], texts[j]) * 100) >= least
        }
        same(got, want)


def test_hot_prefix_texts_lose_nothing(spark, small_blocks):
    """Texts that share most bigrams, as generated identifiers do."""
    texts = [f"Customer#{i:09d}" for i in range(0, 3000, 29)] + [f"Customer of the region north-west number {i:06d}" for i in range(0, 900, 17)]
    got = record_pairs(edit.levenshtein_pairs(frame(spark, texts), "t", 88.0))
    want = {
        (i, j): s for i, j in itertools.combinations(range(len(texts)), 2)
        if (s := lev_sim(texts[i], texts[j]) * 100) >= 88.0
    }
    same(got, want)


@pytest.mark.parametrize("weights", [{"t": 1.0, "c0": 1.0, "c1": 1.0}, {"t": 1.0, "c0": 0.1, "c1": 0.0}, {"t": 0.2, "c0": 0.3, "c1": 0.25}])
@pytest.mark.parametrize("least", [None, 75.0])
def test_weighted_levenshtein(spark, small_blocks, weights, least):
    rng = random.Random(3)
    cols = [names(rng, 60, "ab", 1, 7), names(rng, 60, "xyz", 0, 4), rng.choices(["red", "reed", "blue"], k=60)]
    df = frame(spark, *cols)
    got = record_pairs(edit.weighted_levenshtein_pairs(df, weights, least))
    w = list(weights.values())
    want = {}
    for i, j in itertools.combinations(range(60), 2):
        s = sum(lev_sim(c[i], c[j]) * x for c, x in zip(cols, w)) / sum(w) * 100
        if least is None or s >= least:
            want[(i, j)] = s
    same(got, want)


def test_zero_weights_score_zero(people):
    got = edit.weighted_levenshtein_pairs(people, {"name": 0.0})
    assert set(record_pairs(got).values()) == {0.0} and got.records().count() == 66
    assert set(record_pairs(phonetic.metaphone_pairs(people, [])).values()) == {0.0}
    assert set(record_pairs(composite.composite_pairs(people)).values()) == {0.0}


# Codes by the published rules.
CODES = {
    "Thompson": "0MPSN", "Knight": "NT", "Phone": "FN", "Xavier": "SFR", "Wright": "RT", "Schmidt": "SKMTT",
    "Church": "XRX", "Edge": "EJ", "Bomb": "BM", "Science": "SNS", "Quick": "KK", "White": "WT", "Nation": "NXN", "": "",
}


def test_metaphone_codes(spark):
    from twinfold.functions import metaphone

    df = spark.createDataFrame([(k,) for k in CODES], "t string").select("t", metaphone("t").alias("c"))
    got = {r.t: r.c for r in df.collect()}
    assert got == CODES
    same_sound = spark.createDataFrame([("Elisabeth", "elizabeth")], "a string, b string")
    assert same_sound.where(metaphone("a") == metaphone("b")).count() == 1


def test_metaphone_pairs_compare_codes(spark, people, small_blocks):
    from twinfold.functions import metaphone

    codes = {r.rid: r.c for r in people.select("rid", metaphone("name").alias("c")).collect()}
    want = {p: lev_sim(codes[p[0]], codes[p[1]]) * 100 for p in itertools.combinations(sorted(codes), 2)}
    same(record_pairs(phonetic.metaphone_pairs(people, ["name"])), want)
    same(record_pairs(phonetic.metaphone_pairs(people, ["name"], min_similarity=60)), {k: v for k, v in want.items() if v >= 60})
    equal = {k for k, v in want.items() if v == 100}
    assert set(record_pairs(phonetic.phonetic_candidates(people, "name"))) == equal


@pytest.mark.parametrize("least", [0.0, 60.0, 80.0])
def test_fuzzy(spark, small_blocks, least):
    rng = random.Random(11)
    vocabulary = ["red", "blue", "green", "bolt", "bolts", "nut", "washer", "wsher", "a", "xl", "Red!", "é", "--"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 4))) for _ in range(70)]
    got = record_pairs(fuzzy.fuzzy_pairs(frame(spark, texts), ["t"], threshold=least))
    want = {
        (i, j): float(s) for i, j in itertools.combinations(range(len(texts)), 2)
        if (s := token_set(texts[i], texts[j])) >= least
    }
    same(got, want)


def test_fuzzy_weighted_columns(spark, small_blocks):
    rng = random.Random(12)
    a = [" ".join(rng.choices(["red", "blue", "bolt", "bolts", "nut"], k=rng.randint(0, 3))) for _ in range(50)]
    b = rng.choices(["small", "smal", "large", ""], k=50)
    got = record_pairs(fuzzy.fuzzy_pairs(frame(spark, a, b), ["t", "c0"], {"t": 1.0, "c0": 0.2}))
    want = {
        (i, j): s for i, j in itertools.combinations(range(50), 2)
        if (s := (token_set(a[i], a[j]) + token_set(b[i], b[j]) * 0.2) / 1.2) >= 80.0
    }
    same(got, want)


def _days(x, y):
    return abs((x - y).days)


def brute_composite(rows, weights):
    texts, numbers, dates = zip(*rows)
    span = max(n for n in numbers if n is not None) - min(n for n in numbers if n is not None) + 1e-5
    known = [d for d in dates if d is not None]
    days = (max(known) - min(known)).days + 1e-5
    out = {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if numbers[i] is None or numbers[j] is None:
            out[(i, j)] = None
            continue
        d = 0.0 if dates[i] is None or dates[j] is None else 1 - _days(dates[i], dates[j]) / days
        parts = (lev_sim(texts[i], texts[j]), 1 - abs(numbers[i] - numbers[j]) / span, d)
        out[(i, j)] = sum(p * w for p, w in zip(parts, weights)) / sum(weights) * 100
    return out


@pytest.mark.parametrize("hours", [0, 24 * 60])
@pytest.mark.parametrize("least,w", [(None, (0.2, 1.0, 0.7)), (70.0, (0.2, 1.0, 0.7)), (93.0, (1.0, 1.0, 1.0))])
def test_composite(spark, small_blocks, hours, least, w):
    """Whole days, and times of day, where the floored difference has a direction."""
    rng = random.Random(hours + 1)
    start = datetime(2021, 1, 1)
    rows = []
    for _ in range(60):
        when = start + timedelta(days=rng.randint(0, 20), minutes=rng.randint(0, hours))
        rows.append((rng.choice(["low", "lower", "high"]), rng.choice([None, 1.0, 2.5, 9.0, 9.25]), rng.choice([None, when, when])))
    rows += rows[:8]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid bigint, t string, x double, d timestamp_ntz")
    weights = dict(zip(("t", "x", "d"), w))
    got = record_pairs(composite.composite_pairs(df, ["t"], ["x"], ["d"], weights, least))
    want = brute_composite(rows, w)
    if least is not None:
        want = {k: v for k, v in want.items() if v is not None and v >= least}
    same(got, want)


def test_composite_known_value_and_bad_dates(spark, people):
    # Ages span 40 years and differ by 5; dates span 300 days and differ by 30: (1 + 0.875 + 0.9) / 3.
    rows = [(1, "Torsten", 30, "2023-03-01"), (12, "Torsten", 35, "2023-03-31"), (3, "X", 20, "2023-01-01"), (4, "Y", 60, "2023-10-28")]
    df = with_rid(spark.createDataFrame(rows, "id int, name string, age int, visit_date string"), key="id")
    got = record_pairs(composite.composite_pairs(df, ["name"], ["age"], ["visit_date"]))
    assert got[(1, 12)] == pytest.approx(92.5, abs=1e-5)
    bad = df.withColumn("visit_date", F.when(F.col("id") == 4, "soon").otherwise(F.col("visit_date")))
    per_pair = record_pairs(composite.composite_pairs(bad, date_cols=["visit_date"]))
    assert per_pair[(1, 4)] == 0.0 and per_pair[(1, 12)] > 0
    assert set(record_pairs(composite.composite_pairs(bad, date_cols=["visit_date"], on_bad_date="column")).values()) == {0.0}


def test_composite_constant_number(spark):
    df = spark.createDataFrame([(0, 5), (1, 5)], "rid bigint, x int")
    assert record_pairs(composite.composite_pairs(df, numeric_cols=["x"])) == {(0, 1): 100.0}


def test_band_candidates(spark, small_blocks):
    rng = random.Random(2)
    xs = [rng.uniform(-50, 50) for _ in range(80)] + [7.0] * 30 + [None]
    df = spark.createDataFrame(list(enumerate(xs)), "rid bigint, x double")
    got = {tuple(r) for r in composite.band_candidates(df, "x", 3.0).collect()}
    want = {
        (i, j) for i, j in itertools.combinations(range(len(xs)), 2)
        if xs[i] is not None and xs[j] is not None and abs(xs[i] - xs[j]) <= 3.0
    }
    assert got == want


def brute_signature(text, n):
    import hashlib

    from twinfold.functions.minhash import PRIME, permutations

    hs = [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % PRIME for t in set(text.lower().split())]
    return [min([(h * a + b) % PRIME for h in hs], default=PRIME) for a, b in permutations(n)]


def test_minhash_signature_and_lsh(spark, small_blocks):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(25)]
    texts += [" ".join(t.split()[:-1]) + " other" for t in texts] + texts[:5] + ["", "  ", " ".join(f"x{i}" for i in range(1500))]
    df = frame(spark, texts)
    n = 64
    sigs = {r.rid: list(r.sig) for r in lsh.minhash_signatures(df, "t", n).collect()}
    want = {i: brute_signature(t, n) for i, t in enumerate(texts)}
    assert sigs == want
    bands, rows = lsh.band_shape(0.6, n)
    pairs = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if any(want[i][b * rows:(b + 1) * rows] == want[j][b * rows:(b + 1) * rows] for b in range(bands)):
            pairs[(i, j)] = sum(x == y for x, y in zip(want[i], want[j])) / n * 100
    same(record_pairs(lsh.lsh_pairs(df, "t", 0.6, n)), pairs)
    same(record_pairs(lsh.lsh_pairs(df, "t", 0.6, n, verify=True)), {k: v for k, v in pairs.items() if v >= 60})
    sets = [set(t.lower().split()) for t in texts]
    exact = {(i, j): 100.0 if not sets[i] | sets[j] else len(sets[i] & sets[j]) / len(sets[i] | sets[j]) * 100 for i, j in pairs}
    same(record_pairs(lsh.lsh_pairs(df, "t", 0.6, n, exact=True)), exact)


def test_band_shape():
    assert lsh.band_shape(0.8, 128) == (9, 13) and lsh.band_shape(0.5, 128) == (25, 5)


def test_pair_features_and_model(spark):
    texts = ["red bolt", "red gear", "", "red red bolt x", "Blue", None, "blue gear"]
    nums = [1.0, 4.0, None, 2.0, 2.5, 0.0, 1.0]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, nums))], "rid bigint, t string, x double")
    rows = classifier.pair_features(df, ["t"], ["x"]).collect()
    assert len(rows) == 21
    for r in rows:
        a, b = nums[r.rid_l], nums[r.rid_r]
        assert r.sim_t == pytest.approx(tfidf_cosine(texts[r.rid_l] or "", texts[r.rid_r] or ""), abs=1e-9)
        assert r.diff_x == (0 if a is None or b is None else abs(a - b))
    first = [r for r in rows if (r.rid_l, r.rid_r) == (0, 1)][0]
    assert first.sim_t == pytest.approx(0.336096927, abs=1e-8)

    many = spark.range(60).select(F.col("id").alias("rid"), F.concat(F.lit("item "), (F.col("id") % 10).cast("string"), F.lit(" aa")).alias("t"),
                                  (F.col("id") % 10).cast("double").alias("x"))
    pairs = all_pairs(many.select("rid")).select("rid_l", "rid_r")
    labels = pairs.withColumn("y", (F.col("rid_l") % 10 == F.col("rid_r") % 10).cast("int"))
    found = classifier.classifier_pairs(many, ["t"], ["x"], labels, pairs)
    scored = found.records().collect()
    assert scored and all(50 <= r.similarity <= 100 for r in scored)
    hits = [r for r in scored if r.rid_l % 10 == r.rid_r % 10]
    assert len(hits) >= 0.9 * len(scored)
    train, test = classifier.split_pairs(labels)
    assert train.count() + test.count() == 1770 and 250 < test.count() < 460


def test_selection_errors(people):
    from twinfold.operators import vectors

    for call in (
        lambda: edit.levenshtein_pairs(people, "nope"),
        lambda: edit.weighted_levenshtein_pairs(people, {"name": 1.0}, bdv="nope"),
        lambda: fuzzy.fuzzy_pairs(people, []),
        lambda: classifier.classifier_pairs(people),
        lambda: vectors.embedding_pairs(people),
        lambda: lsh.lsh_pairs(people, "nope"),
        lambda: vectors.embedding_pairs(people, numeric_cols=["age"], metric="hamming"),
    ):
        with pytest.raises(ValueError):
            call()


def test_copies_holding_a_third_stay_compact(spark, small_blocks):
    """A third of all rows are equal: one row stands for their pairs."""
    texts = ["same text"] * 100 + [f"other {i:03d}" for i in range(200)]
    found = edit.levenshtein_pairs(frame(spark, texts), "t", 88.0)
    inside = found.pairs.where("gid_l = gid_r").collect()
    assert [(r.gid_l, r.n_pairs, r.similarity) for r in inside] == [(0, 4950, 100.0)]
    assert found.pairs.agg(F.sum("n_pairs")).first()[0] == found.records().count()


def test_swapped_order_changes_nothing(spark):
    rng = random.Random(9)
    texts = names(rng, 30, "abcd", 2, 7)
    one = record_pairs(edit.levenshtein_pairs(frame(spark, texts), "t", 50.0))
    two = record_pairs(edit.levenshtein_pairs(frame(spark, texts[::-1]), "t", 50.0))
    same({(29 - j, 29 - i): s for (i, j), s in two.items()}, one)


def test_words_definition():
    assert words("Red, red BOLT") == ["bolt", "red"]


def test_terms_of_a_pair_travel_as_arrays(spark):
    from twinfold.operators import classifier

    texts = ["red bolt red", "red gear", "blue nut", "", "bolt gear red gear"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid bigint, t string")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "rid_l bigint, rid_r bigint")
    found = classifier.tfidf_cosine(classifier.term_counts(df, "t"), pairs)
    assert "term#" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.rid_l, r.rid_r): r.sim for r in found.collect()}
    weigh = lambda x, y: [x.count(t) * (1 if t in y else classifier.ONE_SIDED) for t in sorted({*x, *y})]
    want = {}
    for a in range(5):
        for b in range(a + 1, 5):
            x, y = texts[a].split(), texts[b].split()
            if {*x} & {*y}:
                u, v = weigh(x, y), weigh(y, x)
                want[a, b] = sum(i * j for i, j in zip(u, v)) / (sum(i * i for i in u) * sum(j * j for j in v)) ** 0.5
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_texts_of_the_same_pieces_meet_once(spark, small_blocks):
    from twinfold.plans import grams

    rows = [(i, f"https://www.example.com/en/{i * 37 % 1000}.html?page=2&ref={i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v string")
    found = grams.gram_pairs(df, "id", grams.qgrams("v", 2), F.lit(20), lambda: F.lit(True))
    assert found.count() == found.select("id_l", "id_r").distinct().count() == 60 * 59 // 2


def test_bands_carry_the_keys_of_earlier_bands_only(spark, small_blocks):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame([*rows, (50, rows[0][1])], "rid bigint, text string")
    signed = lsh.minhash_signatures(df, "text", 32).withColumnRenamed("rid", "gid")
    assert all(len(r.ks) == r.band for r in lsh.banded(signed, 16, 2).collect())
    sigs = {r.gid: r.sig for r in signed.collect()}
    bands, size = lsh.band_shape(0.3, 32)
    meet = {(i, j) for i, j in itertools.combinations(sorted(sigs), 2)
            if any(sigs[i][b * size:(b + 1) * size] == sigs[j][b * size:(b + 1) * size] for b in range(bands))}
    got = [tuple(r) for r in lsh.lsh_candidates(signed, 0.3, 32).collect()]
    assert len(meet) > 20 and len(got) == len(set(got)) and set(got) == meet
