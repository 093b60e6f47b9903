import random

import pytest
from brute import lev_sim, record_pairs, same

from twinfold.operators.edit import levenshtein_pairs, qgram_candidates
from twinfold.plans import grams, texts


def _texts(alphabet, longest, count, seed):
    """Texts of the same pieces, many of them close, among them one that is empty."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, longest))) for _ in range(8)]
    found = {"", *base}
    while len(found) < count:
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, max(1, len(t) // 5))):
            t[rng.randrange(len(t))] = rng.choice([*alphabet, "", rng.choice(alphabet) * 2])
        found.add("".join(t))
    return sorted(found)


@pytest.fixture
def tiles(monkeypatch):
    """Sends small inputs to the tiles, and says how often."""
    seen, whole = [], texts.dense_pairs

    def counted(*args, **named):
        seen.append(args)
        return whole(*args, **named)

    from twinfold.plans import neighbours

    monkeypatch.setattr(grams, "FEW_MEETINGS", 0)
    monkeypatch.setattr(neighbours, "dense_pairs", counted)
    return seen


@pytest.mark.parametrize("alphabet,longest,t", [("ab/é", 24, 80.0), ("0123 ABé漢", 150, 85.0), ("abc", 40, 60.0)])
def test_crowded_texts_are_compared_in_tiles(spark, tiles, alphabet, longest, t):
    values = _texts(alphabet, longest, 60, longest)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(100, values[3])], "rid bigint, name string")
    spark.conf.set("spark.twinfold.textBlockRows", "16")
    try:
        got = record_pairs(levenshtein_pairs(rows, "name", t))
    finally:
        spark.conf.unset("spark.twinfold.textBlockRows")
    held = [*enumerate(values), (100, values[3])]
    want = {(i, j): 100 * lev_sim(a, b) for i, a in held for j, b in held if i < j and 100 * lev_sim(a, b) >= t - 1e-7}
    assert tiles and len(want) > 50
    same(got, want)


def test_crowded_texts_without_ids(spark, tiles):
    values = _texts("ab/é", 30, 50, 5)
    rows = spark.createDataFrame([(v,) for v in values * 2], "url string")
    got = {(r.v_l, r.v_r): r.sim for r in qgram_candidates(rows, "url", 80.0).collect()}
    assert tiles
    same(got, {(a, b): lev_sim(a, b) for a in values for b in values if a < b and lev_sim(a, b) >= 0.8 - 1e-9})


def test_repeated_and_missing_ids_meet_once(spark, tiles):
    values = _texts("0123 AB", 60, 40, 9)
    rows = spark.createDataFrame([(None if i % 7 == 0 else i // 2, v) for i, v in enumerate(values)], "rid bigint, name string")
    got = levenshtein_pairs(rows, "name", 85.0).across.select("gid_l", "gid_r", "n_pairs", "similarity").collect()
    want = {(*sorted((i // 2, j // 2)), 1, round(100 * lev_sim(a, b), 6)) for i, a in enumerate(values) for j, b in enumerate(values)
            if i % 7 and j % 7 and i // 2 != j // 2 and 100 * lev_sim(a, b) >= 85}
    assert tiles and len(got) == len(set(got))
    assert {(r[0], r[1], r[2], round(r[3], 6)) for r in got} == want
