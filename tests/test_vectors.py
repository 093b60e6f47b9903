import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import record_pairs, same
from pyspark.sql import functions as F

from twinfold.operators import clusters, vectors
from twinfold.plans import metric as metric_plan
from twinfold.plans import sparse, trees
from twinfold.plans.groups import value_groups


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "rid bigint, vec array<double>")


def brute_distance(a, b, metric):
    a, b = np.array(a, float), np.array(b, float)
    if metric == "cosine":
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 1.0 - float(a @ b) / ((na or 1) * (nb or 1))
    if metric == "euclidean":
        return float(np.linalg.norm(a - b))
    return float(np.abs(a - b).sum() if metric == "manhattan" else np.abs(a - b).max())


def sample(seed=0, n=45, d=5):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d)).round(2).tolist()
    return rows + [[x + 1e-4 for x in r] for r in rows[:5]] + rows[:6] + [[0.0] * d, [0.0] * d]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "chebyshev"])
def test_embedding_pairs(spark, small_blocks, metric):
    rows = sample()
    df = vecs(spark, rows).withColumnRenamed("vec", "e")
    d = {p: max(brute_distance(rows[p[0]], rows[p[1]], metric), 0.0) for p in itertools.combinations(range(len(rows)), 2)}
    top = max(d.values())
    want = {p: (1 - x / top) * 100 for p, x in d.items()}
    same(record_pairs(vectors.embedding_pairs(df, ["e"], metric=metric)), want)
    got = record_pairs(vectors.embedding_pairs(df, ["e"], metric=metric, min_similarity=80))
    same(got, {p: s for p, s in want.items() if s >= 80})
    bounds = vectors.vector_bounds(vecs(spark, rows), metric).first()
    assert bounds.max_distance == pytest.approx(top) and bounds.min_distance == pytest.approx(0, abs=1e-9)


def test_equal_and_single_vectors(spark):
    equal = vecs(spark, [[1, 2]] * 3).withColumnRenamed("vec", "e")
    assert set(record_pairs(vectors.embedding_pairs(equal, ["e"])).values()) == {100.0}
    one = vecs(spark, [[1, 2]]).withColumnRenamed("vec", "e")
    assert vectors.embedding_pairs(one, ["e"]).records().count() == 0


def test_scaling_and_combining(spark):
    df = spark.createDataFrame([(0, 1.0, 7, [1.0, 2.0]), (1, None, 7, [0.0, 1.0]), (2, 5.0, 7, [2.0, 2.0])], "rid bigint, x double, y int, e array<double>")
    x = np.array([1.0, 0.0, 5.0])
    z = (x - x.mean()) / x.std() * 0.5
    got = vectors.record_vectors(df, ["e"], ["x", "y"], {"x": 0.5, "e": 2.0}).orderBy("rid").collect()
    for r, e, s in zip(got, ([2.0, 4.0], [0.0, 2.0], [4.0, 4.0]), z):
        assert r.vec == pytest.approx([*e, s, 0.0])
    with pytest.raises(ValueError):
        vectors.combine_vectors(df, {})


def test_text_vectors(spark):
    df = spark.createDataFrame([(0, "red bolt"), (1, "Red  bolt"), (2, "blue nut")], "rid bigint, t string")
    rows = {r.rid: r.vec for r in vectors.record_vectors(df, ["t"], dims=64).collect()}
    assert rows[0] == rows[1] != rows[2]
    mine = vectors.record_vectors(df, ["t"], encoder=lambda c: F.array(F.length(c).cast("double")))
    assert sorted(r.vec[0] for r in mine.collect()) == [8.0, 8.0, 9.0]


def clustered(seed=1, groups=12, each=20, d=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(groups, 1, d)) * 20 + rng.normal(size=(groups, each, d)) * 0.3 + 50).reshape(-1, d).tolist()


@pytest.mark.parametrize("metric,cutoff", [("euclidean", 1.0), ("manhattan", 1.5), ("chebyshev", 0.8), ("cosine", 1e-4)])
def test_blocks_that_cannot_matter_are_skipped(spark, metric, cutoff):
    rows = clustered() + [[0.0] * 3] + [[50.0 + i % 3 * 0.01, 50.0, 50.0] for i in range(60)]  # a zero vector, and a hot cell
    spark.conf.set("spark.twinfold.vectorBlockRows", "16")
    try:
        df = vecs(spark, rows)
        groups, _ = value_groups(df, ["vec"])
        placed = metric_plan.place(groups, metric, groups.count())
        blocks = placed.blocks.count()
        near = metric_plan.block_pairs(placed, metric_plan.to_working(metric, cutoff))[0].count()
        far = metric_plan.block_pairs(placed, reach=placed.far)[0].count()
        assert near < 0.6 * blocks * (blocks + 1) / 2 and far < 0.6 * blocks * (blocks + 1) / 2
        assert placed.rows.groupBy("block").count().agg({"count": "max"}).first()[0] <= 40
        d = {p: brute_distance(rows[p[0]], rows[p[1]], metric) for p in itertools.combinations(range(len(rows)), 2)}
        got = {(r.rid_l, r.rid_r): r.distance for r in vectors.pair_distance(df, metric, cutoff).collect()}
        want = {p: x for p, x in d.items() if x <= cutoff}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        report = vectors.negative_vector_report(df, metric).first()
        bounds = vectors.vector_bounds(df, metric).first()
        assert bounds.max_distance == pytest.approx(max(d.values())) and bounds.lowest == pytest.approx(min(d.values()), abs=1e-9)
        assert report.pairs == len(d)
    finally:
        spark.conf.unset("spark.twinfold.vectorBlockRows")


@pytest.mark.parametrize("metric,cutoff", [("euclidean", 9.5), ("manhattan", 60.0), ("chebyshev", 2.2), ("cosine", 0.8)])
def test_vectors_that_rule_nothing_out_are_copied_few_times(spark, small_blocks, metric, cutoff):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 48)).tolist() + [[0.0] * 48] * 20
    df = vecs(spark, rows)
    ids = df.select(F.col("rid").alias("gid"), F.lit(1).cast("bigint").alias("n"), "vec")
    placed = metric_plan.place(ids, metric, len(rows))
    tiles = metric_plan.tiles(placed, float("inf"))
    assert tiles._df.count() <= 24 * len(rows) and tiles.count().count() >= 8
    d = {p: brute_distance(rows[p[0]], rows[p[1]], metric) for p in itertools.combinations(range(len(rows)), 2)}
    got = {(r.rid_l, r.rid_r): r.distance for r in vectors.pair_distance(df, metric, cutoff).collect()}
    want = {p: x for p, x in d.items() if x <= cutoff}
    assert 500 < len(want) < len(d) and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    bounds = vectors.vector_bounds(df, metric).first()
    assert bounds.max_distance == pytest.approx(max(d.values())) and bounds.lowest == pytest.approx(min(d.values()), abs=1e-9)


def test_hierarchies_over_groups_of_blocks(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(220, 12)).tolist()
    df = vecs(spark, rows)
    merges = trees.ward_merges(value_groups(df, ["vec"])[0]).collect()
    assert sorted(m.cost for m in merges) == pytest.approx(sorted(c for _, _, c in brute_ward(rows)))
    d = {p: brute_distance(rows[p[0]], rows[p[1]], "euclidean") for p in itertools.combinations(range(len(rows)), 2)}
    tree = clusters.density_tree(df, "euclidean").collect()
    eps = sorted(d.values())[400]
    want = brute_components(len(rows), [p for p, x in d.items() if x <= eps])
    got = brute_components(len(rows), sorted((r.rid_l, r.rid_r) for r in tree if r.distance <= eps))
    assert len(tree) == len(rows) - 1 and got == want
    assert {r.rid: r.cluster for r in clusters.cluster_density(df, eps, "euclidean").collect()} == want


def test_bounds_of_few_vectors(spark):
    for rows, top in (([[3.0, 4.0]], None), ([[0.0, 0.0], [0.0, 0.0]], 1.0), ([[1.0, 0.0], [-1.0, 0.0]], 2.0)):
        assert vectors.vector_bounds(vecs(spark, rows), "cosine").first().max_distance == top
    assert vectors.pair_distance(vecs(spark, [[1.0]]).limit(0), "euclidean").count() == 0


def brute_terms(texts, numbers, weights):
    """TF-IDF over the whole vocabulary, then the scaled numbers."""
    bags = [Counter((t if t is not None else "nan").lower().split()) for t in texts]
    held = Counter(w for b in bags for w in b)
    vocabulary = sorted(held)
    rows = [[weights[0] * b[w] * math.log((len(texts) + 1) / (held[w] + 1)) for w in vocabulary] for b in bags]
    for k, x in enumerate(numbers):
        x = np.array([0.0 if v is None else v for v in x])
        z = (x - x.mean()) / (x.std() or 1.0) * weights[1 + k]
        rows = [r + [v] for r, v in zip(rows, z.tolist())]
    return rows


@pytest.mark.parametrize("numbers,least", [(0, 30), (0, 97), (1, None), (1, 75), (2, 90)])
def test_texts_are_compared_by_all_their_words(spark, small_blocks, numbers, least):
    rng = random.Random(numbers)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(50)]
    texts += [t + " more" for t in texts[:12]] + texts[:4] + ["", "", None, "the", "the the", "UPPER upper"]
    columns = [[rng.choice([None, 1.0, 2.0, 30.0]) if k else float(len(t or "")) for t in texts] for k in range(numbers)]
    df = spark.createDataFrame([(i, t, *[c[i] for c in columns]) for i, t in enumerate(texts)],
                               "rid bigint, t string" + "".join(f", x{k} double" for k in range(numbers)))
    weights = {"t": 2.0, "x0": 0.5}
    rows = brute_terms(texts, columns, [2.0, 0.5, 1.0])
    d = {p: max(brute_distance(rows[p[0]], rows[p[1]], "cosine"), 0.0) for p in itertools.combinations(range(len(rows)), 2)}
    top = max(d.values())
    want = {p: (1 - x / top) * 100 for p, x in d.items()}
    found = vectors.embedding_pairs(df, ["t"], [f"x{k}" for k in range(numbers)], weights, min_similarity=least)
    same(record_pairs(found), {p: s for p, s in want.items() if least is None or s >= least})


def test_dense_text_vectors_ask_for_places(spark):
    df = spark.createDataFrame([(0, "a b")], "rid bigint, t string")
    for make in (lambda: vectors.record_vectors(df, ["t"]), lambda: vectors.embedding_pairs(df, ["t"], metric="manhattan")):
        with pytest.raises(ValueError):
            make()


def brute_components(n, edges):
    root = list(range(n))
    def up(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    heads = sorted({up(a) for a, _ in edges})
    touched = {x for e in edges for x in e}
    return {i: heads.index(up(i)) if i in touched else -1 for i in range(n)}


@pytest.mark.parametrize("metric,eps", [("euclidean", 1.2), ("cosine", 0.03), ("manhattan", 1.0)])
def test_density_clusters(spark, small_blocks, metric, eps):
    rows = sample(3)
    close = [
        p for p in itertools.combinations(range(len(rows)), 2)
        if max(brute_distance(rows[p[0]], rows[p[1]], metric), 0.0) <= eps
    ]
    want = brute_components(len(rows), close)
    got = {r.rid: r.cluster for r in clusters.cluster_density(vecs(spark, rows), eps, metric).collect()}
    assert got == want
    flat = vectors.pair_distance(vecs(spark, rows), metric, eps)
    again = {r.rid: r.cluster for r in clusters.cluster_pairs(flat, vecs(spark, rows), eps).collect()}
    assert again == want


def test_long_chain_is_one_component(spark):
    from twinfold.plans.components import components

    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(500, 501)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_a_round_of_components_is_three_shuffles(spark, monkeypatch):
    from twinfold.plans import components as module

    plans, write = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = [(a, b) for a in range(9) for b in (a + 1, a + 2)] + [(3, 1), (3, 1), (4, 4), (21, 20), (22, 20), (30, 30)]
    got = {r.node: r.root for r in module.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(11)}, 20: 20, 21: 20, 22: 20}
    assert max(p.count("Exchange hashpartitioning") for p in plans) == 3
    assert module.components(spark.createDataFrame([(5, 5)], "u bigint, v bigint")).count() == 0


def test_kmeans_hierarchical_pca_none(spark):
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(30, 4)) * 0.1 + c for c in (0, 5, 10)]).tolist()
    df = vecs(spark, rows)
    for found in (clusters.cluster_kmeans(df, 3), clusters.cluster_hierarchical(df, 3)):
        by = {}
        for r in found.collect():
            by.setdefault(r.cluster, set()).add(r.rid // 30)
        assert len(by) == 3 and all(len(v) == 1 for v in by.values())
    m = np.array(rows) - np.mean(rows, axis=0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = np.abs(u[:, :2] * s[:2])
    got = np.array([[abs(r.x), abs(r.y)] for r in clusters.project_2d(df).orderBy("rid").collect()])
    assert np.allclose(got, want, atol=1e-6)
    assert {r.cluster for r in clusters.no_clusters(df).collect()} == {-1}


def test_approximate_pairs_are_a_subset(spark):
    rows = [r for r in sample(6) if any(r)]
    for metric, limit in (("euclidean", 1.0), ("cosine", 0.1)):
        got = {(r.rid_l, r.rid_r): r.distance for r in vectors.ann_pairs(vecs(spark, rows), metric, limit).collect()}
        exact = {(r.rid_l, r.rid_r): r.distance for r in vectors.pair_distance(vecs(spark, rows), metric, limit).collect()}
        assert got and set(got) <= set(exact)
        assert all(abs(got[k] - exact[k]) < 1e-6 for k in got)


def test_distance_reports(spark):
    d = spark.createDataFrame([(0, 1, 0.5), (0, 2, -1e-9), (1, 2, 2.0)], "rid_l bigint, rid_r bigint, distance double")
    assert tuple(vectors.distance_bounds(d).first()) == (-1e-9, 2.0)
    assert vectors.negative_distances(d).count() == 1
    report = vectors.negative_distance_report(d).first()
    assert (report.negative, report.any_negative, report.lowest) == (1, True, d.agg({"distance": "min"}).first()[0])


def brute_ward(rows):
    """All mergers one at a time: the pair that adds the least variance first."""
    live = {i: ([i], np.array(r, float)) for i, r in enumerate(rows)}
    merges = []
    while len(live) > 1:
        cost, a, b = min((len(live[a][0]) * len(live[b][0]) / (len(live[a][0]) + len(live[b][0])) * ((live[a][1] - live[b][1]) ** 2).sum(), a, b)
                         for a, b in itertools.combinations(sorted(live), 2))
        merges.append((a, b, cost))
        (x, c), (y, e) = live[a], live.pop(b)
        live[a] = (x + y, (c * len(x) + e * len(y)) / (len(x) + len(y)))
    return merges


@pytest.mark.parametrize("tail", [4, 20])
def test_ward_is_exact(spark, monkeypatch, tail):
    monkeypatch.setattr(trees, "TAIL", tail)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(26, 3)).round(3).tolist()
    rows += rows[:3]  # copies merge first, at no cost
    df = vecs(spark, rows)
    want = brute_ward(rows)
    merges = trees.ward_merges(value_groups(df, ["vec"])[0]).collect()
    assert sorted(m.cost for m in merges) == pytest.approx(sorted(c for _, _, c in want)[3:])
    for k in (1, 9):
        got = {r.rid: r.cluster for r in clusters.cluster_hierarchical(df, k).collect()}
        again = brute_components(len(rows), [(a, b) for a, b, _ in sorted(want, key=lambda m: m[2])[:len(rows) - k]])
        same_groups = lambda d: {frozenset(i for i in d if d[i] == c) if c >= 0 else None for c in set(d.values())}
        lone = {frozenset([i]) for i, c in again.items() if c < 0}
        assert same_groups(got) == (same_groups(again) - {None}) | lone and len(set(got.values())) == k
    row = clusters.within_variance(df, clusters.cluster_hierarchical(df, 9)).first()
    assert row.within == pytest.approx(sum(sorted(c for _, _, c in want)[:len(rows) - 9])) and row.records == len(rows)


def test_ward_of_equal_gaps_ends(spark, monkeypatch):
    monkeypatch.setattr(trees, "TAIL", 1)
    df = vecs(spark, [[float(i), float(j)] for i in range(3) for j in range(3)])
    assert trees.ward_merges(value_groups(df, ["vec"])[0]).count() == 8
    assert trees.ward_merges(value_groups(df.limit(0), ["vec"])[0]).count() == 0


@pytest.mark.parametrize("metric,radii", [("euclidean", (0.6, 1.0, 1.6)), ("cosine", (0.01, 0.04, 0.2))])
def test_one_tree_gives_the_density_clusters_of_any_radius(spark, metric, radii):
    rows = sample(5, 20)
    df = vecs(spark, rows)
    tree = clusters.density_tree(df, metric).cache()
    assert tree.count() == len(rows) - 1
    d = {p: max(brute_distance(rows[p[0]], rows[p[1]], metric), 0.0) for p in itertools.combinations(range(len(rows)), 2)}
    for eps in radii:
        got = {r.rid: r.cluster for r in clusters.cluster_pairs(tree, df, eps).collect()}
        assert got == brute_components(len(rows), [p for p, x in d.items() if x <= eps])


@pytest.mark.parametrize("metric,limit", [("euclidean", 1.0), ("cosine", 1e-4)])
def test_approximate_search_finds_nine_tenths(spark, metric, limit):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(150, 1, 8)) * 20
    rows = (centre + rng.normal(size=(150, 6, 8)) * 0.15).reshape(-1, 8).tolist()
    df = vecs(spark, rows)
    found, exact = vectors.ann_pairs(df, metric, limit, tables=4, probes=4), vectors.pair_distance(df, metric, limit)
    row = vectors.ann_recall(found, exact).first()
    assert row.exact > 1_000 and row.recall >= 0.9
    assert found.join(exact, ["rid_l", "rid_r"], "left_anti").count() == 0
    assert vectors.ann_pairs(df.limit(0), metric, limit).count() == 0


def test_scatter_has_clusters_and_shown_values(spark):
    df = spark.createDataFrame([(i, [float(i % 3), float(i)], f"n{i}") for i in range(6)], "rid bigint, vec array<double>, name string")
    got = clusters.scatter(df, clusters.no_clusters(df), df, "name")
    assert got.columns == ["rid", "x", "y", "label", "bdv"] and {(r.label, r.bdv) for r in got.collect()} == {(-1, f"n{i}") for i in range(6)}


def test_approximate_search_measures_inside_the_buckets(spark, small_blocks):
    rows = [r for r in sample(7) if any(r)] + [[1.0, 2.0, 3.0, 4.0, 5.0 + i * 1e-3] for i in range(40)]  # a bucket of several blocks
    df = vecs(spark, rows)
    found = vectors.ann_pairs(df, "euclidean", 1.0)
    assert "v_l" not in found._jdf.queryExecution().toString()  # no pair travels with two vectors
    got = {(r.rid_l, r.rid_r) for r in found.collect()}
    spark.conf.set("spark.twinfold.vectorBlockRows", "4096")
    whole = {(r.rid_l, r.rid_r) for r in vectors.ann_pairs(df, "euclidean", 1.0).collect()}
    assert got == whole and len(got) == found.count() and {(a, b) for a, b in got if a >= len(rows) - 40} >= {(len(rows) - 40, len(rows) - 1)}


def test_approximate_search_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [-9.0, 4.0])]
    df = spark.createDataFrame(rows, "rid bigint, vec array<double>")
    got = [(r.rid_l, r.rid_r, round(r.distance, 6)) for r in vectors.ann_pairs(df, "euclidean", 0.5).collect()]
    assert got == [(1, 2, 0.01)] * 4  # one row for each two rows


def test_pairs_of_texts_do_not_carry_their_vectors(spark, monkeypatch):
    """Near copies make many pairs; a vector goes to each tile once, whatever ids repeat."""
    rng = np.random.default_rng(5)
    rows = []
    for gid in [*range(40), 7]:
        keys = rng.choice(500, 30, replace=False)
        rows.append((gid, 1 + gid % 3, [int(k) for k in keys], [float(x) for x in rng.normal(size=30)]))
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2 or a == 3]
    vectors = spark.createDataFrame(rows, "gid bigint, n bigint, k array<bigint>, w array<double>").cache()
    found = spark.createDataFrame(pairs, "gid_l bigint, gid_r bigint").cache()
    for tile in (256, 4):
        monkeypatch.setattr(sparse, "_TILE", tile)
        got = sorted(tuple(r) for r in sparse._pair_dots(found, vectors).collect())
        want = []
        for a, b in pairs:
            for x in (r for r in rows if r[0] == a):
                for y in (r for r in rows if r[0] == b):
                    other = dict(zip(y[2], y[3]))
                    want.append((a, b, x[1], y[1], sum(w * other.get(k, 0.0) for k, w in zip(x[2], x[3]))))
        want.sort()
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert [r[4] for r in got] == pytest.approx([r[4] for r in want])


@pytest.mark.parametrize("numbers", [["x"], ["x", "y"]])
def test_the_least_cosine_comes_from_few_pairs(spark, monkeypatch, numbers):
    """All texts share a word, so the ends of the table do not hold the least pair; long vectors are not compared pairwise."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["all"] * int(rng.integers(1, 9)) + [f"w{j}" for j in rng.integers(0, 30, 6)]), float(rng.normal() ** 3), float(rng.normal())) for i in range(160)]
    df = spark.createDataFrame(rows, "rid bigint, text string, x double, y double")
    compared, whole = [], sparse._dots
    monkeypatch.setattr(sparse, "_dots", lambda pairs, carry: compared.append(pairs.count()) or whole(pairs, carry))
    monkeypatch.setattr(sparse, "_POOL", 4)
    scaled = vectors.scaled_numerics(df, numbers)
    found = sparse.sparse_vectors(scaled.select(F.col("rid").alias("gid"), F.lit(1).cast("bigint").alias("n"), "text", *[f"scaled_{c}" for c in numbers]),
                                  {"text": 1.0}, [f"scaled_{c}" for c in numbers], 160)
    kept = [dict(zip(r.k, r.w)) for r in found.collect()]
    want = min(sum(w * b.get(k, 0.0) for k, w in a.items()) for a, b in itertools.combinations(kept, 2))
    assert sparse.least_cosine(found, 160, several=len(numbers) > 1) == pytest.approx(want, abs=1e-12)
    assert sum(compared) <= 28


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev"])
def test_bounds_measure_only_pairs_that_can_be_outermost(spark, small_blocks, monkeypatch, metric):
    """One matrix product rules out most pairs; the ends are the same to the last digit."""
    import pyarrow as pa

    from twinfold.plans import tiles

    rows = np.random.default_rng(3).normal(size=(400, 16))
    table = pa.table({"vec": pa.array(rows.tolist()), "gid": np.arange(400), "n": np.ones(400, np.int64), "block": np.arange(400) // 200,
                      "_own": np.arange(400) // 200, "_i": np.zeros(400, np.int64), "_j": np.ones(400, np.int64)})
    every = tiles.strip_distances(rows[:200], rows[200:], metric)
    measured, whole = [], tiles.strip_distances
    monkeypatch.setattr(tiles, "strip_distances", lambda a, b, m: measured.append(m) or whole(a, b, m))
    found = tiles.bounds_of(table, metric, lambda table, m, rows, others: rows, np.sort(every.ravel())[5], np.sort(every.ravel())[-5]).to_pylist()
    assert found == [{"low": every.min(), "high": every.max(), "negative": 0}]
    assert set(measured) == {"euclidean"} and found[0]["high"] == every.max()
    row = vectors.vector_bounds(vecs(spark, rows[:60].tolist()), metric).first()
    d = [brute_distance(a, b, metric) for a, b in itertools.combinations(rows[:60], 2)]
    assert row.max_distance == pytest.approx(max(d)) and row.lowest == pytest.approx(min(d))
