import pytest
from brute import record_pairs
from pyspark.sql import functions as F

from twinfold import registry
from twinfold.operators import edit, reports
from twinfold.operators.composite import composite_pairs
from twinfold.plans.groups import PairTable
from twinfold.sources import (
    column_roles, fill_missing, read_records, validate, with_rid, write_artifacts, write_pairs_csv,
)


def test_report_labels_and_order(people):
    pairs = edit.levenshtein_pairs(people, "name")
    report = reports.rank_pairs(reports.to_report(pairs, people, "name"))
    rows = report.collect()
    assert report.columns == ["Record 1", "Record 2", "Similarity (%)"] and len(rows) == 66
    assert rows[0][0] == "Torsten (1)" and rows[0][2] == 100.0
    assert [r[2] for r in rows] == sorted([r[2] for r in rows], reverse=True)
    assert reports.top_pairs(report, 5).count() == 5


def test_missing_scores_come_last_and_never_pass(spark):
    rows = spark.createDataFrame([(0, 1, None), (0, 2, 50.0), (1, 2, 90.0)], "rid_l bigint, rid_r bigint, similarity double")
    assert [r.similarity for r in reports.rank_pairs(rows).collect()] == [90.0, 50.0, None]
    assert reports.filter_pairs(rows, 0.0).count() == 2


def test_histogram_counts_every_pair(people):
    pairs = edit.levenshtein_pairs(people, "name")
    bins = {r.bin: r.pairs for r in reports.similarity_histogram(pairs, 50).collect()}
    assert len(bins) == 50 and sum(bins.values()) == 66 and bins[49] == 3
    flat = {r.bin: r.pairs for r in reports.similarity_histogram(pairs.records(), 50).collect()}
    assert flat == bins


def test_matrix(spark, people):
    pairs = edit.levenshtein_pairs(people, "gender")
    wide = {r.row: r.asDict() for r in reports.similarity_matrix(pairs.records(), long=False).collect()}
    assert len(wide) == 12 and len(wide[1]) == 13
    assert wide[1]["2"] == 100.0 and wide[2]["1"] is None
    assert reports.similarity_matrix(pairs.records()).count() == 66
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    with pytest.raises(ValueError):
        reports.similarity_matrix(pairs.records(), long=False)
    spark.conf.unset("spark.sql.pivotMaxValues")


def test_graph(people):
    pairs = edit.levenshtein_pairs(people, "name")
    edges = reports.similarity_edges(pairs.records(), 80.0)
    strong = [p for p, s in record_pairs(pairs).items() if s >= 80.0]
    assert edges.count() == len(strong)
    degree = {}
    for p in strong:
        for x in p:
            degree[x] = degree.get(x, 0) + 1
    assert {r.node: r.degree for r in reports.similarity_nodes(edges).collect()} == degree
    assert {r.rid: r.degree for r in reports.record_degrees(pairs, 80.0).collect()} == degree
    universe = reports.record_universe(reports.filter_pairs(pairs.records(), 80.0))
    assert {r[0] for r in universe.collect()} == set(degree)
    assert {r[0] for r in reports.record_universe(pairs.at_least(80.0)).collect()} == set(degree)
    assert reports.similarity_edges(pairs.records(), 101.0).count() == 0


def test_attach_records(people):
    pairs = edit.levenshtein_pairs(people, "name", 95.0)
    rows = reports.attach_records(pairs, people, ["age"]).collect()
    assert {(r.rid_l, r.age_l, r.rid_r, r.age_r) for r in rows} == {(1, 31, 2, 64), (1, 31, 12, 36), (2, 64, 12, 36)}


def test_read_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,age,score,visit_date,ok\n1,"Ann, A",38,NA,2021-09-05,true\n2,null,,2.5,2021-01-01,false\n')
    df = read_records(spark, str(path))
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "age": "bigint", "score": "double", "visit_date": "string", "ok": "boolean"
    }
    assert [tuple(r) for r in df.collect()] == [
        (1, "Ann, A", 38, None, "2021-09-05", True), (2, None, None, 2.5, "2021-01-01", False)
    ]
    typed = read_records(spark, str(path), "id int, name string, age int, score float, visit_date date, ok string")
    assert dict(typed.dtypes)["visit_date"] == "date"


def test_positions_follow_the_rows(spark, tmp_path):
    spark.range(0, 1000).selectExpr("id * 7 as v").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = with_rid(df).collect()
    assert [r.rid for r in rows] == list(range(1000)) and [r.id for r in rows] == [r.rid for r in rows]
    assert [r.v for r in rows] == [r.v for r in df.collect()]
    assert with_rid(spark.createDataFrame([], "v int")).count() == 0


def test_write_and_read_back(spark, people, tmp_path):
    pairs = edit.levenshtein_pairs(people, "name", 80.0)
    report = reports.rank_pairs(reports.to_report(pairs, people, "name"))
    write_pairs_csv(report, str(tmp_path / "similarity_results.csv"), single_file=True)
    back = spark.read.csv(str(tmp_path / "similarity_results.csv"), header=True, inferSchema=True)
    assert back.columns == report.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, report.collect()))
    write_artifacts(people.select("rid"), people.select("rid"), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept/vectors")).count() == 12


def test_roles_validation_filling(spark, people):
    roles = column_roles(people)
    assert roles.string == ["name", "gender", "visit_date"] and roles.numeric == ["id", "age"] and roles.date == ["visit_date"]
    with pytest.raises(ValueError):
        validate(people, "name", [], need_one=True)
    df = spark.createDataFrame([(None, None)], "t string, x double")
    assert tuple(fill_missing(df, ["t"], ["x"]).first()) == ("", 0.0)


def test_registry(people):
    known = registry.methods()
    assert len(known) == 8
    defaults = {n: {p.name: p.default for p in m.parameters(people)} for n, m in known.items()}
    assert defaults["Fuzzy Matching"]["similarity_threshold"] == 80.0
    assert defaults["Locality-Sensitive Hashing (LSH)"] == {"text_column": "name", "threshold": 0.8, "num_perm": 128}
    assert defaults["Weighted Levenshtein Distance"]["weights"] == {"name": 1.0, "gender": 1.0, "visit_date": 1.0}
    assert defaults["Embedding Similarity"]["num_clusters"] == 5
    assert defaults["Machine Learning Duplicate Detection"]["similarity_threshold"] == 0.5
    with pytest.raises(ValueError):
        registry.run("Fuzzy Matching", people, "name", comparison_columns=["nope"])
    with pytest.raises(ValueError):
        registry.run("Levenshtein Distance", people, "name", depth=3)
    with pytest.raises(ValueError):
        registry.run("Soundex", people, "name")


def test_every_method_runs_by_name(people):
    given = {
        "Levenshtein Distance": {}, "Weighted Levenshtein Distance": {"weights": {"name": 1.0, "gender": 0.5}},
        "Metaphone (Smooth Similarity)": {"comparison_columns": ["name"]},
        "Fuzzy Matching": {"comparison_columns": ["name"]},
        "Composite Similarity": {"string_columns": ["name"], "numeric_columns": ["age"], "date_columns": ["visit_date"]},
        "Locality-Sensitive Hashing (LSH)": {"num_perm": 16},
        "Embedding Similarity": {"numeric_columns": ["age"], "distance_metric": "euclidean", "clustering_algorithm": "DBSCAN"},
        "Machine Learning Duplicate Detection": {"text_columns": ["name"], "numeric_columns": ["age"]},
    }
    for name in registry.methods():
        found = registry.run(name, people, "name", **given[name])
        rows = found.records().collect()
        assert all(0 <= r.similarity <= 100 and r.rid_l < r.rid_r for r in rows), name
        if "clustering_algorithm" in given[name]:
            assert found.artifacts["labels"].count() == found.artifacts["vectors"].count() == 12


def test_own_method_and_scorer(people):
    @registry.register_method
    class SameGender(registry.ComparisonMethod):
        @classmethod
        def name(cls):
            return "Same gender"

        def compare(self, df, bdv):
            base = edit.levenshtein_pairs(df, "gender")
            scored = registry.custom_scorer(base.across, lambda p: F.when(F.col("similarity") == 100, 100).otherwise(0))
            return PairTable(scored, base.members, base.inside)

    try:
        assert set(record_pairs(registry.run("Same gender", people, "name")).values()) == {0.0, 100.0}
    finally:
        registry._METHODS.pop("Same gender")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(people):
    for found in (
        edit.levenshtein_pairs(people, "name", 80.0),
        edit.weighted_levenshtein_pairs(people, {"name": 1.0, "gender": 1.0}, 80.0),
        composite_pairs(people, ["name"], ["age"], ["visit_date"], min_similarity=90.0),
    ):
        plan = plan_of(found.pairs)
        assert "CartesianProduct" not in plan and "Python" not in plan and "NestedLoop" not in plan


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["Record 1", "Record 2", "Similarity (%)"]
    assert e.entry(spark).count() > 0


def test_ranks_without_one_sort(spark, people):
    report = reports.to_report(edit.levenshtein_pairs(people, "name"), people, "name")
    in_order = [tuple(r) for r in reports.rank_pairs(report).collect()]
    ranked = sorted(tuple(r) for r in reports.ranked_pairs(report).select("rank", *report.columns).collect())
    assert [r[0] for r in ranked] == list(range(1, 67)) and [r[1:] for r in ranked] == in_order
    assert sorted(registry.report("Levenshtein Distance", people, "name").select("rank", *report.columns).collect()) == ranked
    assert reports.ranked_pairs(report.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 20, 66, 500])
def test_closest_pairs_lower_the_threshold_as_needed(people, n):
    asked = []

    def compare(least):
        asked.append(least)
        return edit.levenshtein_pairs(people, "name", least)

    got = [tuple(r) for r in reports.closest_pairs(compare, n).select("rid_l", "rid_r", "similarity").collect()]
    want = reports.top_pairs(edit.levenshtein_pairs(people, "name"), n).select("rid_l", "rid_r", "similarity").collect()
    assert got == [tuple(r) for r in want] and (None in asked) == (n > 20)


def test_top_pairs_look_at_all_pairs_once(spark):
    from twinfold.operators import reports
    from twinfold.plans.groups import PairTable

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(a, b, 1, float(100 - (a + b) % 7)) for a in range(0, 40, 2) for b in range(a + 2, 40, 2)]
    across = spark.createDataFrame(rows, "gid_l bigint, gid_r bigint, n_pairs bigint, similarity double")
    members = spark.createDataFrame([(g, g) for g in range(0, 40, 2)], "gid bigint, rid bigint")
    table = PairTable(across.mapInArrow(counted, across.schema), members)
    got = [(r.similarity, r.rid_l, r.rid_r) for r in reports.closest_pairs(lambda least: table, 9).collect()]
    assert got == sorted(((s, a, b) for a, b, _, s in rows), key=lambda r: (-r[0], r[1], r[2]))[:9]
    assert seen.value == len(rows)


def test_top_pairs_of_copies_come_in_order(spark):
    from brute import record_pairs
    from twinfold.operators import edit, reports

    names = ["anna", "anne", "anna", "bob", "anna", "anne", "bobb", "anna"]
    df = spark.createDataFrame(list(enumerate(names)), "rid bigint, t string")
    found = edit.levenshtein_pairs(df, "t")
    want = sorted(((-s, *p) for p, s in record_pairs(found).items()))
    for n in (1, 5, 8, 20, 50):
        got = [(-r.similarity, r.rid_l, r.rid_r) for r in reports.top_pairs(found, n).collect()]
        assert got == want[:n]
