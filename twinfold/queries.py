"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classifier, clusters, composite, edit, fuzzy, lsh, phonetic, reports, vectors
from .functions.phonetic import metaphone
from .functions.scores import parse_date, words
from .plans.groups import PairTable, all_pairs, copies, distinct_value_pairs, value_groups
from .plans.settings import cut_lineage, shared_folder
from . import registry
from .registry import custom_scorer
from .sources.records import column_roles, fill_missing, read_records, with_rid
from .sources.sinks import write_artifacts, write_pairs_csv

# The key column that orders the pairs of each table.
KEYS = {
    "supplier": "s_suppkey", "part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey",
    "documents": "doc_id", "embeddings": "vec_id", "nation": "n_nationkey", "pages": "page_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_rid(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key=KEYS[name])


def _out(pairs: PairTable | DataFrame) -> DataFrame:
    rows = pairs.pairs if isinstance(pairs, PairTable) else pairs
    return rows.withColumn("similarity", F.round("similarity", 6))


def lev_supplier(spark, d):
    supplier = table(spark, d, "supplier")
    report = reports.to_report(edit.levenshtein_pairs(supplier, "s_name", 94.0), supplier, "s_name")
    return reports.ranked_pairs(report.withColumn("Similarity (%)", F.round("Similarity (%)", 6)))


def lev_part_all(spark, d):
    return _out(edit.levenshtein_pairs(table(spark, d, "part"), "p_name"))


def lev_part_min80(spark, d):
    return _out(edit.levenshtein_pairs(table(spark, d, "part"), "p_name", 80.0))


def lev_customer_min94(spark, d):
    return _out(edit.levenshtein_pairs(table(spark, d, "customer"), "c_name", 94.0))


def qgram_supplier(spark, d):
    found = edit.qgram_candidates(table(spark, d, "supplier"), "s_name", 94.0)
    return found.withColumn("sim", F.round("sim", 6))


def lev_pages_url(spark, d):
    """Addresses are longer than 40 characters, and hundreds are distinct: pairs meet by grams."""
    return _out(edit.levenshtein_pairs(table(spark, d, "pages"), "url", 80.0))


def qgram_pages_url(spark, d):
    found = edit.qgram_candidates(table(spark, d, "pages"), "url", 80.0)
    return found.withColumn("sim", F.round("sim", 6))


def _described_customers(spark, d):
    customer = table(spark, d, "customer")
    text = F.concat_ws(" ", "c_name", "c_mktsegment", "c_nationkey", F.round("c_acctbal").cast("bigint"))
    return customer.select("rid", text.alias("described"))


def lev_customer_described(spark, d):
    return _out(edit.levenshtein_pairs(_described_customers(spark, d), "described", 85.0))


WEIGHTS = {"p_name": 1.0, "p_type": 0.5, "p_brand": 1.0}


def weighted_lev_part(spark, d):
    return _out(edit.weighted_levenshtein_pairs(table(spark, d, "part"), WEIGHTS, 90.0))


def weighted_lev_part_records(spark, d):
    found = edit.weighted_levenshtein_pairs(table(spark, d, "part"), WEIGHTS, 95.0).records()
    return found.withColumn("similarity", F.round("similarity", 6))


def metaphone_words(spark, d):
    docs = table(spark, d, "documents")
    tokens = docs.select(F.explode(words("text")).alias("word")).distinct()
    return tokens.select("word", metaphone("word").alias("code"))


def metaphone_part(spark, d):
    weights = {"p_name": 1.0, "p_type": 0.5}
    return _out(phonetic.metaphone_pairs(table(spark, d, "part"), ["p_name", "p_type"], weights, 80.0))


def phonetic_candidates_part(spark, d):
    return _out(phonetic.phonetic_candidates(table(spark, d, "part"), "p_name"))


def fuzzy_part(spark, d):
    weights = {"p_name": 1.0, "p_type": 0.5}
    return _out(fuzzy.fuzzy_pairs(table(spark, d, "part"), ["p_name", "p_type"], weights, 80.0))


def composite_orders(spark, d):
    return _out(composite.composite_pairs(
        table(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice"], ["o_orderdate"], min_similarity=99.5
    ))


def composite_customer(spark, d):
    weights = {"c_mktsegment": 0.5, "c_acctbal": 1.0, "c_nationkey": 1.0}
    return _out(composite.composite_pairs(
        table(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal", "c_nationkey"], weights=weights, min_similarity=99.0
    ))


def band_orders(spark, d):
    return composite.band_candidates(table(spark, d, "orders"), "o_totalprice", 10.0)


def ranges_orders(spark, d):
    orders = table(spark, d, "orders")
    one = composite.numeric_range(orders, ["o_totalprice"]).withColumn("k", F.lit(1))
    two = composite.date_range(orders, ["o_orderdate"]).withColumn("k", F.lit(1))
    return one.join(two, "k").select(
        F.round("range_o_totalprice", 6).alias("range_o_totalprice"), F.round("days_o_orderdate", 6).alias("days_o_orderdate")
    )


def lsh_documents(spark, d):
    return _out(lsh.lsh_pairs(table(spark, d, "documents"), "text"))


def lsh_documents_exact(spark, d):
    return _out(lsh.lsh_pairs(table(spark, d, "documents"), "text", exact=True, verify=True))


def lsh_documents_wide(spark, d):
    return _out(lsh.lsh_pairs(table(spark, d, "documents"), "text", threshold=0.5, num_perm=64, verify=True))


def _embedding(metric: str, min_similarity: float):
    def run(spark, d):
        found = vectors.embedding_pairs(
            table(spark, d, "embeddings"), ["embedding"], metric=metric, min_similarity=min_similarity
        )
        return _out(found)
    return run


# Thresholds that keep roughly the closest percent of pairs.
EMBEDDING_CUTS = {"cosine": 55.0, "euclidean": 30.0, "manhattan": 30.0, "chebyshev": 62.0}


def embedding_customer(spark, d):
    return _out(vectors.embedding_pairs(
        table(spark, d, "customer"), numeric_cols=["c_acctbal", "c_nationkey"],
        weights={"c_nationkey": 0.5}, metric="euclidean", min_similarity=99.5,
    ))


def embedding_documents(spark, d):
    return _out(vectors.embedding_pairs(
        table(spark, d, "documents"), ["text"], ["n_chars"], metric="cosine", min_similarity=95.0
    ))


def distance_bounds_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select("rid", F.col("embedding").alias("vec"))
    found = vectors.vector_bounds(rows, "manhattan")
    return found.select(F.round("min_distance", 6).alias("min_distance"), F.round("max_distance", 6).alias("max_distance"))


def negative_distances(spark, d):
    rows = table(spark, d, "embeddings").select("rid", F.col("embedding").alias("vec"))
    found = vectors.negative_vector_report(rows, "cosine")
    return found.withColumn("lowest", F.round("lowest", 6))


def pair_distance_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select("rid", F.col("embedding").alias("vec"))
    return vectors.pair_distance(rows, "euclidean", 1.0).withColumn("distance", F.round("distance", 6))


def scaled_numerics_customer(spark, d):
    rows = vectors.scaled_numerics(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], {"c_nationkey": 0.5})
    return rows.select(
        "rid", F.round("scaled_c_acctbal", 6).alias("scaled_c_acctbal"),
        F.round("scaled_c_nationkey", 6).alias("scaled_c_nationkey"),
    )


def column_moments_part(spark, d):
    cols = ["p_size", "p_retailprice"]
    row = vectors.column_moments(table(spark, d, "part"), cols)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def dbscan_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select("rid", F.col("embedding").alias("vec"))
    return clusters.cluster_density(rows, 0.55, "cosine")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("rid", F.col("embedding").alias("vec"))


def kmeans_embeddings(spark, d):
    return clusters.cluster_kmeans(_vectors(spark, d), 5)


def hierarchical_embeddings(spark, d):
    return clusters.cluster_hierarchical(_vectors(spark, d), 5)


def no_clusters_embeddings(spark, d):
    return clusters.no_clusters(table(spark, d, "embeddings"))


def project_embeddings(spark, d):
    rows = table(spark, d, "embeddings")
    xy = clusters.project_2d(rows.select("rid", F.col("embedding").alias("vec")))
    return xy.join(rows.select("rid", "label"), "rid")


def ann_embeddings(spark, d):
    return vectors.ann_pairs(_vectors(spark, d), "cosine", 0.55)


def term_counts_documents(spark, d):
    return classifier.term_counts(table(spark, d, "documents"), "text")


def _document_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, members, pairs)``: all near-equal pairs of records, copies of one text as one.

    A pair of texts stands for ``n_pairs`` pairs of records with the same features;
    the pairs among the copies of one text have equal ends.
    """
    groups, members = value_groups(docs.select("rid", "text", "n_chars"), ["text", "n_chars"])
    texts = groups.withColumnRenamed("gid", "rid")
    found = lsh.lsh_pairs(texts, "text", threshold).records().select("rid_l", "rid_r")
    for s in "lr":
        found = found.join(groups.select(F.col("gid").alias(f"rid_{s}"), F.col("n").alias(f"n_{s}")), f"rid_{s}")
    across = found.select("rid_l", "rid_r", (F.col("n_l") * F.col("n_r")).alias("n_pairs"))
    inside = copies(groups, F.lit(100.0)).select(F.col("gid_l").alias("rid_l"), F.col("gid_r").alias("rid_r"), "n_pairs")
    return texts, members, cut_lineage(across.unionByName(inside))


def pair_features_documents(spark, d):
    texts, _, pairs = _document_pairs(table(spark, d, "documents"))
    found = classifier.pair_features(texts, ["text"], ["n_chars"], pairs).join(pairs, ["rid_l", "rid_r"])
    return found.withColumn("sim_text", F.round("sim_text", 6))


def pair_features_nation(spark, d):
    found = classifier.pair_features(table(spark, d, "nation"), ["n_name"], ["n_regionkey"])
    return found.withColumn("sim_n_name", F.round("sim_n_name", 6))


def split_labels_documents(spark, d):
    features = classifier.pair_labels(_document_pairs(table(spark, d, "documents"))[2])
    train, test = classifier.split_pairs(features)
    return train.withColumn("held_out", F.lit(0)).unionByName(test.withColumn("held_out", F.lit(1)))


def classifier_documents(spark, d):
    """Do two near texts have the same quality label? Labels are known for some documents only."""
    texts, members, pairs = _document_pairs(table(spark, d, "documents"), 0.5)
    quality = spark.read.parquet(f"{d}/labels.parquet").groupBy(F.col("doc_id").alias("rid")).agg(F.max("quality").alias("q"))
    y = pairs.select("rid_l", "rid_r")
    for s in "lr":
        y = y.join(quality.select(F.col("rid").alias(f"rid_{s}"), F.col("q").alias(f"q_{s}")), f"rid_{s}")
    labels = y.select("rid_l", "rid_r", (F.col("q_l") == F.col("q_r")).cast("int").alias("y"))
    return _out(classifier.classifier_pairs(texts, ["text"], ["n_chars"], labels, pairs, members=members))


def _part_pairs(spark, d):
    return edit.levenshtein_pairs(table(spark, d, "part"), "p_name")


def histogram_part(spark, d):
    return reports.similarity_histogram(_part_pairs(spark, d), 50)


def histogram_orders(spark, d):
    found = composite.composite_pairs(
        table(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice"], ["o_orderdate"], min_similarity=99.5
    )
    return reports.similarity_histogram(found, 200)


def matrix_part(spark, d):
    cells = reports.similarity_matrix(_part_pairs(spark, d))
    return cells.withColumn("similarity", F.round("similarity", 6))


def matrix_wide_type(spark, d):
    part = table(spark, d, "part")
    wide = reports.similarity_matrix(edit.levenshtein_pairs(part, "p_type"), long=False)
    return wide.select("row", *[F.round(F.col(f"`{c}`"), 6).alias(f"c{i}") for i, c in enumerate(wide.columns[1:])])


def _close_parts(spark, d):
    return edit.levenshtein_pairs(table(spark, d, "part"), "p_name", 70.0)


def edges_part(spark, d):
    edges = reports.similarity_edges(_close_parts(spark, d), 70.0)
    return edges.withColumn("weight", F.round("weight", 6))


def nodes_part(spark, d):
    return reports.record_degrees(_close_parts(spark, d), 70.0).withColumnRenamed("rid", "node")


def degrees_part(spark, d):
    return reports.record_degrees(_close_parts(spark, d), 70.0)


def universe_part(spark, d):
    found = edit.levenshtein_pairs(table(spark, d, "part"), "p_name", 80.0)
    return reports.record_universe(found)


def top_pairs_part(spark, d):
    found = edit.weighted_levenshtein_pairs(table(spark, d, "part"), WEIGHTS, 90.0)
    return _out(reports.top_pairs(found, 25))


def attach_customer(spark, d):
    customer = table(spark, d, "customer")
    found = edit.levenshtein_pairs(customer, "c_name", 94.0)
    out = reports.attach_records(found, customer, ["c_name", "c_mktsegment"])
    return out.withColumn("similarity", F.round("similarity", 6))


def custom_scorer_part(spark, d):
    _, _, pairs = distinct_value_pairs(table(spark, d, "part"), ["p_name"])
    closer = F.lit(100.0) - F.abs(F.length("p_name_l") - F.length("p_name_r"))
    return custom_scorer(pairs, closer).select("gid_l", "gid_r", "similarity")


def all_pairs_nation(spark, d):
    found = all_pairs(table(spark, d, "nation").select("rid", "n_name"))
    return found.select("rid_l", "rid_r", "n_name_l", "n_name_r")


def row_positions_orders(spark, d):
    rows = with_rid(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"))
    return rows.select("rid", "o_orderkey")


def filled_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    joined = docs.join(labels, "doc_id", "left")
    return fill_missing(joined, ["lang"], ["quality", "toxic"], num=-1)


def report_supplier(spark, d):
    found = registry.report("Levenshtein Distance", table(spark, d, "supplier"), "s_name", min_similarity=94.0)
    return found.withColumn("Similarity (%)", F.round("Similarity (%)", 6))


def closest_customers(spark, d):
    customer = table(spark, d, "customer")
    return _out(reports.closest_pairs(lambda least: edit.levenshtein_pairs(customer, "c_name", least), 40))


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/twinfold-{uuid.uuid4().hex}"


def csv_customer(spark, d):
    """Customers written as CSV and read back; the types are found again."""
    path = _folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return read_records(spark, path)


def report_csv_supplier(spark, d):
    """The report written as CSV and read back."""
    path = _folder(spark)
    write_pairs_csv(lev_supplier(spark, d), path)
    return read_records(spark, path)


def artifacts_embeddings(spark, d):
    """Vectors and density clusters kept beside the pairs, read back."""
    path = _folder(spark)
    found = registry.run("Embedding Similarity", table(spark, d, "embeddings"), "label", text_columns=["embedding"],
                         clustering_algorithm="DBSCAN", min_similarity=60.0)
    write_artifacts(found.artifacts["vectors"], found.artifacts["labels"], path)
    labels, kept = spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/vectors")
    return kept.select("rid", F.size("vec").alias("dims")).join(labels, "rid")


def roles_orders(spark, d):
    """Which columns can be compared as texts, numbers and dates."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    roles = column_roles(orders)
    rows = [(c, role) for role in ("string", "numeric", "date") for c in getattr(roles, role)]
    size = orders.agg(F.count(F.lit(1)).alias("records"))
    return size.select("records", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(r).alias("role")) for c, r in rows])).alias("x")).select("records", "x.*")


def dates_orders(spark, d):
    """Order dates written in four layouts, then parsed."""
    orders = table(spark, d, "orders").select("rid", F.col("o_orderdate").cast("timestamp").alias("t"))
    kind = F.pmod(F.col("rid"), F.lit(4))
    text = F.when(kind == 0, F.date_format("t", "yyyy-MM-dd")).when(kind == 1, F.date_format("t", "MM/dd/yyyy"))
    text = text.when(kind == 2, F.date_format("t", "d MMM yyyy")).otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    return orders.select("rid", parse_date(text).cast("date").alias("day"))


def variance_kmeans_embeddings(spark, d):
    rows = _vectors(spark, d)
    return _variance(clusters.within_variance(rows, clusters.cluster_kmeans(rows, 5)))


def variance_hierarchical_embeddings(spark, d):
    rows = _vectors(spark, d)
    return _variance(clusters.within_variance(rows, clusters.cluster_hierarchical(rows, 5)))


def _variance(row):
    return row.select("clusters", "records", F.round("total", 4).alias("total"), (F.col("within") < F.col("total")).alias("less_within"))


def density_radii_embeddings(spark, d):
    """Clusters and lone records at several radii, all from one tree."""
    rows = _vectors(spark, d)
    tree, out = cut_lineage(clusters.density_tree(rows, "cosine")), None
    for eps in (0.52, 0.55, 0.6):
        found = clusters.cluster_pairs(tree, rows, eps)
        row = found.agg(F.lit(eps).alias("eps"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
                        F.count_if(F.col("cluster") < 0).alias("alone"))
        out = row if out is None else out.unionByName(row)
    return out


def ann_recall_embeddings(spark, d):
    """Does the approximate search find nine tenths of the pairs, and is no bucket large?"""
    rows = _vectors(spark, d)
    recall = vectors.ann_recall(vectors.ann_pairs(rows, "cosine", 0.6), vectors.pair_distance(rows, "cosine", 0.6))
    sizes = vectors.hyperplane_keys(rows.select("rid", F.col("vec").cast("array<double>").alias("vec")), 6, None, 12, 42).where("own")
    share = sizes.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") * 6 / F.sum("n")).alias("share"))
    both = recall.withColumn("k", F.lit(1)).join(share.withColumn("k", F.lit(1)), "k")
    return both.select("exact", (F.col("recall") >= 0.9).alias("recalled"), (F.col("share") < 0.1).alias("spread_out"))


def scored_held_out_documents(spark, d):
    """Every held-out pair gets a probability; labels are drawn by a hash."""
    texts, members, pairs = _document_pairs(table(spark, d, "documents"))
    found = classifier.classifier_pairs(texts, ["text"], ["n_chars"], None, pairs, threshold=0.0, members=members).pairs
    return found.select(F.col("gid_l").alias("rid_l"), F.col("gid_r").alias("rid_r"), "n_pairs", F.col("similarity").between(0, 100).alias("probable"))


def scatter_embeddings(spark, d):
    rows = table(spark, d, "embeddings")
    flat = rows.select("rid", F.col("embedding").alias("vec"))
    return clusters.scatter(flat, clusters.cluster_density(flat, 0.55, "cosine"), rows, "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        lev_supplier, lev_part_all, lev_part_min80, lev_customer_min94, lev_pages_url, qgram_pages_url,
        lev_customer_described, qgram_supplier, weighted_lev_part,
        weighted_lev_part_records, metaphone_words, metaphone_part, phonetic_candidates_part, fuzzy_part,
        composite_orders, composite_customer, band_orders, ranges_orders, lsh_documents, lsh_documents_exact,
        lsh_documents_wide, embedding_customer, embedding_documents, distance_bounds_embeddings, negative_distances,
        pair_distance_embeddings, scaled_numerics_customer, column_moments_part, dbscan_embeddings, kmeans_embeddings,
        hierarchical_embeddings, no_clusters_embeddings, project_embeddings, ann_embeddings, term_counts_documents,
        pair_features_documents, pair_features_nation, split_labels_documents, classifier_documents, histogram_part,
        histogram_orders, matrix_part, matrix_wide_type, edges_part, nodes_part, degrees_part, universe_part,
        top_pairs_part, attach_customer, custom_scorer_part, all_pairs_nation, row_positions_orders, filled_labels,
        report_supplier, closest_customers, csv_customer, report_csv_supplier, artifacts_embeddings, roles_orders, dates_orders,
        variance_kmeans_embeddings, variance_hierarchical_embeddings, density_radii_embeddings, ann_recall_embeddings, scatter_embeddings, scored_held_out_documents,
    )
}
QUERIES.update({f"embedding_{m}": _embedding(m, cut) for m, cut in EMBEDDING_CUTS.items()})
