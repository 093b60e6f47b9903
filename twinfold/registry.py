"""Methods by name: a base class, a register, and parameters read from a schema."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from .operators.classifier import classifier_pairs
from .operators.clusters import cluster_density, cluster_hierarchical, cluster_kmeans, no_clusters
from .operators.composite import composite_pairs
from .operators.edit import levenshtein_pairs, weighted_levenshtein_pairs
from .operators.fuzzy import fuzzy_pairs
from .operators.lsh import lsh_pairs
from .operators.phonetic import metaphone_pairs
from .operators.reports import ranked_pairs, to_report
from .operators.vectors import embedding_pairs
from .plans.groups import PairTable
from .plans.tiles import METRICS
from .sources.records import column_roles, validate

KINDS = ("int", "float", "bool", "weights", "multi_select", "select", "text")


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: Any
    description: str = ""
    options: list = field(default_factory=list)

    def check(self, value: Any) -> Any:
        """The value in the parameter's type, or ``ValueError``."""
        wrong = ValueError(f"parameter '{self.name}' does not accept {value!r}")
        if self.kind == "int":
            if isinstance(value, bool) or int(value) != value:
                raise wrong
            return int(value)
        if self.kind == "float":
            return float(value)
        if self.kind == "bool":
            if not isinstance(value, bool):
                raise wrong
        if self.kind == "weights":
            if not set(value) <= set(self.options) or not all(0 <= float(w) <= 1 for w in value.values()):
                raise wrong
        if self.kind == "multi_select" and not set(value) <= set(self.options):
            raise wrong
        if self.kind == "select" and value not in self.options:
            raise wrong
        return value


class ComparisonMethod(ABC):
    """A way to compare the records of one table."""

    def __init__(self, **params):
        self.params = params

    @classmethod
    @abstractmethod
    def name(cls) -> str:
        """Name the method is registered under."""

    @classmethod
    def parameters(cls, df: DataFrame) -> list[Parameter]:
        """Parameters with defaults for this table; no job is run."""
        return []

    def resolved(self, df: DataFrame) -> dict[str, Any]:
        """Given values over defaults, each checked before any job starts."""
        known = {p.name: p for p in self.parameters(df)}
        unknown = set(self.params) - set(known)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        given = {n: known[n].check(v) for n, v in self.params.items() if v is not None}
        return {n: given.get(n, p.default) for n, p in known.items()}

    @abstractmethod
    def compare(self, df: DataFrame, bdv: str) -> PairTable:
        """Scored pairs of the records of ``df`` (with ``rid``)."""


_METHODS: dict[str, type[ComparisonMethod]] = {}


def register_method(cls: type[ComparisonMethod]) -> type[ComparisonMethod]:
    """Class decorator that makes a method known by its name."""
    _METHODS[cls.name()] = cls
    return cls


def methods() -> dict[str, type[ComparisonMethod]]:
    return dict(_METHODS)


def _ones(cols: list[str]) -> dict[str, float]:
    return {c: 1.0 for c in cols}


def _min_similarity() -> Parameter:
    return Parameter("min_similarity", "float", None, "Lowest similarity to report (0 to 100); none reports all pairs")


def _all(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "rid"]


# The names the methods below return are those callers look them up by.


@register_method
class Levenshtein(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Levenshtein Distance"

    @classmethod
    def parameters(cls, df):
        return [_min_similarity()]

    def compare(self, df, bdv):
        return levenshtein_pairs(df, bdv, **self.resolved(df))


@register_method
class WeightedLevenshtein(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Weighted Levenshtein Distance"

    @classmethod
    def parameters(cls, df):
        texts = column_roles(df).string
        return [Parameter("weights", "weights", _ones(texts), "Weight per column (0 to 1)", texts), _min_similarity()]

    def compare(self, df, bdv):
        return weighted_levenshtein_pairs(df, bdv=bdv, **self.resolved(df))


@register_method
class Metaphone(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Metaphone (Smooth Similarity)"

    @classmethod
    def parameters(cls, df):
        texts = column_roles(df).string
        return [
            Parameter("comparison_columns", "multi_select", [], "Text columns to compare by sound", texts),
            Parameter("weights", "weights", _ones(texts), "Weight per column (0 to 1)", texts),
            _min_similarity(),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        return metaphone_pairs(df, p["comparison_columns"], p["weights"], p["min_similarity"], bdv=bdv)


@register_method
class Fuzzy(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Fuzzy Matching"

    @classmethod
    def parameters(cls, df):
        return [
            Parameter("comparison_columns", "multi_select", [], "Text columns to compare by words", column_roles(df).string),
            Parameter("weights", "weights", _ones(_all(df)), "Weight per column (0 to 1)", _all(df)),
            Parameter("similarity_threshold", "float", 80.0, "Lowest similarity to report (0 to 100)"),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        return fuzzy_pairs(df, p["comparison_columns"], p["weights"], p["similarity_threshold"], bdv=bdv)


@register_method
class Composite(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Composite Similarity"

    @classmethod
    def parameters(cls, df):
        roles = column_roles(df)
        return [
            Parameter("string_columns", "multi_select", [], "Text columns", roles.string),
            Parameter("numeric_columns", "multi_select", [], "Number columns", roles.numeric),
            Parameter("date_columns", "multi_select", [], "Date columns", roles.date),
            Parameter("weights", "weights", _ones(_all(df)), "Weight per column (0 to 1)", _all(df)),
            _min_similarity(),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        return composite_pairs(
            df, p["string_columns"], p["numeric_columns"], p["date_columns"], p["weights"], p["min_similarity"], bdv=bdv
        )


@register_method
class MinHashLsh(ComparisonMethod):
    @classmethod
    def name(cls):
        return "Locality-Sensitive Hashing (LSH)"

    @classmethod
    def parameters(cls, df):
        texts = column_roles(df).string
        return [
            Parameter("text_column", "select", texts[0] if texts else None, "Text column to hash", texts),
            Parameter("threshold", "float", 0.8, "Similarity the bands aim at (0 to 1)"),
            Parameter("num_perm", "int", 128, "Number of permutations"),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        return lsh_pairs(df, p["text_column"], p["threshold"], p["num_perm"], bdv=bdv)


@register_method
class Embedding(ComparisonMethod):
    """Also leaves ``vectors`` and ``labels`` (cluster per record) in the artifacts."""

    CLUSTERINGS = ("None", "KMeans", "Hierarchical", "AgglomerativeClustering", "DBSCAN")

    @classmethod
    def name(cls):
        return "Embedding Similarity"

    @classmethod
    def parameters(cls, df):
        roles = column_roles(df)
        arrays = [n for n, t in df.dtypes if t in ("array<float>", "array<double>")]
        return [
            Parameter("text_columns", "multi_select", [], "Text or vector columns", roles.string + arrays),
            Parameter("numeric_columns", "multi_select", [], "Number columns", roles.numeric),
            Parameter("weights", "weights", _ones(_all(df)), "Weight per column (0 to 1)", _all(df)),
            Parameter("clustering_algorithm", "select", "None", "Clustering to add", list(cls.CLUSTERINGS)),
            Parameter("distance_metric", "select", "cosine", "Distance between vectors", list(METRICS)),
            Parameter("num_clusters", "int", 5, "Clusters for KMeans and Hierarchical"),
            _min_similarity(),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        found = embedding_pairs(
            df, p["text_columns"], p["numeric_columns"], p["weights"], p["distance_metric"], p["min_similarity"], bdv=bdv
        )
        vectors = found.artifacts["vectors"]
        kind = p["clustering_algorithm"]
        if kind == "KMeans":
            labels = cluster_kmeans(vectors, p["num_clusters"])
        elif kind in ("Hierarchical", "AgglomerativeClustering"):  # two names of one choice
            labels = cluster_hierarchical(vectors, p["num_clusters"])
        elif kind == "DBSCAN":
            labels = cluster_density(vectors, 0.5, p["distance_metric"])
        else:
            labels = no_clusters(vectors)
        found.artifacts["labels"] = labels
        return found


@register_method
class Classifier(ComparisonMethod):
    """``labels`` and ``pairs`` are DataFrames set on the instance, not parameters."""

    labels: DataFrame | None = None
    pairs: DataFrame | None = None

    @classmethod
    def name(cls):
        return "Machine Learning Duplicate Detection"

    @classmethod
    def parameters(cls, df):
        roles = column_roles(df)
        return [
            Parameter("text_columns", "multi_select", [], "Text columns", roles.string),
            Parameter("numeric_columns", "multi_select", [], "Number columns", roles.numeric),
            Parameter("similarity_threshold", "float", 0.5, "Lowest probability to report (0 to 1)"),
        ]

    def compare(self, df, bdv):
        p = self.resolved(df)
        return classifier_pairs(
            df, p["text_columns"], p["numeric_columns"], self.labels, self.pairs, p["similarity_threshold"], bdv=bdv
        )


def custom_scorer(pairs: DataFrame, score: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """``pairs`` with ``similarity`` from a user's score.

    ``score`` is a Column over the pair columns (a ``pandas_udf`` call included)
    or a function from the pair table to one.
    """
    column = score(pairs) if callable(score) and not isinstance(score, Column) else score
    return pairs.withColumn("similarity", column.cast("double"))


def run(method: str, df: DataFrame, bdv: str, **params) -> PairTable:
    """Compare with a registered method."""
    if method not in _METHODS:
        raise ValueError(f"unknown method '{method}'; known: {sorted(_METHODS)}")
    validate(df, bdv)
    return _METHODS[method](**params).compare(df, bdv)


def report(method: str, df: DataFrame, bdv: str, **params) -> DataFrame:
    """Compare with a registered method: labelled pairs of records, most similar first, with their ``rank``."""
    return ranked_pairs(to_report(run(method, df, bdv, **params), df, bdv))
