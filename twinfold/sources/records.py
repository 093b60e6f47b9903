"""Reading records, giving them a position, and looking at their columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV reader for data frames takes as a missing value.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def read_records(spark: SparkSession, path: str, schema=None, na_values=NA_VALUES) -> DataFrame:
    """Read a CSV file with a header, or a Parquet path, as records.

    Without a schema the column types are inferred after the missing-value
    texts are blanked, so one ``NA`` does not turn a numeric column into text.
    Dates stay strings; date columns are parsed where they are compared.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"')
    missing = list(na_values)
    cleaned = raw.select(
        *[F.when(~F.col(_q(c)).isin(missing), F.col(_q(c))).alias(c) for c in raw.columns]
    )
    if schema is None:
        schema = _infer(cleaned)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return cleaned.select(
        *[F.col(_q(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _infer(df: DataFrame) -> T.StructType:
    """Narrowest of bigint, double, boolean, string per column, in one pass."""
    trials = (T.LongType(), T.DoubleType(), T.BooleanType())
    counts = []
    for i, c in enumerate(df.columns):
        counts.append(F.count(F.col(_q(c))).alias(f"n{i}"))
        for j, t in enumerate(trials):
            counts.append(F.count(F.col(_q(c)).try_cast(t)).alias(f"n{i}_{j}"))
    row = df.agg(*counts).first()
    fields = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        fits = [t for j, t in enumerate(trials) if n and row[f"n{i}_{j}"] == n]
        fields.append(T.StructField(c, fits[0] if fits else T.StringType()))
    return T.StructType(fields)


def with_rid(df: DataFrame, id_col: str | None = "id", key: str | None = None) -> DataFrame:
    """Add ``rid``, the pair-ordering key, and ``id``, the display id.

    ``key`` names a unique integer column to order pairs by; it costs nothing.
    Without it the row position is used: partitions are counted first, then each
    row adds its place to the rows before its partition. No row is shuffled and
    none passes through Python. The input should be a plain scan, whose
    partitions are the same each time they are read.
    """
    if key is not None:
        out = df.withColumn("rid", F.col(key).cast("bigint"))
    else:
        out = _with_position(df)
    if id_col is not None and id_col in df.columns:
        return out.withColumn("id", F.col(id_col))
    return out.withColumn("id", F.col(key) if key is not None else F.col("rid"))


def _with_position(df: DataFrame) -> DataFrame:
    # The generated id is the partition number in the high bits and the place in
    # the partition in the low 33 bits.
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    counts = marked.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row per partition
    before, starts = 0, []
    for row in counts:
        starts.append((row["p"], before))
        before += row["count"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part bigint, _start bigint")
    joined = marked.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.withColumn("rid", F.col("_start") + place).drop("_at", "_part", "_start")


def validate(df: DataFrame, bdv: str | None, cols=(), need_one: bool = False) -> None:
    """Raise ``ValueError`` on an unknown column or an empty selection."""
    if bdv is not None and bdv not in df.columns:
        raise ValueError(f"no column {bdv!r} among {df.columns}")
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"no column {c!r} among {df.columns}")
    if need_one and not list(cols):
        raise ValueError("this method needs one column or more to compare")


def as_text(col, null_as: str = "nan") -> Column:
    """String view of a column; missing values read as ``null_as``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(null_as))


@dataclass(frozen=True)
class Roles:
    string: list
    numeric: list
    date: list


def column_roles(df: DataFrame) -> Roles:
    """Columns that can play a string, numeric or date role; no job is run."""
    own = {"rid"}
    fields = [f for f in df.schema.fields if f.name not in own]
    return Roles(
        string=[f.name for f in fields if isinstance(f.dataType, T.StringType)],
        numeric=[f.name for f in fields if isinstance(f.dataType, T.NumericType)],
        date=[
            f.name for f in fields
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            or "date" in f.name.lower()
        ],
    )


def fill_missing(df: DataFrame, text_cols=(), numeric_cols=(), text: str = "", num: float = 0) -> DataFrame:
    """Replace missing text by ``text`` and missing numbers (also NaN) by ``num``."""
    if text_cols:
        df = df.fillna(text, subset=list(text_cols))
    if numeric_cols:
        df = df.fillna(num, subset=list(numeric_cols))
    return df
