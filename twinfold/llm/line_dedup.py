"""Line dedup: lines that many documents repeat stay in one of them.

Texts are split at line feeds. A line's key is the line without blanks at its ends,
``A-Z`` in lower case. Keys long enough to matter are hashed to 128 bits where the
text is read; documents are counted per hash; lines over the threshold are dropped
from all documents but the last, and what is left is put together by position.

Only DataFrame operations: no Python code runs on the rows. Lines are shuffled as two
hashes, an id and a position. A hash that many documents hold is counted in two steps,
by (hash, document) and then by hash, and met by broadcast: see ``join_totals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_totals

MIN_CHARS = 40  # code points of a key, at least
MIN_DOCS = 5  # documents that hold a key, at least, for its lines to go
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _lowered(text: Column) -> Column:
    """``A-Z`` in lower case, other letters as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row of ``docs``: what is left of its text.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold lose all their lines, except in the largest doc_id among them, where all of
    them stay. ``n_lines`` counts the lines before. A null or empty text is one empty
    line. A document is a doc_id: rows that repeat one count once and keep or lose a
    key together; rows without doc_id count as one document, smaller than all others.
    Keys are told apart by 128-bit hashes. Other columns are not read; an empty table
    gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    body = F.xxhash64("text").alias("body")  # tells rows of one doc_id apart; equal rows lose the same lines
    lines = rows.select("doc_id", body, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "body", "pos", _stripped(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    key = _lowered(F.col("line"))
    lines = scratch.write(lines.select("doc_id", "body", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g")))
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    found = lines.groupBy("h", "g").agg(holders.alias("holders"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.write(found.where(F.col("holders") >= min_docs).select("h", "g", "keeper", "n"))
    gone = join_totals(lines, repeated, ["h", "g"], "n").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = scratch.write(gone.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone")))
    whole = rows.select("doc_id", body, F.split("text", "\n", -1).alias("lines")).alias("whole")
    same = F.col("whole.doc_id").eqNullSafe(F.col("lost.doc_id")) & (F.col("whole.body") == F.col("lost.body"))
    # Documents that lose lines are too many to send to every executor once the corpus
    # is large, so they meet their texts by a shuffle at every size.
    joined = whole.join(gone.hint("merge").alias("lost"), same, "left").select("whole.doc_id", "lines", "gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get(F.col("lines"), i)))
    scratch.drop(lines, repeated)
    return joined.select(
        "doc_id", F.array_join(kept, "\n").alias("text"), F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"))


def op13_line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM l),
f AS (
    SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= {MIN_CHARS} GROUP BY k
    HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {MIN_DOCS}),
j AS (SELECT k.*, f.k IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM k LEFT JOIN f ON f.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
