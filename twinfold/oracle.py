"""SQL twins of the registered queries, for DuckDB over the same tables.

They state the definitions by brute force: all pairs, every score, then the
filter.
"""

from __future__ import annotations

from .functions.minhash import PRIME, band_shape, permutations
from .operators.classifier import ONE_SIDED
from .queries import EMBEDDING_CUTS


def _lev(a: str, b: str) -> str:
    longer = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {longer} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longer} END)"


def _groups(table: str, key: str, cols: list[str]) -> str:
    named = ", ".join(f"{c} AS c{i}" for i, c in enumerate(cols))
    by = ", ".join(str(i + 1) for i in range(len(cols)))
    return f"SELECT {named}, min({key})::BIGINT AS gid, count(*)::BIGINT AS n FROM {table} GROUP BY {by}"


def _mean(cols: list[str], weights: list[float]) -> str:
    parts = " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in zip(cols, weights))
    return f"(({parts}) / {sum(weights)!r}::DOUBLE)"


def _pairs(groups: str, score: str, least: float | None, copies: str = "100.0::DOUBLE", on: str = "") -> str:
    """Compact pair table over ``groups``: pairs of groups, then copies."""
    where = "" if least is None else f"WHERE s >= {least!r}::DOUBLE"
    return f"""
    WITH g AS ({groups}),
    p AS (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, {score} AS s
      FROM g a JOIN g b ON a.gid < b.gid {on}
      UNION ALL
      SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, {copies} FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs::BIGINT AS n_pairs, round(s, 6) AS similarity FROM p {where}"""


def _lev_pairs(table, key, cols, weights, least):
    scores = [_lev(f"a.c{i}", f"b.c{i}") for i in range(len(cols))]
    return _pairs(_groups(table, key, cols), f"{_mean(scores, weights)} * 100", least)


ORACLE: dict[str, str] = {}

ORACLE["lev_supplier"] = f"""
    SELECT *, row_number() OVER (ORDER BY "Similarity (%)" DESC, "Record 1", "Record 2") AS rank FROM (
    SELECT a.s_name || ' (' || a.s_suppkey || ')' AS "Record 1", b.s_name || ' (' || b.s_suppkey || ')' AS "Record 2",
           round({_lev('a.s_name', 'b.s_name')} * 100, 6) AS "Similarity (%)"
    FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey
    WHERE {_lev('a.s_name', 'b.s_name')} * 100 >= 94.0)"""
ORACLE["report_supplier"] = ORACLE["report_csv_supplier"] = ORACLE["lev_supplier"]
ORACLE["closest_customers"] = f"""
    SELECT a.c_custkey AS rid_l, b.c_custkey AS rid_r, round({_lev('a.c_name', 'b.c_name')} * 100, 6) AS similarity
    FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey ORDER BY {_lev('a.c_name', 'b.c_name')} * 100 DESC, 1, 2 LIMIT 40"""
ORACLE["csv_customer"] = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["dates_orders"] = "SELECT o_orderkey AS rid, o_orderdate::DATE AS day FROM orders"
ORACLE["roles_orders"] = """
    WITH c AS (SELECT column_name AS name, column_type AS kind FROM (DESCRIBE orders)),
    r AS (SELECT name, 'string' AS role FROM c WHERE kind = 'VARCHAR'
          UNION ALL SELECT name, 'numeric' FROM c WHERE kind IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'FLOAT', 'DOUBLE') OR kind LIKE 'DECIMAL%'
          UNION ALL SELECT name, 'date' FROM c WHERE kind LIKE 'TIMESTAMP%' OR kind = 'DATE' OR lower(name) LIKE '%date%')
    SELECT (SELECT count(*) FROM orders) AS records, name, role FROM r"""

ORACLE["lev_part_all"] = _lev_pairs("part", "p_partkey", ["p_name"], [1.0], None)
ORACLE["lev_part_min80"] = _lev_pairs("part", "p_partkey", ["p_name"], [1.0], 80.0)
ORACLE["lev_customer_min94"] = _lev_pairs("customer", "c_custkey", ["c_name"], [1.0], 94.0)

ORACLE["qgram_supplier"] = f"""
    WITH v AS (SELECT DISTINCT s_name AS v FROM supplier)
    SELECT a.v AS v_l, b.v AS v_r, round({_lev('a.v', 'b.v')}, 6) AS sim
    FROM v a JOIN v b ON a.v < b.v WHERE {_lev('a.v', 'b.v')} >= 0.94 - 1e-9"""

ORACLE["lev_pages_url"] = _lev_pairs("pages", "page_id", ["url"], [1.0], 80.0)
ORACLE["qgram_pages_url"] = f"""
    WITH v AS (SELECT DISTINCT url AS v FROM pages)
    SELECT a.v AS v_l, b.v AS v_r, round({_lev('a.v', 'b.v')}, 6) AS sim
    FROM v a JOIN v b ON a.v < b.v WHERE {_lev('a.v', 'b.v')} >= 0.8 - 1e-9"""
_DESCRIBED = """(SELECT c_custkey, c_name || ' ' || c_mktsegment || ' ' || c_nationkey || ' ' || round(c_acctbal)::BIGINT AS described FROM customer)"""
ORACLE["lev_customer_described"] = _lev_pairs(_DESCRIBED, "c_custkey", ["described"], [1.0], 85.0)

_PART = ["p_name", "p_type", "p_brand"]
_PART_WEIGHTS = [1.0, 0.5, 1.0]
ORACLE["weighted_lev_part"] = _lev_pairs("part", "p_partkey", _PART, _PART_WEIGHTS, 90.0)


def _part_score() -> str:
    return f"{_mean([_lev(f'a.{c}', f'b.{c}') for c in _PART], _PART_WEIGHTS)} * 100"


ORACLE["weighted_lev_part_records"] = f"""
    SELECT a.p_partkey AS rid_l, b.p_partkey AS rid_r, round({_part_score()}, 6) AS similarity
    FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE {_part_score()} >= 95.0"""


# The phonetic rules without look-around: what follows is captured and put back.
_PHONETIC_STEPS = [
    ("^(kn|gn|pn|ae|wr)", None), ("^x", "S"), ("^wh", "w"), ("mb$", "m"), ("tch", "ch"), ("sch", "SK"),
    ("sh", "X"), ("s(i[oa])", r"X\1"), ("ch", "X"), ("c(ia)", r"X\1"), ("sc([iey])", r"S\1"), ("c([iey])", r"S\1"),
    ("ck", "K"), ("c", "K"), ("dg([eiy])", r"J\1"), ("gh([^aeiou])", r"\1"), ("gn$", "n"), ("gned$", "ned"),
    ("gh", "K"), ("g([iey])", r"J\1"), ("g", "K"), ("d", "T"), ("ph", "F"), ("th", "0"), ("t(i[ao])", r"X\1"),
    ("t", "T"), ("([aeiou])h([^aeiou]|$)", r"\1\2"), ("h", "H"), ("[wy]+([wy][aeiou])", r"\1"),
    ("[wy]+([^aeiouwy]|$)", r"\1"), ("x", "KS"), ("q", "K"), ("v", "F"), ("[sz]", "S"),
]


def _codes(select_values: str) -> str:
    """CTE body ``v, code`` for the distinct texts of a query with column ``v``."""
    steps = [f"s0 AS (SELECT v, regexp_replace(regexp_replace(lower(v), '[^a-z]', '', 'g'), 'gg+', 'K', 'g') AS s FROM ({select_values}))"]
    steps.append(
        "s1 AS (SELECT v, array_to_string(list_transform(list_filter("
        "list_zip(string_split(s, ''), list_concat([''], string_split(s, ''))),"
        " lambda z: z[1] IS NOT NULL AND (z[1] <> z[2] OR z[1] = 'c' OR z[1] = 'K')), lambda z: z[1]), '') AS s FROM s0)"
    )
    last = "s1"
    for i, (pattern, to) in enumerate(_PHONETIC_STEPS, start=2):
        expr = (
            f"CASE WHEN regexp_matches(s, '{pattern}') THEN substr(s, 2) ELSE s END" if to is None
            else f"regexp_replace(s, '{pattern}', '{to}', 'g')"
        )
        steps.append(f"s{i} AS (SELECT v, {expr} AS s FROM {last})")
        last = f"s{i}"
    steps.append(
        f"codes AS (SELECT v, upper(substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiou]', '', 'g')) AS code FROM {last})"
    )
    return ",\n".join(steps)


ORACLE["metaphone_words"] = f"""
    WITH {_codes("SELECT DISTINCT v FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS v FROM documents) WHERE v <> ''")}
    SELECT v AS word, code FROM codes"""

ORACLE["metaphone_part"] = f"""
    WITH {_codes("SELECT p_name AS v FROM part UNION SELECT p_type FROM part")},
    g AS (
      SELECT x.code AS c0, y.code AS c1, min(p_partkey)::BIGINT AS gid, count(*)::BIGINT AS n
      FROM part JOIN codes x ON x.v = p_name JOIN codes y ON y.v = p_type GROUP BY 1, 2
    ),
    p AS (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs,
             {_mean([_lev('a.c0', 'b.c0'), _lev('a.c1', 'b.c1')], [1.0, 0.5])} * 100 AS s
      FROM g a JOIN g b ON a.gid < b.gid
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM p WHERE s >= 80.0"""

ORACLE["phonetic_candidates_part"] = f"""
    WITH {_codes("SELECT DISTINCT p_name AS v FROM part")},
    g AS (SELECT p_name, code, min(p_partkey)::BIGINT AS gid, count(*)::BIGINT AS n FROM part JOIN codes ON v = p_name GROUP BY 1, 2)
    SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, 100.0::DOUBLE AS similarity
    FROM g a JOIN g b ON a.gid < b.gid AND a.code = b.code
    UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1"""

# Longest common subsequences by the row recurrence: the next row is the running
# maximum of max(row[j], row[j - 1] + match).
_SETS = r"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '[^\x00-\x7F]', '', 'g'), '\s+'), lambda t: t <> '')))"
ORACLE["fuzzy_part"] = f"""
    WITH RECURSIVE rec AS (SELECT p_partkey, {_SETS.format('p_name')} AS x, {_SETS.format('p_type')} AS y FROM part),
    g AS (SELECT x, y, min(p_partkey)::BIGINT AS gid, count(*)::BIGINT AS n FROM rec GROUP BY 1, 2),
    u AS (SELECT x AS w FROM g UNION SELECT y FROM g),
    uv AS (
      SELECT a.w AS a, b.w AS b, list_sort(list_intersect(a.w, b.w)) AS i,
             list_sort(list_filter(a.w, lambda t: NOT list_contains(b.w, t))) AS ab,
             list_sort(list_filter(b.w, lambda t: NOT list_contains(a.w, t))) AS ba
      FROM u a JOIN u b ON a.w <= b.w
    ),
    t AS (
      SELECT row_number() OVER () AS k, a, b, array_to_string(i, ' ') AS si,
             array_to_string(list_concat(i, ab), ' ') AS c1, array_to_string(list_concat(i, ba), ' ') AS c2
      FROM uv
    ),
    q AS (SELECT DISTINCT p, q FROM (SELECT si AS p, c1 AS q FROM t UNION ALL SELECT si, c2 FROM t UNION ALL SELECT c1, c2 FROM t)),
    r AS (
      SELECT p, q, 0 AS i, list_transform(range(length(q)), lambda z: 0::BIGINT) AS d FROM q
      UNION ALL
      SELECT p, q, i + 1, list_transform(range(1, length(q) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda m: greatest(d[m], (CASE WHEN m > 1 THEN d[m - 1] ELSE 0 END) + (CASE WHEN substr(p, i + 1, 1) = substr(q, m, 1) THEN 1 ELSE 0 END)))))
      FROM r WHERE i < length(p)
    ),
    ratio AS (
      SELECT p, q, CASE WHEN length(p) = 0 OR length(q) = 0 THEN 0.0::DOUBLE
                        ELSE round_even(200.0::DOUBLE * list_max(d) / (length(p) + length(q)), 0) END AS r
      FROM r WHERE i = length(p)
    ),
    score AS (
      SELECT t.a, t.b, CASE WHEN len(t.a) = 0 OR len(t.b) = 0 THEN 0.0::DOUBLE ELSE greatest(r1.r, r2.r, r3.r) END AS s
      FROM t JOIN ratio r1 ON r1.p = si AND r1.q = c1 JOIN ratio r2 ON r2.p = si AND r2.q = c2 JOIN ratio r3 ON r3.p = c1 AND r3.q = c2
    ),
    either AS (SELECT a, b, s FROM score UNION SELECT b, a, s FROM score),
    pairs AS (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, (x.s * 1.0 + y.s * 0.5) / 1.5 AS s
      FROM g a JOIN g b ON a.gid < b.gid JOIN either x ON x.a = a.x AND x.b = b.x JOIN either y ON y.a = a.y AND y.b = b.y
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM pairs WHERE s >= 80.0"""

# The first condition of the join follows from the threshold (all other parts at
# most 1); it only spares the engine the rest of the 10^8 pairs.
_ORDER_GROUPS = (
    "SELECT o_orderpriority AS c0, o_totalprice AS c1, o_orderdate AS c2, epoch_us(o_orderdate) AS u,"
    " min(o_orderkey)::BIGINT AS gid, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2, 3, 4"
)
_ORDER_SPAN = (
    "(SELECT max(o_totalprice) - min(o_totalprice) + 1e-5::DOUBLE AS w,"
    " floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000::DOUBLE) + 1e-5::DOUBLE AS t FROM orders)"
)
_ORDER_PAIRS = f"""
    g AS ({_ORDER_GROUPS}), span AS MATERIALIZED {_ORDER_SPAN},
    b AS (SELECT *, c1 + 0.016 * (SELECT w FROM span) AS hi FROM g),
    near AS (
      SELECT a.gid AS ga, b.gid AS gb, a.n * b.n AS n_pairs, a.c0 AS p0, b.c0 AS q0, a.c1 AS p1, b.c1 AS q1,
             CASE WHEN a.gid < b.gid THEN a.u - b.u ELSE b.u - a.u END AS du
      FROM b a JOIN b b ON b.c1 >= a.c1 AND b.c1 <= a.hi AND a.gid <> b.gid AND (a.c1 < b.c1 OR a.gid < b.gid)
    ),
    p AS (
      SELECT least(ga, gb) AS gid_l, greatest(ga, gb) AS gid_r, n_pairs,
             (({_lev('p0', 'q0')} * 1.0::DOUBLE + (1.0::DOUBLE - abs(p1 - q1) / w) * 1.0::DOUBLE
               + (1.0::DOUBLE - abs(floor(du / 86400000000::DOUBLE)) / t) * 1.0::DOUBLE) / 3.0::DOUBLE) * 100 AS s
      FROM near, span
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )"""
ORACLE["composite_orders"] = f"""
    WITH {_ORDER_PAIRS}
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM p WHERE s >= 99.5"""

ORACLE["composite_customer"] = _pairs(
    "SELECT *, (SELECT max(c_acctbal) - min(c_acctbal) + 1e-5::DOUBLE FROM customer) AS w,"
    " (SELECT max(c_nationkey)::DOUBLE - min(c_nationkey) + 1e-5::DOUBLE FROM customer) AS t FROM ("
    + _groups("customer", "c_custkey", ["c_mktsegment", "c_acctbal", "c_nationkey"]) + ")",
    f"(({_lev('a.c0', 'b.c0')} * 0.5::DOUBLE + (1.0::DOUBLE - abs(a.c1 - b.c1) / a.w) * 1.0::DOUBLE"
    " + (1.0::DOUBLE - abs(a.c2 - b.c2)::DOUBLE / a.t) * 1.0::DOUBLE) / 2.5::DOUBLE) * 100",
    99.0,
)

ORACLE["band_orders"] = """
    SELECT least(a.o_orderkey, b.o_orderkey) AS rid_l, greatest(a.o_orderkey, b.o_orderkey) AS rid_r
    FROM orders a JOIN orders b ON b.o_totalprice >= a.o_totalprice AND b.o_totalprice <= a.o_totalprice + 10.5
    WHERE abs(a.o_totalprice - b.o_totalprice) <= 10.0 AND a.o_orderkey <> b.o_orderkey
      AND (a.o_totalprice < b.o_totalprice OR a.o_orderkey < b.o_orderkey)"""

ORACLE["ranges_orders"] = f"SELECT round(w, 6) AS range_o_totalprice, round(t, 6) AS days_o_orderdate FROM {_ORDER_SPAN}"


def _signatures(num_perm: int) -> str:
    a, b = zip(*permutations(num_perm))
    return f"""
    toks AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM documents) WHERE t <> ''),
    hashes AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 15))::BIGINT % {PRIME} AS h FROM toks),
    perms AS (SELECT unnest({list(a)}::BIGINT[]) AS a, unnest({list(b)}::BIGINT[]) AS b, unnest(range({num_perm})) AS i),
    slots AS (SELECT doc_id, i, min((h * a + b) % {PRIME}) AS m FROM hashes, perms GROUP BY 1, 2),
    sigs AS (
      SELECT d.doc_id, coalesce(s.sig, list_transform(range({num_perm}), lambda z: {PRIME}::BIGINT)) AS sig
      FROM documents d LEFT JOIN (SELECT doc_id, list(m ORDER BY i) AS sig FROM slots GROUP BY 1) s USING (doc_id)
    )"""


def _banded(threshold: float, num_perm: int, by: str = "sig") -> str:
    bands, rows = band_shape(threshold, num_perm)
    return f"""
    g AS (SELECT {by}, min(doc_id)::BIGINT AS gid, count(*)::BIGINT AS n FROM sigs GROUP BY {by}),
    bands AS (SELECT gid, i, sig[i * {rows} + 1 : i * {rows} + {rows}] AS k FROM g, range({bands}) AS x(i)),
    cand AS (SELECT DISTINCT a.gid AS gid_l, b.gid AS gid_r FROM bands a JOIN bands b ON a.i = b.i AND a.k = b.k AND a.gid < b.gid)"""


def _lsh(threshold: float, num_perm: int, least: float | None) -> str:
    where = "" if least is None else f"WHERE s >= {least!r}"
    return f"""
    WITH {_signatures(num_perm)}, {_banded(threshold, num_perm)},
    p AS (
      SELECT gid_l, gid_r, a.n * b.n AS n_pairs,
             len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2]))::DOUBLE / {num_perm} * 100 AS s
      FROM cand JOIN g a ON a.gid = gid_l JOIN g b ON b.gid = gid_r
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM p {where}"""


ORACLE["lsh_documents"] = _lsh(0.8, 128, None)
ORACLE["lsh_documents_wide"] = _lsh(0.5, 64, 50.0)
ORACLE["lsh_documents_exact"] = f"""
    WITH {_signatures(128).replace('sigs AS', 'bare AS')},
    sets AS (SELECT d.doc_id, coalesce(w, []) AS w FROM documents d LEFT JOIN (SELECT doc_id, list_sort(list(t)) AS w FROM toks GROUP BY 1) USING (doc_id)),
    sigs AS (SELECT doc_id, sig, w FROM bare JOIN sets USING (doc_id)),
    {_banded(0.8, 128, 'sig, w')},
    p AS (
      SELECT gid_l, gid_r, a.n * b.n AS n_pairs,
             CASE WHEN len(a.w) + len(b.w) = 0 THEN 100.0::DOUBLE
                  ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 100 END AS s
      FROM cand JOIN g a ON a.gid = gid_l JOIN g b ON b.gid = gid_r
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM p WHERE s >= 80.0"""

_ZIP = "list_zip(a.v, b.v)"
_DISTANCE = {
    "cosine": "1.0::DOUBLE - list_dot_product(a.v, b.v) / (a.norm * b.norm)",
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": f"list_sum(list_transform({_ZIP}, lambda z: abs(z[1] - z[2])))",
    "chebyshev": f"list_max(list_transform({_ZIP}, lambda z: abs(z[1] - z[2])))",
}
_VECTORS = (
    "e AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"
)


def _embedding(metric: str, least: float) -> str:
    return f"""
    WITH {_VECTORS},
    g AS (SELECT v, norm, min(vec_id)::BIGINT AS gid, count(*)::BIGINT AS n FROM e GROUP BY 1, 2),
    p AS MATERIALIZED (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, greatest({_DISTANCE[metric]}, 0.0) AS x
      FROM g a JOIN g b ON a.gid < b.gid
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 0.0::DOUBLE FROM g WHERE n > 1
    ),
    q AS (SELECT *, (1.0::DOUBLE - x / (SELECT max(x) FROM p)) * 100 AS s FROM p)
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM q WHERE s >= {least!r}"""


for _metric, _cut in EMBEDDING_CUTS.items():
    ORACLE[f"embedding_{_metric}"] = _embedding(_metric, _cut)

_SCALED = """
    m AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer),
    z AS (SELECT c_custkey AS rid, (c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn * 0.5 AS y FROM customer, m)"""
ORACLE["scaled_numerics_customer"] = (
    f"WITH {_SCALED} SELECT rid, round(x, 6) AS scaled_c_acctbal, round(y, 6) AS scaled_c_nationkey FROM z"
)
ORACLE["embedding_customer"] = f"""
    WITH {_SCALED},
    k AS (SELECT z.*, c_acctbal, c_nationkey FROM z JOIN customer ON c_custkey = rid),
    g AS (SELECT any_value(x) AS x, any_value(y) AS y, min(rid)::BIGINT AS gid, count(*)::BIGINT AS n FROM k GROUP BY c_acctbal, c_nationkey),
    top AS MATERIALIZED (SELECT sqrt(max((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM g a JOIN g b ON a.gid < b.gid),
    p AS (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, (1.0 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / d) * 100 AS s
      FROM g a JOIN g b ON a.gid < b.gid, top
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )
    SELECT gid_l, gid_r, n_pairs, round(s, 6) AS similarity FROM p WHERE s >= 99.5"""

# TF-IDF over the whole vocabulary and one number: all pairs, shared words by a join.
ORACLE["embedding_documents"] = r"""
    WITH m AS (SELECT count(*) AS m, avg(n_chars) AS mean, stddev_pop(n_chars) AS std FROM documents),
    g AS (SELECT text, min(doc_id)::BIGINT AS gid, count(*)::BIGINT AS n, any_value((n_chars - mean) / CASE WHEN std > 0 THEN std ELSE 1 END) AS z
          FROM documents, m GROUP BY text, n_chars),
    t AS (SELECT gid, n, term, count(*) AS tf FROM (SELECT gid, n, unnest(string_split_regex(lower(text), '\s+')) AS term FROM g) WHERE term <> '' GROUP BY ALL),
    f AS (SELECT term, sum(n) AS f FROM t GROUP BY term),
    v AS (SELECT gid, term, tf * ln((m + 1)::DOUBLE / (f + 1)) AS w FROM t JOIN f USING (term), m),
    l AS (SELECT g.gid, g.n, g.z, sqrt(g.z * g.z + coalesce((SELECT sum(w * w) FROM v WHERE v.gid = g.gid), 0)) AS norm FROM g),
    d AS (SELECT a.gid AS x, b.gid AS y, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.term = b.term AND a.gid < b.gid GROUP BY 1, 2),
    p AS MATERIALIZED (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs,
             greatest(1 - CASE WHEN a.norm > 0 AND b.norm > 0 THEN (coalesce(s, 0) + a.z * b.z) / (a.norm * b.norm) ELSE 0 END, 0) AS x
      FROM l a JOIN l b ON a.gid < b.gid LEFT JOIN d ON d.x = a.gid AND d.y = b.gid
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, CASE WHEN norm > 0 THEN 0.0 ELSE 1.0 END FROM l WHERE n > 1),
    q AS (SELECT *, (1 - x / (SELECT max(x) FROM p)) * 100 AS s FROM p)
    SELECT gid_l, gid_r, n_pairs::BIGINT AS n_pairs, round(s, 6) AS similarity FROM q WHERE s >= 95.0"""

ORACLE["distance_bounds_embeddings"] = f"""
    WITH {_VECTORS}
    SELECT round(least(min({_DISTANCE['manhattan']}), 0.0), 6) AS min_distance, round(max({_DISTANCE['manhattan']}), 6) AS max_distance
    FROM e a JOIN e b ON a.vec_id < b.vec_id"""

ORACLE["negative_distances"] = f"""
    WITH {_VECTORS}, d AS (SELECT {_DISTANCE['cosine']} AS x FROM e a JOIN e b ON a.vec_id < b.vec_id)
    SELECT count(*)::BIGINT AS pairs, round(min(x), 6) AS lowest, count(*) FILTER (x < 0) AS negative, coalesce(bool_or(x < 0), false) AS any_negative
    FROM d"""

ORACLE["pair_distance_embeddings"] = f"""
    WITH {_VECTORS}
    SELECT a.vec_id AS rid_l, b.vec_id AS rid_r, round({_DISTANCE['euclidean']}, 6) AS distance
    FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_DISTANCE['euclidean']} <= 1.0"""

ORACLE["column_moments_part"] = """
    SELECT round(avg(p_size), 6) AS mean_p_size, round(stddev_pop(p_size), 6) AS std_p_size,
           round(avg(p_retailprice), 6) AS mean_p_retailprice, round(stddev_pop(p_retailprice), 6) AS std_p_retailprice FROM part"""

ORACLE["dbscan_embeddings"] = f"""
    WITH RECURSIVE {_VECTORS},
    near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE greatest({_DISTANCE['cosine']}, 0.0) <= 0.55),
    links AS MATERIALIZED (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
    reach AS (SELECT u AS node, u AS root FROM links UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node WHERE r.root < l.v),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
    numbered AS (SELECT node, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS cluster FROM roots)
    SELECT vec_id AS rid, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN numbered ON node = vec_id"""

# The same components at several radii.
_DENSE = f"""{_VECTORS},
    near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v, greatest({_DISTANCE['cosine']}, 0.0) AS x FROM e a JOIN e b ON a.vec_id < b.vec_id
                          WHERE greatest({_DISTANCE['cosine']}, 0.0) <= 0.6),
    radii(eps) AS (VALUES (0.5::DOUBLE), (0.52::DOUBLE), (0.55::DOUBLE), (0.6::DOUBLE)),
    links AS MATERIALIZED (SELECT eps, u, v FROM near JOIN radii ON x <= eps UNION ALL SELECT eps, v, u FROM near JOIN radii ON x <= eps),
    reach AS (SELECT eps, u AS node, u AS root FROM links UNION SELECT r.eps, l.v, r.root FROM reach r JOIN links l ON l.u = r.node AND l.eps = r.eps WHERE r.root < l.v),
    roots AS (SELECT eps, node, min(root) AS root FROM reach GROUP BY 1, 2)"""
ORACLE["density_radii_embeddings"] = f"""
    WITH RECURSIVE {_DENSE}
    SELECT eps, (SELECT count(DISTINCT root) FROM roots r WHERE r.eps = radii.eps) AS clusters,
           (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM roots r WHERE r.eps = radii.eps) AS alone
    FROM radii WHERE eps > 0.5"""
ORACLE["artifacts_embeddings"] = f"""
    WITH RECURSIVE {_DENSE},
    numbered AS (SELECT node, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS cluster FROM roots WHERE eps = 0.5)
    SELECT vec_id AS rid, len(embedding)::INTEGER AS dims, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN numbered ON node = vec_id"""
ORACLE["variance_kmeans_embeddings"] = ORACLE["variance_hierarchical_embeddings"] = """
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    v AS (SELECT var_pop(x) * count(*) AS s FROM x GROUP BY i)
    SELECT 5::BIGINT AS clusters, (SELECT count(*) FROM embeddings) AS records, round(sum(s), 4) AS total, true AS less_within FROM v"""
ORACLE["ann_recall_embeddings"] = f"""
    WITH {_VECTORS}
    SELECT count(*) AS exact, true AS recalled, true AS spread_out FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_DISTANCE['cosine']} <= 0.6"""
ORACLE["ann_embeddings"] = f"""
    WITH {_VECTORS}
    SELECT a.vec_id AS rid_l, b.vec_id AS rid_r, {_DISTANCE['cosine']} AS distance
    FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_DISTANCE['cosine']} <= 0.55"""

ORACLE["no_clusters_embeddings"] = "SELECT vec_id AS rid, -1 AS cluster FROM embeddings"

_TERMS = r"tc AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2)"
ORACLE["term_counts_documents"] = f"WITH {_TERMS} SELECT doc_id AS rid, term, tf FROM tc"

_C2 = f"{ONE_SIDED**2!r}::DOUBLE"
# Pairs of records first, then counted by the texts they hold.
_DOC_PAIRS = f"""{_signatures(128)}, {_banded(0.8, 128)},
    sg AS (SELECT s.doc_id, g.gid FROM sigs s JOIN g USING (sig)),
    near AS (SELECT gid_l, gid_r FROM cand UNION ALL SELECT gid, gid FROM g),
    v AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, n_chars)::BIGINT AS rep FROM documents),
    rp AS (
      SELECT a.doc_id AS l, b.doc_id AS r FROM sg a JOIN sg b ON a.doc_id < b.doc_id
      JOIN near ON gid_l = least(a.gid, b.gid) AND gid_r = greatest(a.gid, b.gid)
    ),
    dp AS (
      SELECT least(x.rep, y.rep) AS rid_l, greatest(x.rep, y.rep) AS rid_r, count(*)::BIGINT AS n_pairs
      FROM rp JOIN v x ON x.doc_id = l JOIN v y ON y.doc_id = r GROUP BY 1, 2
    )"""
ORACLE["pair_features_documents"] = f"""
    WITH {_DOC_PAIRS}, {_TERMS},
    norm AS (SELECT doc_id, sum(tf * tf) AS t FROM tc GROUP BY 1),
    shared AS (
      SELECT rid_l, rid_r, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sa, sum(b.tf * b.tf) AS sb
      FROM dp JOIN tc a ON a.doc_id = rid_l JOIN tc b ON b.doc_id = rid_r AND b.term = a.term GROUP BY 1, 2
    )
    SELECT c.rid_l, c.rid_r, c.n_pairs,
           round(coalesce(dot / sqrt((sa + {_C2} * (na.t - sa)) * (sb + {_C2} * (nb.t - sb))), 0.0), 6)::DOUBLE AS sim_text,
           abs(da.n_chars - db.n_chars)::DOUBLE AS diff_n_chars
    FROM dp c LEFT JOIN shared s USING (rid_l, rid_r)
    LEFT JOIN norm na ON na.doc_id = c.rid_l LEFT JOIN norm nb ON nb.doc_id = c.rid_r
    JOIN documents da ON da.doc_id = c.rid_l JOIN documents db ON db.doc_id = c.rid_r"""

_C = f"{ONE_SIDED!r}::DOUBLE"
ORACLE["pair_features_nation"] = f"""
    WITH tc AS (
      SELECT n_nationkey AS id, term, count(*)::BIGINT AS tf
      FROM (SELECT n_nationkey, unnest(regexp_extract_all(lower(n_name), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM nation) GROUP BY 1, 2
    ),
    pr AS (SELECT a.n_nationkey AS l, b.n_nationkey AS r, abs(a.n_regionkey - b.n_regionkey)::DOUBLE AS diff FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
    w AS (
      SELECT l, r, x.id, x.term, x.tf * (CASE WHEN (SELECT count(*) FROM tc y WHERE y.id IN (l, r) AND y.term = x.term) = 2 THEN 1.0::DOUBLE ELSE {_C} END) AS w
      FROM pr JOIN tc x ON x.id IN (l, r)
    ),
    cosine AS (
      SELECT l, r,
             (SELECT coalesce(sum(p.w * q.w), 0) FROM w p JOIN w q ON p.term = q.term AND p.l = q.l AND p.r = q.r WHERE p.l = pr.l AND p.r = pr.r AND p.id = pr.l AND q.id = pr.r)
             / sqrt((SELECT sum(w * w) FROM w WHERE w.l = pr.l AND w.r = pr.r AND w.id = pr.l) * (SELECT sum(w * w) FROM w WHERE w.l = pr.l AND w.r = pr.r AND w.id = pr.r)) AS c
      FROM pr
    )
    SELECT pr.l::BIGINT AS rid_l, pr.r::BIGINT AS rid_r, round(c, 6)::DOUBLE AS sim_n_name, diff AS diff_n_regionkey FROM pr JOIN cosine USING (l, r)"""

ORACLE["split_labels_documents"] = f"""
    WITH {_DOC_PAIRS}
    SELECT rid_l, rid_r, n_pairs,
           (('0x' || substr(md5(rid_l || '-' || rid_r || '-label42'), 1, 8))::BIGINT % 2)::INTEGER AS y,
           CASE WHEN ('0x' || substr(md5(rid_l || '-' || rid_r || '-split42'), 1, 8))::BIGINT < {int(0.2 * 2**32)} THEN 1 ELSE 0 END AS held_out
    FROM dp"""


def _histogram(pairs: str, bins: int) -> str:
    return f"""
    WITH {pairs},
    h AS (SELECT least(floor(s * {bins} / 100)::INTEGER, {bins - 1}) AS bin, sum(n_pairs)::BIGINT AS c FROM p GROUP BY 1)
    SELECT i::INTEGER AS bin, i * {100.0 / bins!r}::DOUBLE AS low, (i + 1) * {100.0 / bins!r}::DOUBLE AS high, coalesce(c, 0)::BIGINT AS pairs
    FROM range({bins}) AS x(i) LEFT JOIN h ON h.bin = i"""


_PART_NAMES = f"""
    g AS ({_groups('part', 'p_partkey', ['p_name'])}),
    p AS (
      SELECT a.gid AS gid_l, b.gid AS gid_r, a.n * b.n AS n_pairs, {_lev('a.c0', 'b.c0')} * 100 AS s FROM g a JOIN g b ON a.gid < b.gid
      UNION ALL SELECT gid, gid, (n * (n - 1) // 2)::BIGINT, 100.0::DOUBLE FROM g WHERE n > 1
    )"""
ORACLE["histogram_part"] = _histogram(_PART_NAMES, 50)
ORACLE["histogram_orders"] = _histogram(
    _ORDER_PAIRS.replace("    p AS (", "    every AS (") + ", p AS (SELECT * FROM every WHERE s >= 99.5)", 200
)
ORACLE["matrix_part"] = f'WITH {_PART_NAMES} SELECT gid_l AS "row", gid_r AS col, round(s, 6) AS similarity FROM p'
ORACLE["edges_part"] = (
    f"WITH {_PART_NAMES} SELECT gid_l AS source, gid_r AS target, round(s, 6) AS weight, n_pairs::BIGINT AS n_pairs FROM p WHERE s >= 70.0"
)
_DEGREES = f"""
    SELECT a.p_partkey AS {{name}}, count(*)::BIGINT AS degree FROM part a JOIN part b ON a.p_partkey <> b.p_partkey
    WHERE {_lev('a.p_name', 'b.p_name')} * 100 >= 70.0 GROUP BY 1"""
ORACLE["nodes_part"] = _DEGREES.format(name="node")
ORACLE["degrees_part"] = _DEGREES.format(name="rid")
ORACLE["universe_part"] = f"""
    WITH e AS (
      SELECT a.p_partkey AS u, b.p_partkey AS v FROM part a JOIN part b ON a.p_partkey < b.p_partkey
      WHERE {_lev('a.p_name', 'b.p_name')} * 100 >= 80.0
    )
    SELECT u AS rid FROM e UNION SELECT v FROM e"""
_PART_PAIR = _mean([_lev(f"a.{c}", f"b.{c}") for c in _PART], _PART_WEIGHTS)
ORACLE["top_pairs_part"] = f"""
    SELECT a.p_partkey AS rid_l, b.p_partkey AS rid_r, round({_PART_PAIR} * 100, 6) AS similarity
    FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE {_PART_PAIR} * 100 >= 90.0
    ORDER BY {_PART_PAIR} DESC, rid_l, rid_r LIMIT 25"""
_TYPE_PAIRS = _PART_NAMES.replace("p_name", "p_type")
ORACLE["matrix_wide_type"] = f"""
    WITH {_TYPE_PAIRS},
    k AS (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS at FROM (SELECT gid_l AS gid FROM p UNION SELECT gid_r FROM p))
    SELECT r.gid AS "row", {', '.join(f'max(CASE WHEN c.at = {i} THEN round(s, 6) END) AS c{i}' for i in range(6))}
    FROM k r LEFT JOIN p ON gid_l = r.gid LEFT JOIN k c ON c.gid = gid_r GROUP BY 1"""
ORACLE["attach_customer"] = f"""
    SELECT a.c_custkey AS rid_l, b.c_custkey AS rid_r, round({_lev('a.c_name', 'b.c_name')} * 100, 6) AS similarity,
           a.c_name AS c_name_l, a.c_mktsegment AS c_mktsegment_l, b.c_name AS c_name_r, b.c_mktsegment AS c_mktsegment_r
    FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey WHERE {_lev('a.c_name', 'b.c_name')} * 100 >= 94.0"""
ORACLE["custom_scorer_part"] = f"""
    WITH g AS ({_groups('part', 'p_partkey', ['p_name'])})
    SELECT a.gid AS gid_l, b.gid AS gid_r, (100.0 - abs(length(a.c0) - length(b.c0)))::DOUBLE AS similarity FROM g a JOIN g b ON a.gid < b.gid"""
ORACLE["all_pairs_nation"] = """
    SELECT a.n_nationkey::BIGINT AS rid_l, b.n_nationkey::BIGINT AS rid_r, a.n_name AS n_name_l, b.n_name AS n_name_r
    FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"""
ORACLE["row_positions_orders"] = "SELECT (row_number() OVER () - 1)::BIGINT AS rid, o_orderkey FROM orders"
ORACLE["filled_labels"] = """
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)"""

ORACLE["scored_held_out_documents"] = f"""
    WITH {_DOC_PAIRS}
    SELECT rid_l, rid_r, n_pairs, true AS probable FROM dp
    WHERE ('0x' || substr(md5(rid_l || '-' || rid_r || '-split42'), 1, 8))::BIGINT < {int(0.2 * 2**32)}"""
