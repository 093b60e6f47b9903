"""Plain definitions the Spark results are checked against on small inputs."""

import math
import re


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lev_sim(a, b):
    longer = max(len(a), len(b))
    return 1.0 if longer == 0 else 1.0 - levenshtein(a, b) / longer


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    if not a or not b:
        return 0
    return round(200.0 * lcs(a, b) / (len(a) + len(b)))


def words(text):
    clean = re.sub(r"[^\w]", " ", text.lower())
    return sorted(set(clean.encode("ascii", "ignore").decode().split()))


def token_set(a, b):
    a, b = words(a), words(b)
    if not a or not b:
        return 0
    both = [w for w in a if w in b]
    one = " ".join(both + [w for w in a if w not in b])
    two = " ".join(both + [w for w in b if w not in a])
    both = " ".join(both)
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


def tfidf_cosine(a, b):
    docs = [re.findall(r"\w\w+", t.lower()) for t in (a, b)]
    vocab = sorted(set(docs[0]) | set(docs[1]))
    rows = []
    for d in docs:
        rows.append([d.count(t) * (math.log(3 / (1 + sum(t in x for x in docs))) + 1) for t in vocab])
    norms = [math.sqrt(sum(x * x for x in r)) for r in rows]
    if not all(norms):
        return 0.0
    return sum(x * y for x, y in zip(*rows)) / norms[0] / norms[1]


def record_pairs(table):
    return {(r.rid_l, r.rid_r): r.similarity for r in table.records().collect()}


def same(got, want, digits=6):
    assert set(got) == set(want)
    for k, v in want.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert abs(got[k] - v) < 10**-digits, (k, got[k], v)
