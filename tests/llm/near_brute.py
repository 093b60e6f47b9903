"""Near-copies by definition: what the operators are compared with."""

from twinfold.llm import minhash_near


def components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def bag(text):
    keys, counts, _ = minhash_near.shingles([text])
    return dict(zip(keys.tolist(), counts.tolist()))


def slow_jaccard(a, b):
    """The definition, term by term."""
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
