"""Small frames and plain helpers for the text operators' tests."""

from __future__ import annotations


def docs_of(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    names = ["doc_id bigint", "text string", *(f"{k} string" for k in extra)]
    return spark.createDataFrame(rows, ", ".join(names))


def smallest_reachable(nodes, pairs):
    """Component (smallest member) of every node, by plain union-find."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
