from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landflux.llm import runs
from landflux.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def smallest_period(words):
    """By the border table."""
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def plain_runs(words):
    """Every longest stretch of every period, kept if that period is its smallest."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    data = np.array([numbers[w] for w in words], np.int64)
    out = []
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate(([False], data[:-q] == data[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = high - low + q
            if length >= max(12, 2 * q) and smallest_period(data[low : low + length].tolist()) == q:
                out.append((low, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    return [[tuple(r) for r in rows.tolist()] for rows in runs.periodic_runs([[w.encode() for w in t] for t in texts])]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


ALIKE = {
    "one letter": ["a"] * 700,
    "fibonacci": fibonacci(1500),
    "thue-morse": thue_morse(1024),
    "squares of periodic halves": list("ab" * 60 + "a" + "ab" * 60 + "a" + "ba" * 40 + "b" + "ab" * 33),
    "three regions of one root": list("abc" * 50 + "ab" + "abc" * 70 + "a" + "abc" * 64 + "x"),
    "regions that end alike": list("x" + "ab" * 40 + "a" + "x" + "ab" * 40 + "a" + "x" + "ab" * 40 + "a"),
    "long root": [str(i % 97) for i in range(97 * 9 + 13)],
    "root of a long root": [str((i % 83) ** 2 % 7) for i in range(83 * 6)],
    "wide regions": (["p", "q", "r", "s", "t"] * 120)[:597] + (["r", "s", "t", "p", "q"] * 120)[:590],
    "nested": list(("ab" * 30 + "c") * 4 + "d" + ("ab" * 30 + "c") * 3),
}


@pytest.mark.parametrize("name", ALIKE)
def test_hard_texts(name):
    assert found([ALIKE[name]])[0] == plain_runs(ALIKE[name])


def test_regions_of_long_periods():
    """A square whose half is nine times a root of 30 words and a bit more."""
    rng = random.Random(2)
    root = [str(rng.randint(0, 5)) for _ in range(30)]
    for rest in (1, 7, 15, 29):
        half = root * 10 + root[:rest]
        words = ["x"] + half + half + ["y"] + half[3:] + half
        assert found([words])[0] == plain_runs(words)


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_texts(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(60):
        text = []
        while len(text) < rng.randint(1, 500):
            root = [rng.choice("abcdef"[:letters]) for _ in range(rng.randint(1, 60))]
            text += (root * rng.randint(1, 12))[: rng.randint(1, 300)]
        texts.append(text)
    texts += [[], ["a"], ["a"] * 11, ["a"] * 12]
    assert found(texts) == [plain_runs(t) for t in texts]


def test_one_long_text_among_short_ones():
    rng = random.Random(9)
    long = [str(rng.randint(0, 400)) for _ in range(3000)]
    long = long + long[-1200:] + long[-1200:][:500] + ["z"] * 40
    texts = [["a", "b"] * 9, long, ["a"] * 20]
    assert found(texts) == [plain_runs(t) for t in texts]


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(SPLIT.findall(d.text or ""), d.doc_id)
        want, row = plain_runs(words), got[d.doc_id]
        held = {i for s, n, q in want for i in range(s + q, s + n)}
        best = min(want, key=lambda r: (-r[1], r[0], r[2])) if want else (None, None, None)
        milli = 1000 * best[1] // best[2] if want else None
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(want), *best, milli)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert row.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in held))
        some += bool(want)
    assert some > 15


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = "say it again " * 6
    rows = [(None, text), (1, None), (1, None), (2, ""), (3, " \t\n"), (4, text + "é " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit("given") for n in ("RUNS", "n_words", "start")})
    out = runs.find_runs(docs, plant=False)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.start) for r in out.collect()]
    assert got[0] == (None, 18, [(0, 18, 3)], "say it again", "given")
    assert got[1] == got[2] == (1, 0, [], "", "given") and got[3] == (2, 0, [], "", "given") and got[4][1] == 0
    assert got[5][1:4] == (50_018, [(0, 18, 3), (18, 50_000, 1)], "say it again é")
    assert runs.find_runs(docs.filter("false"), plant=True).collect() == []
    assert runs.find_runs(docs, plant=True).filter("doc_id is null").first().collapsed == "say it again"
