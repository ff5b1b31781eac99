from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from plain import docs_of  # noqa: E402

from landflux.llm import repeats  # noqa: E402


def plain_removal(texts, length):
    seen, again = set(), set()
    for b in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            (again if w in seen else seen).add(w)
    out = []
    for b in texts:
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in again:
                covered[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), len(bytes(covered).replace(b"\0", b" ").split()), kept))
    return out


def check(spark, texts, length):
    frame = docs_of(spark, texts, kept="clash", lang="en")
    got = sorted(repeats.without_repeats(frame, length).collect(), key=lambda r: r.doc_id)
    want = plain_removal([(t or "").encode() for t in texts], length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want
    assert all(r.lang == "en" for r in got)


@pytest.mark.parametrize("length, seed", [(20, 1), (40, 2), (100, 3), (400, 4)])
def test_random_texts_with_shared_passages(spark, length, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    shared = [word(rng.randint(length // 2, length * 3)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(word(rng.randint(0, length * 2)))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) // 3)
                parts.append(s[a : len(s) - rng.randint(0, len(s) // 3)])
        texts.append("".join(parts))
    check(spark, texts, length)


def test_edge_texts(spark):
    line = "the same line again and again, "
    texts = [None, "", "short", "a" * 300, "ab" * 200, line * 20, line * 20, "x" * 100 + line * 3, "xy" * 50 + "é" * 60, "é" * 60]
    check(spark, texts, 40)


def test_windows_of_just_the_length(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    same = word(60)
    texts = [word(33) + same + word(20), word(5) + same, same + word(50), word(80) + same[:59] + "#", same[1:] + "##"]
    check(spark, texts, 60)


def test_empty_table_and_missing_ids(spark):
    assert repeats.without_repeats(docs_of(spark, [])).collect() == []
    frame = spark.createDataFrame([(None, "q" * 500), (1, "q" * 500), (1, "q" * 500)], "doc_id bigint, text string")
    assert [r.n_removed for r in repeats.without_repeats(frame).collect()] == [500] * 3


def test_a_length_too_short_is_refused(spark):
    with pytest.raises(ValueError, match="length"):
        repeats.without_repeats(docs_of(spark, ["x"]), 10)
