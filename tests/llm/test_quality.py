from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from plain import docs_of  # noqa: E402

from landflux.llm import quality  # noqa: E402


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_base_counts_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c a b c", "x " * 3000, "é\x85b \x1c c　d", "|#|\n|#|\n \n \n", "a\n\na\n"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = quality.judge(docs_of(spark, texts, lang="xx", kept="clash")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows = quality.judge(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        words = texts[r.doc_id].split()
        if len(words) < 400:
            assert tuple(r[c] for c in quality.COUNTS) == plain_counts(texts[r.doc_id])
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert good and all(r.kept for r in good)


def test_distances(spark):
    p, q = np.array([3, 1, 0]), np.array([1, 1, 2])
    m = (p / 4 + q / 4) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert quality.js_distance(p, q) == pytest.approx(np.sqrt((kl(p / 4) + kl(q / 4)) / 2))
    assert quality.js_distance(p, p) == 0 and quality.js_distance(p, np.zeros(3)) == 0


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    words = ["the", "of", "and", "to", "in", "river", "stone", "walked", "under", "light", "over", "green", "house", "slowly"]
    prose = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(40)]
    junk = " ".join(rng.choice(["%%x%%", "##q##", "$$$z", "&&&&", "||k||"]) + str(i) for i in range(150))
    strange = " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(6)) for _ in range(150))
    rows = {r.doc_id: r for r in quality.judge(docs_of(spark, [*prose, junk, strange], lang="en")).collect()}
    assert all(rows[i].kept for i in range(40))
    assert not rows[40].kept and not rows[40].base_failed and rows[40].class_distance > quality.CLASS_DISTANCE
    assert not rows[41].kept and rows[41].word_distance > quality.WORD_DISTANCE


def test_empty_table_and_null_language(spark):
    assert quality.judge(docs_of(spark, [], lang="en")).collect() == []
    frame = spark.createDataFrame([(1, "w " * 60, None), (1, "w " * 60, None)], "doc_id bigint, text string, lang string")
    rows = quality.judge(frame).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
