from __future__ import annotations

import inspect
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from plain import smallest_reachable  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from landflux.llm import mixing, quality, secrets  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def left_of_near_copies(docs):
    """The smallest id of every group linked by 5-word Jaccard similarity of 0.8 or more, by all pairs."""
    rows = docs.select("doc_id", "text").collect()
    words = [(r.text or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    return sorted(set(smallest_reachable([r.doc_id for r in rows], pairs).values()))


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, docs, after))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and after.dtypes == docs.dtypes
        docs = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = seen
    assert ids(d1) == sorted(r.doc_id for r in quality.judge(d0).filter("kept").collect())
    assert ids(d2) == left_of_near_copies(d1) and len(ids(d2)) < len(ids(d1))
    assert ids(d3) == ids(d2) and secrets.digests(d3).filter("spans <> ''").count() == 0
    times = {r.doc_id: r.epochs + r.sampled for r in mixing.mix(d3).collect()}
    assert ids(d4) == sorted(i for i, n in times.items() for _ in range(n))
    assert ids(d5) == ids(d4) and d5.filter("not same_text").count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "same_text"] and out.count() > 0


def test_rows_with_nulls_and_repeats_pass(spark, tmp_path):
    text = " ".join(f"word{i % 40} of the day" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " more", None, None, None), (2, None, "en", None, 0), (3, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
            frame.collect()


def test_columns_of_any_name_pass_the_stages(spark, tmp_path):
    given = ["size", "_time", "kept", "n_words", "epochs", "_key", "secret_spans", "node", "Component", "given__0"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({n: F.lit(f"given {n}") for n in given})
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
    assert docs.count() > 0
    for name in given:
        assert docs.filter(F.col(f"`{name}`") != f"given {name}").count() == 0
