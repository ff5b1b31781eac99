"""Columns of the input under any name an operator uses pass by unharmed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from landflux.llm import html_main, mixing, quality, repeats, secrets, urls
from landflux.llm.queries import URL_RULES

TEXT = " ".join(f"w{i % 30}" for i in range(120))


@pytest.mark.parametrize(
    "run, names",
    [
        (quality.judge, ["_lang", "_REFERENCE", "Kept", "_classes"]),
        (secrets.redact, ["_runs", "_done", "Secret_spans"]),
        (secrets.find_secrets, ["_Runs"]),
        (mixing.mix, ["_key", "_slice", "_source", "_before", "_budget", "_inner", "SIZE", "weight", "slice_size"]),
        (repeats.without_repeats, ["_text", "_row", "Ranges", "shared", "at", "Kept", "n_Bytes"]),
        (html_main.main_text, ["_host", "_html", "_blocks", "_nodes", "_low", "TEXT", "branch"]),
        (lambda df: urls.judge_urls(df, URL_RULES), ["_rule", "_shape", "n_labels", "HOST", "verdict"]),
    ],
)
def test_clashing_columns(spark, run, names):
    base = spark.createDataFrame(
        [(1, TEXT, "en", "s", "http://example.org/es/1", f"<p>{TEXT}</p>")],
        "doc_id bigint, text string, lang string, source string, url string, html string",
    )
    base = base.drop(*[c for c in base.columns if c in {n.lower() for n in names}])
    out = run(base.withColumns({n: F.lit(f"given {n}") for n in names}))
    row = out.first().asDict()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert all(row[n] == f"given {n}" for n in names if n.startswith("_"))
