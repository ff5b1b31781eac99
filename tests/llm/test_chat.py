from __future__ import annotations

import hashlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from landflux.llm import chat  # noqa: E402

TURN = "conv_id bigint, turn bigint, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **options):
    """Windows read back against the plain conversations."""
    frame = spark.createDataFrame(rows, TURN).withColumn("span", F.lit("clash")).withColumn("window", F.lit(1))
    windows = chat.format_turns(frame, **options)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
    return windows


def test_hostile_texts_are_reversible(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi", "\\h \\l \\b \\\\", "####", "<</turn>", "", None, "a\nb\r\n é😀", ":", "# #"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, "weird: role ### </turn>", "x"), (2, 1, None, None), (None, 0, "user", "no id"), (3, None, "user", "no turn"), (3, 0, "assistant", "y")]
    check(spark, rows)


def test_repeats_ties_and_empty_table(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "tie"), (1, 1, "assistant", "end")]
    check(spark, rows)
    assert chat.format_turns(spark.createDataFrame([], TURN)).count() == 0


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "s " * 40)]
    rows += [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i * 7 % 160)) for i in range(1, 90)]
    rows += [(1, 90, "assistant", "long " * 3000), (1, 91, "user", "bye")]
    windows = check(spark, rows, budget=400, history=2, history_tokens=100).orderBy("window").collect()
    assert len(windows) > 5 and [w.window for w in windows] == list(range(len(windows)))
    assert sum(w.n_tokens > 400 for w in windows) == 1  # the one turn longer than the budget
    for w in windows[1:]:
        assert w.text.startswith("### system: s s") and 1 <= w.n_repeated <= 3
        repeats = w.text.split("</turn>\n")[: w.n_repeated]
        shown = sum(len(t) + len("</turn>\n") for t in repeats)
        assert all(s.start >= shown for s in w.loss)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_no_python_in_the_plan(spark):
    windows = chat.digests(chat.format_turns(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
