"""Conversations as training text, in windows of a token budget.

A turn is written ``### role: text</turn>`` and a line end. Inside a text the
strings ``###`` and ``</turn>`` are replaced by ``\\h`` and ``\\l``, and every
backslash by ``\\b``, so that control strings stand only where the template put
them and reading back is exact.

Prefix sums of turn tokens choose the windows: with a stride of the budget less
the system turn and the room for history, a turn belongs to the stride in which
it begins; one that ends beyond it stands in a window of its own. So a window
keeps to the budget unless a single turn is longer than that. A window repeats
the system turn and the last turns before it, and only assistant texts that no
earlier window showed are under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"
BUDGET = 1024  # tokens of a window
HISTORY = 2  # turns repeated before a window's own
HISTORY_TOKENS = 256  # room for them
LEAST_STRIDE = 128  # where a system turn leaves less
BYTES_A_TOKEN, TURN_TOKENS = 4, 4  # token estimate of a written turn

WINDOW = "array<struct<start:bigint,end:bigint>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("\\h")), F.lit(CLOSE), F.lit("\\l"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit(OPEN)), F.lit("\\l"), F.lit(CLOSE))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_turns(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """Windows (conv_id, window, text, loss, n_repeated, n_tokens) of ``turns``.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Null
    texts and roles count as empty, a null conv_id is one conversation of its
    own, and repeated or tied turns are all kept, ordered by turn (nulls first),
    role and text. ``window`` numbers a conversation's windows from 0, ``loss``
    holds code point spans [start, end) of the text in the loss mask, and the
    first ``n_repeated`` turns of a window are repeats. An empty table gives no
    windows.

    A conversation passes through window functions, one sorted run of rows; only
    the turns of one window are ever gathered.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("raw"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "raw"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    body = escape(F.col("raw"))
    head = F.concat(F.lit(f"{OPEN} "), _role(F.col("role")), F.lit(": "))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "raw",
        F.struct(head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("target")).alias("piece"),
    )
    tokens = F.ceil(F.octet_length("piece.body") / BYTES_A_TOKEN).cast("bigint") + TURN_TOKENS
    rows = rows.withColumn("tokens", tokens).withColumn("place", F.row_number().over(conv))
    first = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ordered = Window.partitionBy("conv_id").orderBy("place")
    opening = F.first(F.when(F.col("role") == "system", F.struct("piece", "tokens")), ignorenulls=False).over(first)
    rows = rows.withColumn("system", opening)
    stride = F.greatest(
        F.lit(LEAST_STRIDE), F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0))
    )
    end = F.sum("tokens").over(first) - F.when(F.col("system").isNotNull(), F.col("system.tokens")).otherwise(0)
    begin = F.greatest(F.lit(0), end - F.col("tokens"))
    rows = rows.withColumn("span", F.floor(begin / stride)).withColumn("over", (end > (F.col("span") + 1) * stride).cast("int"))
    earlier = []
    room = F.lit(0)
    for k in range(1, history + 1):
        at = F.lag(F.struct("piece", "tokens", "place"), k).over(ordered)
        room = room + F.coalesce(at["tokens"], F.lit(0))
        wanted = at.isNotNull() & (room <= history_tokens) & ~((at["place"] == 1) & F.col("system").isNotNull())
        earlier.insert(0, F.when(wanted, F.struct(at["piece"].alias("piece"), at["tokens"].alias("tokens"))))
    starts = (F.lag("span", 1, -1).over(ordered) != F.col("span")) | (F.lag("over", 1, 0).over(ordered) != F.col("over"))
    repeats = F.array_compact(F.array(F.when(F.col("place") > 1, F.col("system")), *earlier))
    rows = rows.withColumn("repeats", F.when(starts, repeats))
    packed = rows.groupBy("conv_id", "span", "over").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece", "tokens"))).alias("own"),
        F.first("repeats", ignorenulls=True).alias("repeats"),
        F.min("place").alias("from_place"),
    )
    plain = lambda p, target: F.struct(p["piece"]["head"].alias("head"), p["piece"]["body"].alias("body"), target.alias("target"))
    packed = packed.withColumn(
        "pieces",
        F.concat(
            F.transform("repeats", lambda p: plain(p, F.lit(False))),
            F.transform("own", lambda p: plain(p, p["piece"]["target"])),
        ),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(WINDOW).alias("spans"))
    written = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1
    spans = F.aggregate(
        "pieces",
        start,
        lambda a, p: F.struct(
            (a["at"] + written(p)).alias("at"),
            F.when(
                p["target"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["head"])).alias("start"),
                            (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(f"{CLOSE}\n"))), "")
    counted = F.aggregate(
        F.concat(F.transform("repeats", lambda p: p["tokens"]), F.transform("own", lambda p: p["tokens"])),
        F.lit(0).cast("bigint"),
        lambda a, t: a + t,
    )
    numbered = Window.partitionBy("conv_id").orderBy("from_place")
    return packed.select(
        "conv_id",
        (F.row_number().over(numbered) - 1).alias("window"),
        text.alias("text"),
        spans.alias("loss"),
        F.size("repeats").alias("n_repeated"),
        counted.alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows with ``turns`` (role, text), their own turns only, and ``loss_texts``, both unescaped."""
    written = F.filter(F.split("text", f"{CLOSE}\n", -1), lambda t: t != "")
    own = F.slice(written, F.col("n_repeated") + 1, F.size(written))
    colon = lambda t: F.instr(t, ": ")
    role = lambda t: unescape(F.replace(F.substring(t, F.lit(5), colon(t) - 5), F.lit("\\c"), F.lit(":")))
    rest = lambda t: unescape(F.substring(t, colon(t) + 2, F.length(t)))
    return windows.withColumn(
        "turns", F.transform(own, lambda t: F.struct(role(t).alias("role"), rest(t).alias("text")))
    ).withColumn(
        "loss_texts",
        F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: counts and digests of turns and loss."""
    read = read_back(windows).select(
        "conv_id",
        "window",
        F.size("turns").cast("bigint").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("loss_texts", "").alias("loss"),
        F.length("text").cast("bigint").alias("chars"),
    )
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"),
            F.sum("chars").alias("formatted_chars"),
            F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
            F.length(joined("loss")).cast("bigint").alias("loss_chars"),
            F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
