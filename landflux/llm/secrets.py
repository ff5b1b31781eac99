"""Secrets in texts: known forms, and strings of high sliding-window entropy.

Everything is built from column functions. Java's ``split`` and
``regexp_extract_all`` find the same leftmost matches, so the lengths of the
pieces between matches and of the matches give every position.

For entropy, candidates are maximal strings of one character class. A window
slides over each candidate; the count of every character of the class is kept
in the state, and a step changes the counts of the character that enters and of
the one that leaves. With S the sum of c log2 c over the counts c, the entropy
of a window of w characters is log2 w - S / w, and S changes by the two terms
alone. A candidate is reported if its highest window entropy reaches the bound
of its class and no allow rule suppresses it. A candidate that is not, or that
holds a known form, is taken apart, and its parts are candidates again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.llm.store import sets_aside

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


RUN = r"[A-Za-z0-9+/_=-]{24,}"  # candidates: maximal runs


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    needs: tuple[str, ...]  # patterns a candidate must match
    alphabet: str
    window: int
    least: float  # bits a character


UPPER, LOWER, DIGITS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=-"

# Every run that holds a letter has one class, by the letters and digits in it. The
# bounds of the last five are reached by 92 to 99 % of random strings of 32 (short hex: of 24).
CLASSES = [
    EntropyClass("hex_entropy", (r"^[0-9A-F]{32,}$",), "0123456789ABCDEF", 32, 3.0),
    EntropyClass("mixed_entropy", ("[0-9]", "[a-z]", "[A-Z]"), UPPER + LOWER + DIGITS + MARKS, 24, 3.9),
    EntropyClass("lower_entropy", ("[0-9]", "[a-z]", "^[^A-Z]+$"), LOWER + DIGITS + MARKS, 24, 3.75),
    EntropyClass("upper_entropy", ("[0-9]", "[A-Z]", "^[^a-z]+$", "[^0-9A-F]"), UPPER + DIGITS + MARKS, 24, 3.75),
    EntropyClass("letter_entropy", ("[a-z]", "[A-Z]", "^[^0-9]+$"), UPPER + LOWER + MARKS, 24, 3.9),
    EntropyClass("one_case_entropy", ("^([^0-9A-Z]*[a-z][^0-9A-Z]*|[^0-9a-z]*[G-Z+/_=-][^0-9a-z]*)$", "[A-Za-z]"), UPPER + LOWER + MARKS, 24, 3.7),
    EntropyClass("short_hex_entropy", (r"^[0-9A-F]{24,31}$", "[A-F]"), "0123456789ABCDEF", 24, 3.05),
]
# candidates never reported: names of several plain words, placeholders, paths, runs of one alphabet in order
ALLOWED = [
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]",
    r"(?i)^[a-z]+([_/=+-]+[a-z]+)+[0-9]{0,4}$",
    r"^[/_=+-]*([a-z]+[0-9]{0,2}|[0-9]+)([/_=+-]+([a-z]+[0-9]{0,2}|[0-9]+))+[/_=+-]*$",
    r"^[0-9]+$",
    r"(?i)abcdefgh|01234567|12345678",
    r"^(.{1,4})\1+$",
]
KINDS = ["assign", "access", "hex", *(c.kind for c in CLASSES)]
PIECES = "array<struct<start:bigint,end:bigint,value:string>>"
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def _located(text: Column, pattern: str, kind: str, where: Column | None = None) -> Column:
    """Spans of all matches, code points, end exclusive; empty where ``where`` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))
    rank = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(
            begin.alias("start"), rank.alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, start, step)["spans"]
    present = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    return F.when(present, spans).otherwise(F.array().cast(SPANS))


def _terms(n: Column) -> Column:
    """c log2 c, 0 for 0."""
    return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(F.lit(0.0))


def peak_entropy(value: Column, cls: EntropyClass) -> Column:
    """Highest entropy of a window over ``value``, by counts that change at both ends only."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(cls.alphabet), c))
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))),
        lambda i: F.struct(
            F.element_at(codes, i).alias("enter"),
            F.when(i > cls.window, F.element_at(codes, F.greatest(i - cls.window, F.lit(1)))).otherwise(F.lit(0)).alias("leave"),
            i.alias("i"),
        ),
    )
    empty = F.struct(
        F.array_repeat(F.lit(0.0), len(cls.alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("most")
    )

    def step(acc: Column, x: Column) -> Column:
        old_in = F.element_at(acc["counts"], x["enter"])
        old_out = F.when(x["leave"] > 0, F.element_at(acc["counts"], F.greatest(x["leave"], F.lit(1))))
        same = x["enter"] == x["leave"]
        s = F.when(same, acc["s"]).otherwise(
            acc["s"]
            + _terms(old_in + 1)
            - _terms(old_in)
            + F.when(x["leave"] > 0, _terms(old_out - 1) - _terms(old_out)).otherwise(F.lit(0.0))
        )
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(
                acc["counts"],
                lambda c, j: c
                + F.when(j + 1 == x["enter"], F.lit(1.0)).otherwise(F.lit(0.0))
                - F.when(j + 1 == x["leave"], F.lit(1.0)).otherwise(F.lit(0.0)),
            )
        )
        full = x["i"] >= cls.window
        bits = F.lit(1.0) * F.log2(F.lit(float(cls.window))) - s / cls.window
        return F.struct(
            counts.alias("counts"), s.alias("s"), F.when(full, F.greatest(acc["most"], bits)).otherwise(acc["most"]).alias("most")
        )

    return F.aggregate(steps, empty, step)["most"]


def _kind(value: Column) -> Column:
    """Name of the class whose bound a string reaches, null if none or if an allow rule holds."""
    # Java calls itself for each turn of a group, unless it never steps back; these groups need not
    allowed = reduce(Column.__or__, [value.rlike(p.replace(")+", ")++")) for p in ALLOWED])
    reached = [
        F.when(reduce(Column.__and__, [value.rlike(p) for p in c.needs]) & (peak_entropy(value, c) >= c.least), F.lit(c.kind))
        for c in CLASSES
    ]
    return F.when(~allowed & (F.length(value) >= min(c.window for c in CLASSES)), F.coalesce(*reached))


def _piece(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))


def _overlapping(s: Column, spans: Column) -> Column:
    return F.filter(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _cut(s: Column, spans: Column) -> Column:
    """What spans, sorted by start, leave of the string ``s``, in pieces."""
    sub = lambda a, b: _piece(a, b, F.substring(s["value"], (a - s["start"] + 1).cast("int"), (b - a).cast("int")))
    start = F.struct(s["start"].alias("at"), F.array().cast(PIECES).alias("pieces"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.concat(acc["pieces"], F.array(sub(acc["at"], b["start"]))))
            .otherwise(acc["pieces"])
            .alias("pieces"),
        )

    def rest(acc: Column) -> Column:
        return F.when(acc["at"] < s["end"], F.concat(acc["pieces"], F.array(sub(acc["at"], s["end"])))).otherwise(acc["pieces"])

    return F.aggregate(_overlapping(s, spans), start, step, rest)


def _parts(s: Column) -> Column:
    """Names and values of a run, divided at "="; padding stays with the last."""
    return F.transform(
        _located(s["value"], "[^=]+={0,2}$|[^=]+", "run"),
        lambda p: _piece(s["start"] + p["start"], s["start"] + p["end"], p["value"]),
    )


def _named(strings: Column, spans: Column) -> Column:
    """``strings`` with ``free`` (no span overlaps it) and ``kind`` (of its class)."""
    return F.transform(
        strings,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            (F.size(_overlapping(s, spans)) == 0).alias("free"),
            _kind(s["value"]).alias("kind"),
        ),
    )


def _spans(named: Column) -> Column:
    rank = F.coalesce(*[F.when(named["kind"] == k, F.lit(n)) for n, k in enumerate(KINDS)])
    return F.struct(
        named["start"].alias("start"), rank.alias("rank"), named["kind"].alias("kind"), named["end"].alias("end"), named["value"].alias("value")
    )


def _beside(p: Column) -> Column:
    """Letters and digits of a piece that touch the known forms inside a reported string."""
    head = F.when(p["start"] > p["first"], F.regexp_extract(p["value"], "^[A-Za-z0-9]+", 0)).otherwise(F.lit(""))
    tail = F.when(p["end"] < p["last"], F.regexp_extract(p["value"], "[A-Za-z0-9]+$", 0)).otherwise(F.lit(""))
    span = lambda start, value: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), p["whole"].alias("kind"))
    both = F.array(span(p["start"], head), span(p["end"] - F.length(tail), tail))
    return F.array_distinct(F.filter(both, lambda s: F.length(s["value"]) > 0))


@sets_aside("_runs", "_parts", "_pieces")
def find_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) with ``secret_spans``: start, rank, kind, end, value.

    ``docs`` needs a ``text`` column; a null text counts as empty. Whole texts
    are scanned, rows are independent, and no row is dropped, so ties, repeats
    and empty tables need no rule. An existing ``secret_spans`` is replaced. Spans
    of known forms (assign, access, hex) are always kept, and no entropy span
    overlaps them. A run that holds known forms, or is not reported as a whole, is
    divided at "=" into names and values, and the known forms are cut out; each
    part is judged by itself, with the allow list. Where a part is reported with
    the access ids or hex strings it holds, the letters and digits that touch those
    are spans too, however short. Sorted by start, then kind as in ``KINDS``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    hinted = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("key")
    values = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE
    base = F.concat(
        F.filter(_located(text, ASSIGN, "assign", hinted), values),
        _located(text, ACCESS, "access", text.contains("AKIA")),
        _located(text, HEX, "hex"),
    )
    found = docs.withColumn("secret_spans", F.sort_array(base)).withColumn("_runs", _located(text, RUN, "run"))
    # a run that is one known form leaves nothing to judge
    spans = F.col("secret_spans")
    covered = lambda s: F.exists(spans, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    found = found.withColumn("_runs", _named(F.filter("_runs", lambda s: ~covered(s)), spans))
    whole = F.filter("_runs", lambda s: s["free"] & s["kind"].isNotNull())
    divided = F.filter("_runs", lambda s: ~s["free"] | s["kind"].isNull() & s["value"].contains("="))
    assigned = F.filter("secret_spans", lambda b: b["rank"] == KINDS.index("assign"))
    parts = F.flatten(F.transform(divided, lambda s: F.flatten(F.transform(_parts(s), lambda p: _cut(p, assigned)))))
    found = found.withColumn("_parts", _named(F.filter(parts, lambda p: ~covered(p)), spans))
    known = F.filter("_parts", lambda p: ~p["free"])

    def pieces(p: Column) -> Column:
        return F.transform(
            _cut(p, spans),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                _kind(s["value"]).alias("kind"),
                p["kind"].alias("whole"),
                p["start"].alias("first"),
                p["end"].alias("last"),
            ),
        )

    found = found.withColumn("_pieces", F.flatten(F.transform(known, pieces)))
    beside = F.flatten(F.transform(F.filter("_pieces", lambda p: p["kind"].isNull() & p["whole"].isNotNull()), _beside))
    added = [
        whole,
        F.filter("_parts", lambda p: p["free"] & p["kind"].isNotNull()),
        F.filter("_pieces", lambda p: p["kind"].isNotNull()),
        beside,
    ]
    found = found.withColumn("secret_spans", F.sort_array(F.concat(spans, *[F.transform(a, _spans) for a in added])))
    return found.drop("_runs", "_parts", "_pieces")


@sets_aside("_done")
def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every found span of the text replaced by ``mark``; overlaps become one mark."""
    found = find_secrets(docs)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(cut(acc["at"], s["start"]), F.lit(mark))))
            .otherwise(acc["parts"])
            .alias("parts"),
        )

    done = F.aggregate("secret_spans", start, step)
    found = found.withColumn("_done", F.when(F.size("secret_spans") > 0, done))
    clean = F.concat(F.array_join("_done.parts", ""), F.substring(F.col("text"), (F.col("_done.at") + 1).cast("int"), F.length("text")))
    return found.withColumn("text", F.when(F.col("_done").isNotNull(), clean).otherwise(F.col("text"))).drop(
        "_done", "secret_spans"
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the known forms, digest of their spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("secret_spans").alias("spans"),
    )
