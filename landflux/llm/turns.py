"""Repair of conversations at least cost, by a rank-convergence parallel Viterbi.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Rows may be kept (0), given the role user or assistant (2) or deleted (3); empty
user and assistant rows may be inserted anywhere (2). Blank and repeated rows
must be deleted; a truncated row costs 1 if it stays. Of the cheapest edits, those
whose initials D, I, K, R in order make the least text are taken.

The cost of finishing from a row in each of four states is a vector, worked out
from the last row backwards. A conversation is cut into chunks wherever the
sorted table is cut into partitions, and after ``CHUNK`` rows at most, so one with
a third of all rows is spread over many tasks:

* Every chunk starts from a speculative vector, that of a conversation's end.
* Fix-up passes run a chunk again from the vector its right neighbour came to,
  if the two differ by more than a constant. Vectors are held less their least
  entry, so that they differ by a constant only if they are equal.
* A chunk whose rows never settle the state (all of one role, say) hands any
  difference on, one chunk a pass. What ``PASSES`` passes leave open is solved
  from the chunks' responses to the four unit vectors, by a product in the order
  of the chunks: one short row a chunk, as many as partitions at most.
* With the vectors stitched, the edits of least initials are traced forwards: every
  chunk for each state it may be entered in, then from the one it is entered in.

Within a task the step from one vector to the next is remembered by vector and
kind of row, of which there are a few hundred.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.llm.store import Store

CHUNK = 1 << 16
PASSES = 4

# states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
AFTER_INSERT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
END = (0, 4, 2, 0)
FAR = 1 << 20
UNITS = tuple(tuple(0 if i == q else FAR for i in range(4)) for q in range(4))
DELETE, RENAME, INSERT = 3, 2, 2

# A row's kind is one letter: the initial of its role (s, u, a, else x), in upper
# case if it is truncated; a row that must go has a digit, 0 for blank and 1 for
# repeated.
BLANK, REPEATED = "01"

_NEXT: dict = {}
_TRACE: dict = {}


def _level(vector: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    least = min(vector)
    return least, tuple(min(v - least, FAR) for v in vector)


def _choices(kind: str, state: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(edit, cost with all that follows, next state) for a row, without inserts before it."""
    yield "D", DELETE + after[state], state
    if kind not in (BLANK, REPEATED):
        role, stays = kind.lower(), int(kind.isupper())
        to = KEEP[role][state]
        if to is not None:
            yield "K", stays + after[to], to
        to = AFTER_INSERT[state]
        yield "U" if to == 2 else "A", stays + RENAME + after[to], to


def _before_row(kind: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    plain = [min(cost for _, cost, _ in _choices(kind, q, after)) for q in range(4)]
    whole = []
    for q in range(4):
        one = AFTER_INSERT[q]
        whole.append(min(plain[q], INSERT + plain[one], 2 * INSERT + plain[AFTER_INSERT[one]]))
    return _level(tuple(whole))


def before_row(kind: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """(constant, vector) before a row, from the vector after it.

    Entries of a vector that a conversation's end leads to differ by 5 at most,
    so few are remembered.
    """
    key = kind, after
    if key not in _NEXT:
        _NEXT[key] = _before_row(kind, after)
    return _NEXT[key]


def run_back(kinds: str, right: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[int, ...]]]:
    """The vector before a chunk, and those after each of its rows."""
    vector, after = right, [right] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        after[i] = vector
        vector = before_row(kinds[i], vector)[1]
    return vector, after


def response(kinds: str, unit: tuple[int, ...]) -> list[int]:
    """Costs before a chunk if it must be left in one state, far ones standing for infinity."""
    total, vector = _level(unit)
    for kind in reversed(kinds):
        more, vector = _before_row(kind, vector)
        total += more
    return [total + v for v in vector]


def edit_row(kind: str, state: int, after: tuple[int, ...]) -> tuple[str, int, int]:
    """(edits, cost, next state) of least initials: inserts u or a, then D, K, U or A."""
    key = kind, state, after
    if key not in _TRACE:
        edits, paid, q = "", 0, state
        while True:
            here = [(cost, letter, to) for letter, cost, to in _choices(kind, q, after)]
            least = min(cost for cost, _, _ in here)
            one = AFTER_INSERT[q]
            two = AFTER_INSERT[one]
            later = [
                INSERT * k + min(cost for _, cost, _ in _choices(kind, at, after)) for k, at in ((1, one), (2, two))
            ]
            best = min(least, *later)
            found = {letter: (cost, to) for cost, letter, to in here if cost == best}
            if "D" in found or best not in later:
                letter = next(x for x in "DKUA" if x in found)
                cost, to = found[letter]
                _TRACE[key] = edits + letter, paid + cost - after[to], to
                break
            edits += "u" if one == 2 else "a"
            paid += INSERT
            q = one
    return _TRACE[key]


def finish(state: int) -> tuple[str, int]:
    """Inserts that end a conversation."""
    edits = ("", "ua", "a", "")[state]
    return edits, INSERT * len(edits)


def trace(kinds: str, right: tuple[int, ...], state: int, last: bool) -> tuple[list[str], int, int]:
    """(edits of each row, cost, state after the chunk) from one entry state."""
    _, after = run_back(kinds, right)
    edits, cost = [], 0
    for kind, vector in zip(kinds, after, strict=True):
        done, paid, state = edit_row(kind, state, vector)
        edits.append(done)
        cost += paid
    if last:
        done, paid = finish(state)
        if kinds:
            edits[-1] += done
        cost += paid
    return edits, cost, state


def _chunks_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition as chunks: (key, first position, kinds, initials)."""
    done: list[tuple[str, int, str, str]] = []
    key, start, kinds, roles = None, 0, [], []

    def listed() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds_of = (pa.string(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds_of, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["_c", "chunk", "kinds", "roles"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("_c", "_pos", "kind", "initial")]
        for c, pos, kind, role in zip(*columns, strict=True):
            if kinds and (c != key or pos != start + len(kinds) or len(kinds) >= rows):
                done.append((key, start, "".join(kinds), "".join(roles)))
                kinds, roles = [], []
            if not kinds:
                key, start = c, pos
            kinds.append(kind)
            roles.append(role)
        if done:
            yield listed()
            done = []
    if kinds:
        done.append((key, start, "".join(kinds), "".join(roles)))
        yield listed()


_VECTOR = "array<int>"
_CHUNK = "_c string, chunk bigint, kinds string, roles string"


def _per_chunk(fields: dict[str, pa.DataType], of) -> callable:
    """A function on batches that keeps their columns and adds ``fields`` worked out row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(row) for row in batch.to_pylist()]
            kept = [(n, batch.column(n)) for n in batch.schema.names if n not in fields]
            new = [(n, pa.array([f[n] for f in found], kind)) for n, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + new], names=[n for n, _ in kept + new])

    return run


def _schema(df: DataFrame, added: dict[str, str]) -> str:
    own = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in added]
    return ", ".join([*own, *(f"{n} {kind}" for n, kind in added.items())])


def _end() -> Column:
    return F.array(*[F.lit(v) for v in END])


def _run(chunks: DataFrame) -> DataFrame:
    """Chunks with the vector ``left`` that they come to from ``right``."""
    of = lambda row: {"left": list(run_back(row["kinds"], tuple(row["right"]))[0])}
    return chunks.mapInArrow(_per_chunk({"left": pa.list_(pa.int32())}, of), _schema(chunks, {"left": _VECTOR}))


def stitched(chunks: DataFrame, store: Store, passes: int = PASSES) -> DataFrame:
    """``chunks`` (_c, chunk, kinds, ...) with ``right``, the vector that holds after each."""
    line = Window.partitionBy("_c").orderBy("chunk")
    speculative = chunks.withColumn("right", _end())
    alone = F.count("*").over(Window.partitionBy("_c")) == 1
    parted = store.keep(speculative.withColumn("_alone", alone))
    settled = parted.filter("_alone").drop("_alone")
    several = parted.filter("not _alone").drop("_alone")
    if several.isEmpty():
        return settled
    vectors = store.keep(_run(several))
    for _ in range(passes):
        met = vectors.withColumn("_met", F.coalesce(F.lead("left").over(line), _end()))
        met = store.keep(met.withColumn("_open", F.col("_met") != F.col("right")))
        if met.filter("_open").isEmpty():
            return settled.unionByName(vectors.drop("left"))
        again = met.filter("_open").withColumn("right", F.col("_met")).drop("_met", "_open", "left")
        vectors = store.keep(met.filter("not _open").drop("_met", "_open").unionByName(_run(again)))

    of = lambda row: {"units": [response(row["kinds"], u) for u in UNITS]}
    units = vectors.select("_c", "chunk", "kinds").mapInArrow(
        _per_chunk({"units": pa.list_(pa.list_(pa.int64()))}, of), "_c string, chunk bigint, kinds string, units array<array<bigint>>"
    )

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk", ascending=False)
        vector, right = END, []
        for unit in part["units"]:
            right.append(list(vector))
            vector = _level(tuple(min(int(unit[q][i]) + vector[q] for q in range(4)) for i in range(4)))[1]
        return pd.DataFrame({"_c": part["_c"], "chunk": part["chunk"], "right": right})

    solved = units.drop("kinds").groupBy("_c").applyInPandas(multiply, f"_c string, chunk bigint, right {_VECTOR}")
    return settled.unionByName(vectors.drop("left", "right").join(solved, ["_c", "chunk"]))


def traced(chunks: DataFrame, store: Store) -> DataFrame:
    """``chunks`` with right: adds edits (one text a row), cost and the kind of the row before."""
    line = Window.partitionBy("_c").orderBy("chunk")
    chunks = chunks.withColumns(
        {"last": F.lead("chunk").over(line).isNull(), "before": F.lag(F.substring("roles", -1, 1)).over(line)}
    )
    chunks = store.keep(chunks.withColumn("first", F.col("before").isNull()))
    of = lambda row: {"exits": [trace(row["kinds"], tuple(row["right"]), q, False)[2] for q in range(4)]}
    open_ones = chunks.filter("not (first and last)").select("_c", "chunk", "kinds", "right")
    exits = open_ones.mapInArrow(
        _per_chunk({"exits": pa.list_(pa.int32())}, of), _schema(open_ones, {"exits": _VECTOR})
    )

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        state, entries = 0, []
        for out in part["exits"]:
            entries.append(state)
            state = int(out[state])
        return pd.DataFrame({"_c": part["_c"], "chunk": part["chunk"], "entry": entries})

    entered = exits.drop("kinds", "right").groupBy("_c").applyInPandas(follow, "_c string, chunk bigint, entry int")
    chunks = chunks.join(entered, ["_c", "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))

    def of_chunk(row: dict) -> dict:
        edits, cost, _ = trace(row["kinds"], tuple(row["right"]), row["entry"], row["last"])
        return {"edits": edits, "cost": cost}

    fields = {"edits": pa.list_(pa.string()), "cost": pa.int64()}
    added = {"edits": "array<string>", "cost": "bigint"}
    return store.keep(chunks.mapInArrow(_per_chunk(fields, of_chunk), _schema(chunks, added)))


def conv_key(conv_id: Column) -> Column:
    """A text for every conversation; rows with a null id are one conversation."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


_WORDY = "[^\\x20\\x09-\\x0D]"


class Repair:
    """The steps of one repair, each a DataFrame.

    ``turns`` needs conv_id, turn, role and text; other columns are not carried.
    Nulls in role and text are one space. Rows are taken by turn, nulls first;
    rows of one turn by role and text, so repeated rows are neighbours. A blank
    row has no character but white space; a repeated one has a role and text
    seen earlier in the conversation; a truncated one does not end in ``.!?``
    (white space aside). Each row's first fault counts. Roles are known by their
    initial; one that is not s, u or a can only be renamed or deleted. An empty
    table stays empty. ``chunk_rows`` bounds a chunk; texts are only passed on.
    """

    def __init__(self, turns: DataFrame, chunk_rows: int = CHUNK, passes: int = PASSES) -> None:
        if not 0 < chunk_rows <= CHUNK:
            raise ValueError(f"chunk_rows must be from 1 to {CHUNK}, so that far costs stay out of reach")
        self.store = Store(turns.sparkSession, "turns")
        space = F.lit(" ")
        told = turns.select(
            conv_key(F.col("conv_id")).alias("_c"),
            F.col("conv_id"),
            F.col("turn"),
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
        )
        order = ["_c", F.col("turn").asc_nulls_first(), "role", "text"]
        # a row's number breaks ties of equal rows, so that they may be dealt to several tasks
        numbered = told.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        numbered = self.store.keep(numbered)
        dealt = numbered.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        self.rows = self.store.keep(dealt.drop("_tie").withColumn("_pos", F.monotonically_increasing_id()))
        self.store.drop(numbered)
        self.chunks = traced(stitched(self._chunks(chunk_rows), self.store, passes), self.store)

    def _faults(self) -> DataFrame:
        digest = F.sha2(F.col("text").cast("binary"), 256)
        rows = self.rows.select(
            "_c",
            "_pos",
            "role",
            digest.alias("_digest"),
            F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(_WORDY)).alias("_blank"),
            (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("_cut"),
        )
        same = ["_c", "role", "_digest"]
        first = rows.groupBy(*same).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        again = first.filter("_n > 1").select(*same, "_first")
        seen = rows.join(again, same, "left")
        role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
        kind = (
            F.when(F.col("_blank"), BLANK)
            .when(F.col("_pos") > F.col("_first"), REPEATED)
            .when(F.col("_cut"), F.upper(role))
            .otherwise(role)
        )
        return seen.select("_c", "_pos", kind.alias("kind"), role.alias("initial"))

    def _chunks(self, chunk_rows: int) -> DataFrame:
        """Chunks of the sorted rows: a range of positions is a range of conversations and turns."""
        ordered = self.store.keep(self._faults()).repartitionByRange("_pos").sortWithinPartitions("_pos")
        return self.store.keep(ordered.mapInArrow(lambda batches: _chunks_of(batches, chunk_rows), _CHUNK))

    def summary(self) -> DataFrame:
        """A row for each conversation with rows: its faults, cost and audit."""

        def count(of: str) -> Column:
            return F.length("kinds") - F.length(F.translate("kinds", of, ""))

        pairs = F.concat(F.coalesce("before", F.lit("")), F.col("roles"))
        # s followed by u, u by a and a by u are well; of every neighbouring pair the second letter is looked at
        legal = F.size(F.regexp_extract_all(pairs, F.lit("u(?=a)|a(?=u)|s(?=u)"), F.lit(0)))
        audit = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
        per_chunk = self.chunks.select(
            "_c",
            "chunk",
            "cost",
            count(BLANK).alias("blank"),
            count(REPEATED).alias("duplicate"),
            count("SUAX").alias("truncated"),
            (F.length(pairs) - 1 - legal).alias("illegal"),
            audit.alias("audit"),
        )
        sums = [F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        parts = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
        joined = F.array_join(F.transform(parts, lambda p: p["audit"]), "")
        return per_chunk.groupBy("_c").agg(*sums, joined.alias("audit"))

    def gaps(self) -> DataFrame:
        """Turns missing between a conversation's least and greatest, nulls left out."""
        turn = F.col("turn").cast("bigint")
        span = F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)
        return self.rows.groupBy("_c").agg(F.coalesce(span, F.lit(0)).alias("gaps"))

    def repaired(self) -> DataFrame:
        """The repaired rows: conv_id, _c, _pos, step, role, text and edit (K, R or I), by _pos and step."""
        edits = self.chunks.select("_c", F.posexplode("edits").alias("_i", "_edits"), "chunk")
        edits = edits.select((F.col("chunk") + F.col("_i")).alias("_pos"), "_edits")
        steps = self.rows.join(edits, "_pos").select(
            "conv_id", "_c", "_pos", "role", "text", F.posexplode(F.split("_edits", "")).alias("step", "_e")
        )
        inserted = F.col("_e").isin("u", "a")
        role = (
            F.when(F.lower("_e") == "u", "user").when(F.lower("_e") == "a", "assistant").otherwise(F.col("role"))
        )
        return steps.filter("_e in ('u', 'a', 'K', 'U', 'A')").select(
            "conv_id",
            "_c",
            "_pos",
            "step",
            role.alias("role"),
            F.when(inserted, "").otherwise(F.col("text")).alias("text"),
            F.when(inserted, "I").when(F.col("_e") == "K", "K").otherwise("R").alias("edit"),
        )

    def digests(self) -> DataFrame:
        """The sha256 of each repaired conversation's ``role:text`` lines, hashed as they stream by.

        A digest takes its text in order, so a conversation's rows pass one task,
        which holds a batch of them at a time.
        """
        lines = self.repaired().select("_c", "_pos", "step", F.concat_ws(":", "role", "text").alias("line"))
        ordered = lines.repartition("_c").sortWithinPartitions("_c", "_pos", "step")
        return ordered.select("_c", "line").mapInArrow(_hash_lines, "_c string, repaired_sha256 string")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([digest.hexdigest()])], names=["_c", "repaired_sha256"]
        )

    for batch in batches:
        for c, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if digest is None or c != key:
                if digest is not None:
                    yield row()
                key, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
    if digest is not None:
        yield row()


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, by a checksum of conversation and turn; see the query's contract."""
    space = F.lit(" ")
    key = F.concat_ws(":", conv_key(F.col("conv_id")), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    told = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("_f")
    )
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_f") == 0, 0).when(F.col("_f") == 3, 2).otherwise(1)
    return told.select(
        "conv_id",
        "turn",
        F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(True), copies)).alias("_copy"),
    ).drop("_copy")


def report(turns: DataFrame, repair: Repair) -> DataFrame:
    """A row for every conversation of ``turns``, those without rows in ``repair`` included."""
    all_of = turns.groupBy(conv_key(F.col("conv_id")).alias("_c")).agg(F.max("conv_id").alias("conv_id"))
    found = all_of.join(repair.gaps(), "_c", "left").join(repair.summary(), "_c", "left")
    found = found.join(repair.digests(), "_c", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
