"""Quality rules: counts over whole texts, and how far a text is from its language.

Every language's reference is made from all documents labelled with it that
pass the base rules: the share of each character class, and the shares of its
most common words with one bin for all others. A document is compared with its
language by Jensen-Shannon distance (base 2, from 0 to 1) of both histograms.
Short texts have noisy histograms, and small references say little; the
least lengths below guard both.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landflux.llm.store import Store, other_columns, sets_aside

LEAST_WORDS = 50  # base rule
MOST_REPEATED = 50  # base rule: percent of words in repeated windows
COMMON = 64  # words of a language's histogram
GUARD_CHARS = 200  # code points in words, for the class histogram
GUARD_WORDS = 100  # for the word histogram
GUARD_REFERENCE = 2_000  # words behind a reference
CLASS_DISTANCE = 0.32
WORD_DISTANCE = 0.4

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-[]{}/\\_`"
SPACE = b" \t\n\r\x0b\f"
CLASSES = ["lower", "upper", "digit", "space", "punctuation", "symbol", "control", "two_byte", "three_byte", "four_byte"]
FOLLOWING = len(CLASSES)  # second and later bytes of a code point


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("control"), np.uint8)
    for name, members in (
        ("lower", range(ord("a"), ord("z") + 1)),
        ("upper", range(ord("A"), ord("Z") + 1)),
        ("digit", range(ord("0"), ord("9") + 1)),
        ("punctuation", [*PUNCTUATION, *b"+=@^~"]),
        ("symbol", SYMBOLS),
        ("space", SPACE),
        ("two_byte", range(0xC0, 0xE0)),
        ("three_byte", range(0xE0, 0xF0)),
        ("four_byte", range(0xF0, 0x100)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = FOLLOWING
    return table


TABLE = _class_table()
WORD_BYTES = bytes.maketrans(
    PUNCTUATION + SYMBOLS + bytes(range(65, 91)), b" " * len(PUNCTUATION + SYMBOLS) + bytes(range(97, 123))
)


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=FOLLOWING + 1)[:FOLLOWING]


def common_form(text: bytes) -> list[bytes]:
    """Words for the histogram: lower case, without punctuation and symbols."""
    return text.translate(WORD_BYTES).split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = row[:-1] * len(ids) + row[1:]
    if len(ids) > 1 << 20:  # three ids would not fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + row[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(row), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    classes = class_counts(text)
    return (
        len(words),
        int(classes.sum() - classes[CLASSES.index("space")]),
        int(classes[CLASSES.index("symbol")]),
        repeated_lines(text),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(parts.sum() / 2, 0.0)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language of texts that pass the base rules: class counts (class set) and word counts (word set)."""
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        for lang, text in zip(batch.column("_lang").to_pylist(), _texts(batch), strict=True):
            raw = text.split()
            if not base_failed(len(raw), repeated_words(raw)):
                words[lang].update(common_form(text))
                classes[lang] += class_counts(text)
        for lang, found in words.items():
            columns = [
                pa.array([lang] * (len(CLASSES) + len(found)), pa.string()),
                pa.array([*range(len(CLASSES)), *[None] * len(found)], pa.int32()),
                pa.array([*[None] * len(CLASSES), *found], pa.binary()),
                pa.array([*classes[lang].tolist(), *found.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_lang", "class", "word", "n"])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("_lang").to_pylist()
        first = {lang: at for at, lang in reversed(list(enumerate(langs)))}
        references = {lang: batch.column("_reference")[at].as_py() for lang, at in first.items()}
        counts, failed, by_class, by_word = [], [], [], []
        for lang, text in zip(langs, _texts(batch), strict=True):
            counted = base_counts(text)
            counts.append(counted)
            failed.append(base_failed(counted[0], counted[4]))
            known = references[lang]
            to_class = to_word = None
            if known and known["n"] >= GUARD_REFERENCE:
                if counted[1] >= GUARD_CHARS:
                    to_class = js_distance(class_counts(text), np.array(known["classes"]))
                if counted[0] >= GUARD_WORDS:
                    found = Counter(words := common_form(text))
                    own = [found[w] for w in known["words"]]
                    shares = [*known["counts"], known["n"] - sum(known["counts"])]
                    to_word = js_distance(np.array([*own, len(words) - sum(own)]), np.array(shares))
            by_class.append(to_class)
            by_word.append(to_word)
        added = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
        added += [pa.array(failed, pa.bool_()), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64())]
        names = [*batch.schema.names, *COUNTS, "base_failed", "class_distance", "word_distance"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)


REFERENCE = "struct<words:array<binary>,counts:array<bigint>,n:bigint,classes:array<bigint>>"


def references(docs: DataFrame, store: Store) -> DataFrame:
    """(_lang, _reference) of documents (_lang, text): word and class totals of all that pass the base rules.

    Counts are summed in each task before the shuffle. The common words of a
    language are chosen in slices of its words first; ties at the end go to the
    smaller word.
    """
    totals = docs.mapInArrow(_totals, "_lang string, class int, word binary, n bigint")
    totals = store.keep(totals.groupBy("_lang", "class", "word").agg(F.sum("n").alias("n")))
    words = totals.filter("word IS NOT NULL")
    salted = words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    order = [F.desc("n"), F.asc("word")]
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("_lang", "salt").orderBy(*order)))
    listed = best.filter(F.col("place") <= COMMON).groupBy("_lang").agg(
        F.collect_list(F.struct((-F.col("n")).alias("less"), "word")).alias("all")
    )
    common = F.slice(F.sort_array("all"), 1, COMMON)
    listed = listed.select(
        "_lang",
        F.transform(common, lambda w: w["word"]).alias("words"),
        F.transform(common, lambda w: -w["less"]).alias("counts"),
    )
    by_class = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)) for k in range(len(CLASSES))]
    sizes = totals.groupBy("_lang").agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.array(*by_class).alias("classes")
    )
    joined = listed.join(sizes, "_lang")
    return joined.select("_lang", F.struct("words", "counts", "n", "classes").cast(REFERENCE).alias("_reference"))


@sets_aside("_lang", "_reference")
def judge(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with counts, distances (null where a guard holds), base_failed and kept.

    ``docs`` needs text and lang. A null text has no words and fails the base
    rules; a null lang is one language of its own. Every row is judged on its
    own whole text, so repeats and ties get equal verdicts; columns of ``docs``
    named like a result are replaced. An empty table stays empty.
    """
    results = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]
    own = other_columns(docs, results)
    store = Store(docs.sparkSession, "quality")
    inner = docs.select(*own, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"))
    known = store.keep(references(inner.select("_lang", "text"), store))
    met = inner.join(known, "_lang", "left").select(*inner.columns, "_reference")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields] + [f"{c} bigint" for c in COUNTS]
    schema = ", ".join([*kinds, "base_failed boolean, class_distance double, word_distance double"])
    measured = met.mapInArrow(_verdicts, schema)
    near = (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE
    )
    return measured.withColumn("kept", ~F.col("base_failed") & near).select(*own, *results)
