"""From raw documents to token ids: rules, near copies, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landflux.llm import mixing, pieces, quality, secrets, similar
from landflux.llm.store import Store
from landflux.session import configure

MODEL = "piece_bpe_32k.model"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def on_documents(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Columns beside those of ``documents`` pass a stage under names no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"given__{k}" for k, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(configure(spark), docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in aside.items()})

    return run


@on_documents
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language."""
    return quality.judge(docs).filter("kept").select(docs.columns)


@on_documents
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return similar.one_of_each(docs)


@on_documents
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@on_documents
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, one row each time."""
    mixed = mixing.mix(docs)
    times = (F.col("epochs") + F.col("sampled").cast("int")).cast("int")
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), times)).alias("_time")).drop("_time")


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text again."""
    import public_tokenizers

    configure(spark)
    model = public_tokenizers.path(MODEL)
    both = pieces.decode(pieces.encode(docs, model), model)
    return both.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixture", mixture),
    ("sentence_pieces", sentence_pieces),
]

#: The fingerprints' hash and the merge rounds have no SQL form; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
