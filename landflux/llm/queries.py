"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landflux.llm import chat, html_main, mixing, pieces, quality, repeats, runs, secrets, sharding, simhash, sql, turns, urls, vectors
from landflux.session import configure, run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash_near_dedup(spark, folder):
    return simhash.near_copies(_table(spark, folder, "documents"))


@query
def op2_chat_formatting(spark, folder):
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(hostile)))


@query
def op4_secret_scans(spark, folder):
    return secrets.digests(_table(spark, folder, "documents"))


SQL["op4_secret_scans"] = sql.secret_scans(
    secrets.ACCESS, secrets.HEX, secrets.RUN, secrets.LEAST_VALUE, secrets.CLASSES, secrets.ALLOWED
)


SQL["op2_chat_formatting"] = sql.OP2_CHAT


@query
def op3_quality_rules(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs).drop("text", "lang")
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


SQL["op3_quality_rules"] = sql.quality_rules(
    quality.COMMON,
    quality.GUARD_CHARS,
    quality.GUARD_WORDS,
    quality.GUARD_REFERENCE,
    quality.CLASS_DISTANCE,
    quality.WORD_DISTANCE,
)


@query
def op7_mixing_sources(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    measured = mixing.measure(docs).drop("text")
    return mixing.take(measured).select("doc_id", "size", "source_size", "target", "taken")


SQL["op7_mixing_sources"] = sql.OP7_MIXING


@query
def op5_sentencepiece(spark, folder):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs, model).drop("text"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_embedding_near_dedup(spark, folder):
    return vectors.near_vectors(_table(spark, folder, "embeddings"))


SQL["op10_embedding_near_dedup"] = sql.OP10_VECTORS


URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@query
def op6_url_filters(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).drop("url")


SQL["op6_url_filters"] = sql.url_filters(
    URL_RULES,
    urls.Z,
    urls.LEAST_LABELS,
    urls.SMOOTHING,
    urls.REJECT,
    urls.IDENTIFIER,
)


@query
def op8_html_extraction(spark, folder):
    return html_main.main_text(_table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op9_repeated_passages(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("bigint").alias("n_kept"),
    )


@query
def op11_sharding(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    written = sharding.write_shards(docs, run_dir(spark, "shards"))
    return written.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op12_periodic_runs(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    judged = runs.find_runs(docs, plant=True)
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    judged = judged.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.sha2(F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return judged.withColumn("exponent_milli", F.floor(F.col("length") * 1000 / F.col("period")).cast("bigint"))


@query
def op13_conversation_repair(spark, folder):
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turns.report(given, turns.Repair(turns.damage(given)))


SQL["op13_conversation_repair"] = sql.OP13_TURNS
