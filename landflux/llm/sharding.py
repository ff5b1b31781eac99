"""Shuffled shards of a table by an external shuffle in two passes.

Pass 1 deals the records uniformly into buckets that fit a task's memory: a
record's bucket is a seeded hash of its row number. Pass 2 shuffles every bucket
by Fisher-Yates, with a generator seeded by the bucket, and writes it. Buckets
are laid end to end in the order of their numbers, and that line is cut into
shards: contiguous, so nearly every bucket lands in one shard.

The law is ``rows``: shards differ by one row at most. Row numbers are written
before anything is dealt, so a task that runs again deals and shuffles the same
records the same way, whatever the plan behind ``docs``. Copies, ids and sources
play no part in the deal: a group of any size spreads over all buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landflux.llm.store import Store, other_columns, sets_aside

SHARDS = 8
SEED = 42
BUCKET_BYTES = 32 << 20
BUCKETS_A_SHARD = 4  # at least, so that a small table is still dealt over many tasks
BLOCK = 1024  # buckets whose counts are added up together
LAW = "rows"
RESULTS = ["size", "shard", "slot"]


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, and one for the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def place(position: np.ndarray, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of positions on a line of ``rows``: the first ``rows % shards`` shards hold one more."""
    each, longer = divmod(rows, shards)
    edge = longer * (each + 1)
    late = position - edge
    short = max(each, 1)
    shard = np.where(late < 0, position // (each + 1), longer + late // short)
    slot = np.where(late < 0, position % (each + 1), late % short)
    return shard.astype(np.int32), slot


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def bucket_offsets(numbered: DataFrame) -> DataFrame:
    """Rows before each bucket: running sums within blocks of buckets, and over blocks."""
    counts = numbered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    over_blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(over_blocks), none).alias("_before"))
    within = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(in_block), none))
    return within.join(blocks, "_block").select("_bucket", (F.col("_before") + F.col("_inner")).alias("_offset"))


@sets_aside("_row", "_bucket", "_offset")
def shuffle_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The rows of ``docs`` with size, shard and slot, each shard's slots gapless from 0.

    ``docs`` needs text; columns named like a result are replaced, others passed
    on. A null text has size 1, like an empty one. Repeated rows are records of
    their own. An empty table stays empty. Reruns on the same files with the same
    settings agree. A bucket holds ``bucket_bytes`` on average, and a longer
    record by itself.
    """
    store = Store(docs.sparkSession, "sharding")
    own = other_columns(docs, RESULTS)
    kept = docs.select(*own, record_size(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_row"))
    kept = store.keep(kept, compression="zstd")
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(BUCKETS_A_SHARD * shards, math.ceil(size / bucket_bytes))
    deal = F.pmod(F.xxhash64(F.lit(seed), F.col("_row")), F.lit(buckets)).cast("bigint")
    numbered = kept.withColumn("_bucket", deal)
    offsets = store.keep(bucket_offsets(numbered))
    names = [*own, "size"]

    def shuffle(records: pa.Table, offsets: pa.Table) -> pa.Table:
        bucket, start = (offsets.column(c)[0].as_py() for c in ("_bucket", "_offset"))
        dealt = np.argsort(records.column("_row").to_numpy(), kind="stable")
        order = dealt[fisher_yates(len(dealt), seed, bucket)]
        shard, slot = place(start + np.arange(len(order)), rows, shards)
        out = records.select(names).take(pa.array(order))
        return out.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot))

    fields = [f for f in kept.schema.fields if f.name in names]
    fields += [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    dealt = numbered.groupBy("_bucket").cogroup(offsets.groupBy("_bucket"))
    return dealt.applyInArrow(shuffle, T.StructType(fields))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shuffled shards as folders ``shard=0``, ... of ``path``, and return them as read back.

    Slots ascend within a file, so a reader that merges a shard's files by their
    first slot has the shard in its order.
    """
    shuffled = shuffle_shards(docs, **options)
    ordered = shuffled.sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shuffled.schema).parquet(path)
