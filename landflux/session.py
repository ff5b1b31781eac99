"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session. Joins whose one side is
# unique by key keep no pairs within a key, so letting adaptive execution split
# a hot key's partition is enough to spread it; "force" keeps that rule active
# even where it costs one more exchange. No join in the library carries a
# broadcast hint: Spark broadcasts a side only when its measured size is under
# spark.sql.autoBroadcastJoinThreshold, and shuffles both sides otherwise.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # texts are long: smaller batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # state of streams lies on the executors' disks, not in their heaps; keyed state with timers needs it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions of one tower are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Most bytes of shuffled rows a task should read; a session's own smaller value holds.
# Rows here are a few packed numbers: sorted and hashed by several steps of one task
# they take some twenty times their shuffled size.
PARTITION_KEY, PARTITION_MB = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16


def _bytes(size: str) -> int:
    number, scale = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(scale or " ")


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(PARTITION_KEY)) > PARTITION_MB << 20:
        spark.conf.set(PARTITION_KEY, f"{PARTITION_MB}m")
    return spark


def local_session(app: str = "landflux", cores: str = "8", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
    )
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a single-machine session may go without; it gets a temporary folder.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="landflux-")
    return _own_dir


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, never used before."""
    return f"{shared_dir(spark)}/landflux-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table once under the shared folder and read it from there.

    For tables that several passes read: the work behind them is done once, and
    a lost executor costs only the rows it was reading.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
