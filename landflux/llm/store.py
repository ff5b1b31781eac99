"""Tables that several passes read, written under the session's shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from landflux.session import shared_dir


def sets_aside(*inner: str) -> Callable:
    """For an operator that adds columns named ``inner`` on its way: columns given under such names pass by.

    Names are compared as Spark does, without case.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            given = {c: f"{c}__given" for c in docs.columns if c.lower() in inner}
            out = operator(docs.withColumnsRenamed(given), *args, **options)
            return out.withColumnsRenamed({aside: c for c, aside in given.items()})

        return run

    return wrap


def other_columns(docs: DataFrame, results: list[str]) -> list[str]:
    """Columns of ``docs`` that no result replaces."""
    return [c for c in docs.columns if c.lower() not in results]


class Store:
    """Written tables of one job, in one folder of the shared folder.

    A kept table is computed once; a lost executor costs the reader only the
    rows it was reading. ``drop`` removes a table no later pass reads. What the
    returned DataFrame still reads stays until the cluster cleans its shared
    folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/landflux-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", compression).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stored_at = path
        return kept

    def keep_bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """A table sorted and bucketed by ``key``: joins on it move only the other side."""
        number = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"landflux_{uuid.uuid4().hex}"
        path = f"{self.root}/{self.count}"
        self.count += 1
        writer = df.repartition(number, key).write.bucketBy(number, key).sortBy(key)
        writer.option("path", path).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def release(self) -> None:
        """Let the driver forget finished steps, upon which Spark deletes their shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, kept: DataFrame) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(kept._stored_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
