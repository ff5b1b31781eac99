"""What only a stream has: late readings, running state, the idempotent sink."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from landflux.sources.schemas import STORED
from landflux.sources.tables import readings_from_events
from landflux.streaming.towers import DIGITS, fixed_flux

BUDGET_UPDATE = f"tower_id bigint, n bigint, budget decimal(38,{DIGITS}), batch_id bigint"


def stream_readings(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Tower readings from event files, as they come."""
    source = spark.readStream.schema(STORED["events"])
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return readings_from_events(source.parquet(path))


class LateReadings(StreamingQueryListener):
    """Counts the readings that queries drop as later than their watermark.

    Counted where rows meet the watermark one by one: at ``unique_readings``,
    which a query must have in front of any sum, since a sum merges late rows
    before its state sees them. Every batch's progress is added up as it comes,
    however many there are.
    """

    OPERATORS = ("dedupe", "dedupeWithinWatermark")

    def __init__(self) -> None:
        self._counts: dict[str, int] = defaultdict(int)
        self._ended: dict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for op in event.progress.stateOperators:
            if op.operatorName in self.OPERATORS:
                self._counts[str(event.progress.runId)] += op.numRowsDroppedByWatermark

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def count(self, query: StreamingQuery, wait: float = 60) -> int:
        """Late readings so far; of a query that has ended, all of them."""
        if not query.isActive and not self._ended[str(query.runId)].wait(wait):
            raise TimeoutError("the query's last progress has not come")
        return self._counts[str(query.runId)]


def running_budget_stream(readings: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Cumulative flux per tower across batches: in update mode, a row for every tower a batch touches.

    Readings are summed in each task before they meet the state, so a busy tower
    sends one row a task.
    """
    return readings.groupBy("tower_id").agg(F.count("flux").alias("n"), F.sum(fixed_flux(digits)).alias("budget"))


def latest_budgets(updates: DataFrame) -> DataFrame:
    """Budgets from all rows that ``update_sink`` has stored so far."""
    last = F.max_by(F.struct("n", "budget"), "batch_id").alias("last")
    return updates.groupBy("tower_id").agg(last).select(
        "tower_id", "last.n", F.col("last.budget").cast("double").alias("budget")
    )


def run_in_parts(parts: list[DataFrame], source: str, start: Callable[[], StreamingQuery]) -> list[StreamingQuery]:
    """Append the parts to the folder ``source`` one after the other, and run a stream to its end after each.

    ``start`` starts the stream on the same checkpoint each time, so that all but
    the first run go on from the state and watermark the one before has left.
    """
    queries = []
    for part in parts:
        part.write.mode("append").parquet(source)
        query = start()
        query.awaitTermination()
        queries.append(query)
    return queries


def ledger_sink(
    closed: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write closed windows, one folder per batch; every window is stored once."""
    return _folder_per_batch(closed, path, checkpoint, "append", available_now)


def update_sink(
    updates: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write every update of a running state, one folder per batch."""
    return _folder_per_batch(updates, path, checkpoint, "update", available_now)


def _folder_per_batch(
    df: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool
) -> StreamingQuery:
    """A batch that runs again after a failure overwrites its own folder and no other."""

    def store(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    writer = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
