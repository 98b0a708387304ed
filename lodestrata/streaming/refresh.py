"""Structured Streaming: the planning log and a vault's notes kept current batch by batch.

A batch is applied in foreachBatch. The merge store takes repeated batches without harm (a version that is already there
wins or loses as it did), so replays after a failure are safe; the checkpoint holds which files were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changefeed import MergeStore, log_versions
from ..plans.index import classify
from ..runtime import cut, scratch


def follow_log(spark: SparkSession, path: str, store: MergeStore, schema: str | None = None, available_now: bool = True, every: str = "250 milliseconds", checkpoint: str | None = None) -> StreamingQuery:
    """Append each batch of new log rows below path (a folder, or a pattern) to the store; it compacts itself as runs gather.

    checkpoint keeps which files were read; it lies beside the store's runs unless given, so that a restart goes on from there.
    """
    wanted = schema or spark.read.parquet(path).schema
    lines = spark.readStream.schema(wanted).parquet(path)
    out = lines.writeStream.option("checkpointLocation", checkpoint or f"{store.path}/follow")
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)
    return out.foreachBatch(lambda batch, _: store.append(log_versions(batch))).start()


def distinct_history(stream: DataFrame, at: str | None = None, within: str = "30 days") -> DataFrame:
    """The first row of each hash of a history stream, the hashes seen being the state.

    at names a timestamp column by which the state is bounded: a hash is forgotten once the stream has gone on by `within`,
    and rows later than that are left out. Without it every hash is kept, which only a bounded stream can afford.
    """
    rows = stream.where("hash IS NOT NULL")
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(["hash"]) if at else rows.dropDuplicates(["hash"])


def poll_vault(spark: SparkSession, scan: Callable[[], DataFrame], stored: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], None], every: str = "1 second", checkpoint: str | None = None) -> StreamingQuery:
    """Rescan and diff on a clock: file sources see new files only, a vault's notes also change and vanish.

    apply(scan, actions) gets the scan and the classified paths whenever anything but 'unchanged' is among them. Changes
    between two ticks are one batch. The clock's checkpoint holds nothing of the vault: what was seen is what apply stored.
    """

    def tick(_: DataFrame, __: int) -> None:
        seen = cut(scan())
        acts = cut(classify(stored(), seen))
        if not acts.where(F.col("action") != "unchanged").isEmpty():
            apply(seen, acts)

    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.writeStream.option("checkpointLocation", checkpoint or scratch(spark, "poll-vault")).trigger(processingTime=every).foreachBatch(tick).start()
