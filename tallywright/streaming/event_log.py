"""Append-only event log as a stream: counts per window, latest state, and incremental page cache."""

from __future__ import annotations

import queue

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallywright import schemas


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """ST2: JSON lines that append_lines wrote, as a stream; malformed lines are dropped."""
    return spark.readStream.schema(schemas.EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Redelivered events of one id count once within the watermark; state of older ids is dropped."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """ST2: events per type and window; events later than ``late`` behind the newest are left out."""
    g = events.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def session_lengths(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each entity: start, end and number of events."""
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("s"), "entity_id").agg(F.count("*").alias("n"))
    return g.select("entity_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now as Parquet and stop; the checkpoint folder makes the next call go on where this one ended."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def cache_pages(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """ST3: new (file, configuration, page) rows are added to the page cache once; each micro-batch writes only pages that the cache lacks.
    Writing a batch again after a failure adds nothing, since its pages are there already."""

    def add(batch: DataFrame, _: int) -> None:
        key = ["pdf_sha256", "config_key", "page"]
        spark = batch.sparkSession
        one = batch.groupBy(*key).agg(F.min(F.struct(*[c for c in batch.columns if c not in key])).alias("m")).select(*key, "m.*")
        try:
            known = spark.read.schema(batch.schema).parquet(folder)
            one = one.join(known.select(*key), key, "left_anti")
        except Exception as error:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(error):
                raise
        one.write.mode("append").parquet(folder)

    query = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class ProgressQueue(StreamingQueryListener):
    """ST1: progress of running streams as events in a queue: register it with ``spark.streams.addListener``, poll it, and drain it once a query has ended.

    Events are dictionaries: kind STARTED, PROGRESS (batch, rows, rows a second), IDLE or TERMINATED (with the error, if any). The end comes after all progress of its query.
    """

    def __init__(self) -> None:
        self._events: queue.Queue[dict] = queue.Queue()

    def onQueryStarted(self, event) -> None:
        self._events.put({"kind": "STARTED", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._events.put({"kind": "PROGRESS", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self._events.put({"kind": "IDLE", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self._events.put({"kind": "TERMINATED", "id": str(event.id), "error": event.exception})

    def poll(self, seconds: float = 0.2) -> list[dict]:
        """Events that are there; waits up to ``seconds`` for a first one."""
        out = []
        try:
            out.append(self._events.get(timeout=seconds))
            while True:
                out.append(self._events.get_nowait())
        except queue.Empty:
            return out
