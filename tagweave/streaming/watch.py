"""Streams: watched folders that feed a store, and windows over events."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagweave.plans.store import IngestOptions, Store
from tagweave.sources.files import IGNORED, documents


def watched(spark: SparkSession, path: str, patterns: tuple[str, ...] = IGNORED, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the text files below a path as they come; the checkpoint remembers which were read."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(path)
    return documents(raw, patterns)


class Watch:
    """start, stop and state of streams, one for each watched folder, that ingest into a store.

    A folder's checkpoint remembers which files were read; reset() forgets them. A batch that fails is counted and ends
    its folder's stream with its error.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], store: Store, checkpoint: str, options: IngestOptions = IngestOptions()) -> None:
        self.spark, self.store, self.checkpoint, self.options = spark, store, checkpoint, options
        self.paths = [path] if isinstance(path, str) else list(path)
        self.queries: dict[str, StreamingQuery] = {}
        self.runs = self.processed = self.errors = 0
        self._how: dict = {}

    def _ingest(self, batch: DataFrame, _: int) -> None:
        try:
            if not batch.isEmpty():
                n = self.store.ingest(batch, self.options)["sources"]
                with self.store.lock:
                    self.processed += n
        except Exception:
            self.errors += 1
            raise

    def _start(self, path: str) -> StreamingQuery:
        place = f"{self.checkpoint}/{self.runs}/{zlib.crc32(path.encode()):08x}"
        self.queries[path] = watched(self.spark, path).writeStream.foreachBatch(self._ingest).option("checkpointLocation", place).trigger(**self._how).start()
        return self.queries[path]

    def start(self, once: bool = False, interval: str = "500 milliseconds") -> StreamingQuery | None:
        """Starts a stream for each folder; returns the first of them."""
        self._how = {"availableNow": True} if once else {"processingTime": interval}
        return next(iter([self._start(p) for p in self.paths]), None)

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()

    def add_path(self, path: str) -> bool:
        """Watches one more folder, at once if others are being watched; whether it is new."""
        if path in self.paths:
            return False
        self.paths.append(path)
        if any(q.isActive for q in self.queries.values()):
            self._start(path)
        return True

    def remove_path(self, path: str) -> bool:
        """Ends a folder's stream; whether it was watched."""
        if path not in self.paths:
            return False
        self.paths.remove(path)
        if path in self.queries:
            self.queries.pop(path).stop()
        return True

    def reset(self) -> None:
        self.stop()
        self.queries.clear()
        self.runs += 1
        self.processed = self.errors = 0

    def state(self) -> dict:
        active = [p for p, q in self.queries.items() if q.isActive]
        return {"running": bool(active), "paths": list(self.paths), "processed": self.processed, "errors": self.errors, "progress": {p: q.lastProgress for p, q in self.queries.items()}}


def windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """(start, by, n, total): events and the sum of their values in tumbling windows; batch or stream."""
    w = F.window("ts", width)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
