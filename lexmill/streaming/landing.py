"""Continuous ingest of landed pages.

Pages arrive as files; exact repeats of (url, content) within the watermark are
dropped, and every micro-batch is merged by ``foreachBatch``.
"""

from __future__ import annotations

import logging
import signal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lexmill.operators.crawlstate import ARTICLES, content_hash


def landed(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh(pages: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Pages whose (url, content hash) has not been seen within ``lateness``."""
    timed = pages.withColumn("event_time", F.timestamp_seconds("crawl_timestamp")).withColumn("content_hash", content_hash(F.col("html_content")))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["url", "content_hash"])


def start(pages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, interval: float | None = None):
    """Run ``merge`` on each micro-batch; ``merge`` must be idempotent per batch id.

    Without ``interval`` all that has landed is taken and the query ends; with it the query
    runs on, a batch beginning at most every so many seconds.
    """
    out = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if interval is None else out.trigger(processingTime=f"{int(1000 * interval)} milliseconds")).start()


def stop_after_batch(query, poll: float = 0.2) -> None:
    """Stop a query between two micro-batches, so that the running one is merged whole."""
    while query.isActive and query.status["isTriggerActive"]:
        query.awaitTermination(poll)
    query.stop()


def stop_on_signals(query, signals=(signal.SIGINT, signal.SIGTERM)) -> None:
    """Stop gracefully when the process is asked to end."""
    for s in signals:
        signal.signal(s, lambda *_: stop_after_batch(query))


def progress_line(done: int, target: int, seconds: float) -> str:
    """Rows done, share of the target, rows an hour and hours left; '-' where nothing can be told."""
    rate = 3600 * done / seconds if seconds > 0 else 0.0
    left = f"{(target - done) / rate:.1f}" if rate and target > done else "-"
    share = f"{100 * done / target:.1f}" if target > 0 else "-"
    return f"{done} of {target} pages ({share} %), {rate:.0f} an hour, {left} hours left"


class Progress(StreamingQueryListener):
    """Logs ``progress_line`` after every micro-batch."""

    def __init__(self, target: int, log=logging.getLogger("lexmill").info):
        self.target, self.log, self.done, self.seconds = target, log, 0, 0.0

    def onQueryStarted(self, event):
        self.done, self.seconds = 0, 0.0

    def onQueryProgress(self, event):
        self.done += event.progress.numInputRows
        self.seconds += event.progress.batchDuration / 1000
        self.log(progress_line(self.done, self.target, self.seconds))

    def onQueryTerminated(self, event):
        self.log(f"ended after {self.done} pages")
