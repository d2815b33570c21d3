"""Rows behind the watermark, kept instead of lost.

A windowed aggregation drops rows of windows that the watermark has closed.
``late_split`` runs the aggregation and, in the same query, lets the rows
themselves through: every micro-batch then holds what it emits and what it has
read, and the rows that the aggregation dropped in it are those whose window ends
at or before the watermark that Spark drops late rows by: that of the batch
before, which is the largest event time of all batches before that one less the
delay, to the millisecond.  (By the batch's own watermark windows are closed and
their state dropped, after its rows are counted.)  The largest time is kept in a
marker per batch, so a batch that runs again splits alike.

What is emitted and what is late together are all of the input, whatever the
order of files.  A row in several (sliding) windows is late once for each window
that was closed.

``DroppedRows`` listens to the progress of queries and counts what Spark reports
as dropped, over the whole run: ``recentProgress`` only keeps the last batches.
Spark counts after the partial aggregation, so that is the number of groups; the
rows are in the late table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from featureflow.functions.schema import quote
from featureflow.functions.time import epoch_micros, to_instant
from featureflow.operators.features import interval_micros
from featureflow.session import create_marker, read_marker
from featureflow.streaming.runner import BatchWriter

CLOSED = "_window_start"


def late_split(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], ts: str, window: str, watermark: str,
               state: str, write: BatchWriter, write_late: BatchWriter, slide: str | None = None) -> tuple[DataFrame, BatchWriter]:
    """(stream to start, its writer).  ``aggregate`` counts ``stream`` by windows
    of ``window`` (and ``slide``) on ``ts`` under ``watermark``; ``write`` gets
    what it emits, ``write_late`` the rows it dropped, with the start of the
    closed window.  ``state`` is a folder for the markers, one per checkpoint."""
    out = aggregate(stream)
    columns = [F.col(quote(c)) for c in stream.columns]
    row = F.struct(*columns)
    made = out.select(F.struct(*(F.col(quote(c)) for c in out.columns)).alias("_out"), F.lit(None).cast(
        stream.schema).alias("_row"))
    both = made.unionByName(stream.select(F.lit(None).cast(out.schema).alias("_out"), row.alias("_row")))
    dtype = stream.schema[ts].dataType
    delay = interval_micros(watermark) // 1000

    def split(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        def mark_of(batch: int) -> int | None:
            text = read_marker(spark, f"{state}/{batch}") if batch >= 0 else None
            return int(text) if text else None

        passed, largest = mark_of(batch_id - 2), mark_of(batch_id - 1)
        batch_df.persist()
        try:
            rows = batch_df.where("_row is not null").select("_row.*")
            instant = to_instant(F.col(quote(ts)), dtype)
            if passed is not None:
                mark = max(0, passed - delay) * 1000
                win = F.window(instant, window, slide) if slide else F.window(instant, window)
                late = rows.withColumn("_window", win).where(F.unix_micros("_window.end") <= mark)
                write_late(late.select(*columns, F.unix_micros("_window.start").alias(CLOSED)), batch_id)
            else:
                write_late(rows.limit(0).withColumn(CLOSED, F.lit(None).cast("long")), batch_id)
            write(batch_df.where("_out is not null").select("_out.*"), batch_id)
            newest = rows.agg(F.floor(F.max(epoch_micros(F.col(quote(ts)), dtype)) / 1000).alias("ms")).first()["ms"]
            known = [x for x in (largest, newest) if x is not None]
            create_marker(spark, f"{state}/{batch_id}", str(max(known)) if known else "")
        finally:
            batch_df.unpersist()

    return both, split


class DroppedRows(StreamingQueryListener):
    """What queries have dropped as late, by query id, since it was added:
    ``spark.streams.addListener(dropped)``."""

    def __init__(self):
        self.by_query: dict[str, int] = defaultdict(int)
        self.batches: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event) -> None:
        self.by_query[str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        self.batches[name] += 1
        self.by_query[name] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
