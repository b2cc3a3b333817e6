"""Matches as a stream: a folder of Parquet files that grows.

running_counts() keeps counts by motif in the stream's state. search_stream() applies
the stateless searches to a stream of reads as they stand. whole_reads() gathers the
matches of a read until its end marker and hands them on once, in order; expiring_reads() also hands
on reads whose end never comes, when event time has passed them, so that state is bounded by
what has come within the waiting time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from seqframe.schema import MATCH


def match_stream(spark: SparkSession, path: str, schema: StructType = MATCH, *, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """query_name, n, sum_position: for output mode complete or update."""
    return stream.groupBy("query_name").agg(F.count("*").alias("n"), F.sum("position").alias("sum_position"))


def counts_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes the counts so far over the last ones, under a path of its own
    number; the batch with the highest number is the latest."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts in time windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def search_stream(reads: DataFrame, search, queries: dict[str, str], **options) -> DataFrame:
    return search(reads, queries, **options)


def whole_reads(stream: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """key, n, names: a read's motifs by position, when a row with query_name '<end>' has
    come for it. Reads that wait are state; append mode."""

    def gather(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        at = list(state.get[1]) if state.exists else []
        ended = False
        for frame in frames:
            for name, position in zip(frame["query_name"], frame["position"], strict=True):
                if name == "<end>":
                    ended = True
                else:
                    held.append(name)
                    at.append(int(position))
        if ended:
            state.remove() if state.exists else None
            order = sorted(range(len(held)), key=lambda k: (at[k], held[k]))
            yield pd.DataFrame({key: [of[0]], "n": [len(held)], "names": [",".join(held[k] for k in order)]})
        else:
            state.update((held, at))

    return stream.groupBy(key).applyInPandasWithState(gather, f"{key} string, n long, names string", "names array<string>, at array<int>", "append", GroupStateTimeout.NoTimeout)


class _Reads(StatefulProcessor):
    """Matches that wait, by key, and one event-time timer at the time of the last one and the wait."""

    def __init__(self, key: str, wait_ms: int, end: str):
        self.key, self.wait_ms, self.end = key, wait_ms, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "query_name string, position long, at long")

    def _read(self, key: tuple, rows: list[tuple], complete: bool) -> Row:
        names = [n for n, p, _ in sorted(rows, key=lambda r: (r[1], r[0])) if n != self.end]
        return Row(**{self.key: key[0], "n": len(names), "names": ",".join(names), "complete": complete})

    def _plan(self, rows: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.put(rows) if rows else self.held.clear()
        if rows:
            self.handle.registerTimer(max(r[2] for r in rows) + self.wait_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting: list[tuple] = []
        new = [(r["query_name"], r["position"], r["at"]) for r in rows]
        for row in sorted([*map(tuple, self.held.get()), *new], key=lambda r: (r[2], r[1], r[0])):
            if waiting and row[2] - waiting[-1][2] > self.wait_ms:
                yield self._read(key, waiting, False)
                waiting = []
            waiting.append(row)
            if row[0] == self.end:
                yield self._read(key, waiting, True)
                waiting = []
        self._plan(waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = list(map(tuple, self.held.get()))
        self._plan([])
        if rows:
            yield self._read(key, rows, False)

    def close(self) -> None:
        pass


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def expiring_reads(stream: DataFrame, *, key: str = "seq_id", time: str = "ts", late: str = "10 minutes", wait: int = 3600, end: str = "<end>") -> DataFrame:
    """key, n, names, complete: a read's motifs by position, once its end row has come
    (complete), or once nothing has come for it for more than `wait` seconds of event time: before
    the next row of its key, or by a timer when the watermark has passed. Rows later than the watermark are
    dropped. Needs the settings in STATE_STORE; append mode. stream has the key, query_name, position and time;
    end rows without a time are no rows. A read that waits costs its rows, a finished one nothing."""
    rows = stream.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    rows = rows.withColumn("at", F.unix_millis(time)).withColumn("position", F.col("position").cast("long"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithState(_Reads(key, wait * 1000, end), f"{key} {kind}, n long, names string, complete boolean", "Append", "EventTime")
