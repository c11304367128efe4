"""Streams: queues of records into tables, dead letters, and spacing of position fixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from fieldlark.sources.writers import upsert_table


def record_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Records of a folder of JSON files, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def sync(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], version: str, valid: Column | None = None, dead: str | None = None) -> StreamingQuery:
    """Newest record of each key into a versioned table; records that fail a rule go to a dead-letter table.

    A batch that is repeated after a failure gives the same table, as a record of the same version replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
            good = df.where(ok)
            if not good.isEmpty():
                upsert_table(good, target, keys, version)
            if dead:
                df.where(~ok).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spaced(gap_seconds: float) -> Callable:
    """Accepts a fix if it is late enough after the last one accepted; what was dropped does not count."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f, keep = f.sort_values("ts", kind="stable"), []
            for t in f.ts:
                now = t.timestamp()
                keep.append(last is None or now - last >= gap_seconds)
                last = now if keep[-1] else last
            yield f[keep]
        if last is not None:
            state.update((last,))

    return step


def accepted_fixes(fixes: DataFrame, session: str, gap_seconds: float = 1.0) -> DataFrame:
    """Fixes of each session at least ``gap_seconds`` apart, batch or stream (R5). Needs a timestamp column ``ts``."""
    if fixes.isStreaming:
        return fixes.groupBy(session).applyInPandasWithState(spaced(gap_seconds), fixes.schema, "last double", "append", "NoTimeout")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        f = f.sort_values("ts", kind="stable")
        for t in f.ts:
            keep.append(last is None or t.timestamp() - last >= gap_seconds)
            last = t.timestamp() if keep[-1] else last
        return f[keep]

    return fixes.groupBy(session).applyInPandas(one, fixes.schema)


def _capture(n_good: int, most_accuracy: float, timeout_seconds: float) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            began, last, n, good, closed = state.get
            state.remove()
            if not closed:
                yield _closed(key, began, last, n, good, "timeout")
            return
        began, last, n, good, closed = state.get if state.exists else (None, None, 0, 0, False)
        for f in frames:
            f = f.sort_values("ts", kind="stable")
            for t, a in zip(f.ts, f.accuracy, strict=True):
                now = t.timestamp()
                began = now if began is None else began
                if closed or now > began + timeout_seconds:
                    continue
                last, n, good = now, n + 1, good + int(a is not None and a <= most_accuracy)
                if good >= n_good:
                    closed = True
                    yield _closed(key, began, last, n, good, "enough")
        if began is not None:
            state.update((began, last, n, good, closed))
            # The state goes when the session's time is over, whether it closed before or not.
            state.setTimeoutTimestamp(max(int((began + timeout_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    return step


def _closed(key: tuple, began: float, last: float, n: int, good: int, reason: str) -> pd.DataFrame:
    at = lambda x: pd.Timestamp(x, unit="s", tz="UTC")
    return pd.DataFrame({"session": [key[0]], "began": [at(began)], "ended": [at(last)], "n_fixes": [n], "n_good": [good], "reason": [reason]})


def captures(fixes: DataFrame, session: str, n_good: int, most_accuracy: float, timeout_seconds: float, late: str = "10 seconds") -> DataFrame:
    """(session, began, ended, n_fixes, n_good, reason): a session ends with its ``n_good``-th fix that is accurate enough, or when its time is over.

    ``fixes`` has ``ts`` and ``accuracy``; put :func:`accepted_fixes` before it for fixes that are some time apart. What comes
    after the end does not count. A stream keeps five values for a session, from its first fix until its time is over
    by the watermark, and gives a row when it ends. A batch has all fixes, so a session that has not enough is
    "timeout" if a later fix of it, or of any session, shows that its time is over, else "open".
    """
    kind = fixes.schema[session].dataType.simpleString()
    schema = f"session {kind}, began timestamp, ended timestamp, n_fixes long, n_good long, reason string"
    own = fixes.select(F.col(session).alias("session"), "ts", F.col("accuracy").cast("double").alias("accuracy"))
    if fixes.isStreaming:
        step = _capture(n_good, most_accuracy, timeout_seconds)
        return own.withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, schema, "began double, last double, n long, good long, closed boolean", "append", "EventTimeTimeout")
    way = Window.partitionBy("session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce((F.col("accuracy") <= most_accuracy).cast("long"), F.lit(0).cast("long"))
    df = own.withColumns({"_good": F.sum(good).over(way), "_from": F.first("ts").over(way)}).withColumn("_own", good)
    inside = (F.col("_good") - F.col("_own") < n_good) & (F.col("ts") <= F.col("_from") + F.make_dt_interval(secs=F.lit(timeout_seconds)))
    end = df.agg(F.max("ts").alias("_end"))
    out = df.where(inside).groupBy("session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n_fixes"), F.max("_good").alias("n_good"))
    over = F.col("_end") > F.col("began") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    reason = F.when(F.col("n_good") >= n_good, "enough").when(over, "timeout").otherwise("open")
    return out.crossJoin(F.broadcast(end)).select("session", "began", "ended", "n_fixes", "n_good", reason.alias("reason"))


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by time window, closed when events are too late."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
