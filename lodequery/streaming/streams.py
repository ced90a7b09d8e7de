"""Structured Streaming over event logs: deduplication, windows and rate limits with state that expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SKEW = "5 minutes"


def as_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; times without one are read as UTC."""
    return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()) if dict(df.dtypes)[column] == "timestamp_ntz" else F.col(column))


def first_of_nonce(df: DataFrame, keys: list[str], ts: str = "ts", skew: str = SKEW) -> DataFrame:
    """The first message of each (sender, nonce) within the skew; the state of older ones is dropped."""
    return df.withWatermark(ts, skew).dropDuplicatesWithinWatermark(keys)


def redeem_once(uses: DataFrame, tokens: DataFrame, ts: str = "ts", late: str = SKEW) -> DataFrame:
    """Uses ``token, digest, ts`` of stored tokens (``token, digest, expires_at``, a table) that hold: of the same digest, not
    expired, and the first of their token. The state of a token goes once it can't be used any more: when the watermark
    has passed the lateness after its first use, by which all later uses are of no effect if tokens live no longer."""
    held = tokens.select("token", F.col("digest").alias("_approved"), "expires_at")
    good = uses.withWatermark(ts, late).join(held, "token").where((F.col("digest") == F.col("_approved")) & (F.col(ts) <= F.col("expires_at")))
    return good.drop("_approved", "expires_at").dropDuplicatesWithinWatermark(["token"])


def subscribe(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Calls ``handler(rows, batch)`` for each batch of a stream, at least once each; runs until stopped, or, without
    ``every`` (as "10 seconds"), until what there is has been read. Returns the running query."""
    writer = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def within_skew(df: DataFrame, now, ts: str = "ts", seconds: int = 300) -> DataFrame:
    return df.where(F.abs(F.unix_seconds(F.col(ts)) - F.unix_seconds(F.lit(now).cast("timestamp"))) <= seconds)


def tumbling_counts(df: DataFrame, width: str, by: list[str], ts: str = "ts", late: str = SKEW) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *by, "n")


def sliding_counts(df: DataFrame, width: str, slide: str, by: list[str], ts: str = "ts", late: str = SKEW) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *by, "n")


def session_counts(df: DataFrame, gap: str, by: list[str], ts: str = "ts", late: str = SKEW) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def rate_limited(df: DataFrame, key: str, limit: int, window_ms: int = 60_000, ts: str = "ts", event_id: str = "event_id", late: str = SKEW) -> DataFrame:
    """``key, event_id, ts, admitted``: at most ``limit`` admitted calls of a key within any window before a call.

    The state of a key is the times of its admitted calls within the window, at most ``limit``; it goes when the
    watermark has passed the window. Calls of a batch are taken in order of time, then id.
    """
    kind = dict(df.dtypes)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (times,) = state.get if state.exists else ([],)
        rows = pd.concat(list(parts)).sort_values(["at", event_id])  # one key's rows of one batch
        times, out = list(times), []
        for at in rows["at"]:
            times = [t for t in times if at - t < window_ms]
            out.append(len(times) < limit)
            if out[-1]:
                times.append(int(at))
        state.update((times,))
        state.setTimeoutTimestamp(max(int(rows["at"].max()), state.getCurrentWatermarkMs()) + window_ms + 1)
        yield rows.assign(admitted=out)[[key, event_id, ts, "admitted"]]

    rows = df.withWatermark(ts, late).select(key, event_id, ts, F.unix_millis(ts).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind[key]}, `{event_id}` {kind[event_id]}, `{ts}` timestamp, admitted boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
