"""Structured Streaming: deduplicated events, incremental feeds, windows, rate limits by keyed state, event texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Refill a second and burst by kind of request, and seconds after which an idle bucket is forgotten.
LIMITS = {"read": (1.0, 20.0), "write": (0.5, 10.0), "admin": (0.167, 3.0)}
IDLE_SECONDS = 3600


def deduplicated(events: DataFrame, keys: list[str], payload: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events whose payload the same keys haven't sent before; on a stream with a time column, within the lateness allowed."""
    own = events.withColumn("payload_hash", F.sha2(F.col(payload), 256))
    if events.isStreaming and time:
        return own.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, "payload_hash"])
    return own.dropDuplicates([*keys, "payload_hash"])


def due(connectors: DataFrame, now: Column, every_seconds: int = 3600) -> DataFrame:
    """Active connectors that were never synced, or not for so long."""
    last = F.col("last_synced_at")
    return connectors.where(F.coalesce("is_active", F.lit(True)) & (last.isNull() | (F.unix_seconds(now) - F.unix_seconds(last) >= every_seconds)))


def event_text(source: Column, kind: Column, payload: Column) -> Column:
    """What an event says, as text: issues, pull requests and pushes of a code host, others as they are."""
    at = lambda p: F.coalesce(F.get_json_object(payload, p), F.lit(""))
    return (
        F.when((source == "github") & (kind == "issues"), F.concat_ws("\n", F.concat(F.lit("Issue: "), at("$.issue.title")), at("$.issue.body")))
        .when((source == "github") & (kind == "pull_request"), F.concat_ws("\n", F.concat(F.lit("Pull request: "), at("$.pull_request.title")), at("$.pull_request.body")))
        .when((source == "github") & (kind == "push"), F.concat(F.lit("Push: "), at("$.head_commit.message")))
        .otherwise(payload)
    )


def retryable(events: DataFrame, most: int = 3, n: int = 50) -> DataFrame:
    """Failed events that may be tried again, oldest first."""
    return events.where((F.col("status") == "failed") & (F.col("attempts") < most)).orderBy("received_at", "event_id").limit(n)


def run_incremental(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give what is new since the last run to each(batch, number), exactly once for each number; the checkpoint keeps the cursor."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, size: str, by: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by windows of time, tumbling or sliding."""
    own = events.withWatermark(time, late) if late else events
    return own.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    own = events.withWatermark(time, late) if late else events
    return own.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def take(tokens: float | None, last: float | None, now: float, rate: float, burst: float) -> tuple[float, bool]:
    """A token bucket's tokens after a request at now, and whether it was allowed. A bucket that was idle too long is full again."""
    if tokens is None or last is None or now - last > IDLE_SECONDS:
        tokens, last = burst, now
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def rate_limited(events: DataFrame, key: str, time: str, rate: float, burst: float) -> DataFrame:
    """Each event of a table with allowed, by its key's bucket in order of time. A key's events are read in order by one task, batch by batch, not gathered."""
    own = events.withColumns({"_k": F.col(key).cast("string"), "_t": F.unix_micros(time) / 1e6})
    schema = own.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple[Any, float | None, float | None] = (None, None, None)
        for df in frames:
            allowed = []
            for k, t in zip(df["_k"], df["_t"], strict=True):
                who, tokens, last = at
                if k != who:
                    tokens = last = None
                tokens, ok = take(tokens, last, t, rate, burst)
                at = (k, tokens, t)
                allowed.append(ok)
            yield df.assign(allowed=allowed)

    dealt = own.repartition("_k").sortWithinPartitions("_k", "_t", *[c for c in events.columns if c not in (key, time)][:1])
    return dealt.mapInPandas(run, schema.add("allowed", "boolean")).drop("_k", "_t")


class TokenBucket(StatefulProcessor):
    """The same bucket on a stream: state is tokens and time of the last request, forgotten when idle."""

    def __init__(self, rate: float, burst: float) -> None:
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double", ttlDurationMs=IDLE_SECONDS * 1000)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        tokens, last = self.state.get() if self.state.exists() else (None, None)
        for df in rows:
            df = df.sort_values("t")
            allowed = []
            for t in df["t"]:
                tokens, ok = take(tokens, last, float(t), self.rate, self.burst)
                last = float(t)
                allowed.append(ok)
            yield pd.DataFrame({"key": [str(key[0])] * len(df), "t": df["t"].astype(float), "allowed": allowed})
        self.state.update((tokens, last))

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """events: key, t (seconds). Needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=TokenBucket(rate, burst), outputStructType="key string, t double, allowed boolean", outputMode="Append", timeMode="ProcessingTime")


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Of each key the latest row, as a feed's upserts are applied."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(time)))).where("_k = 1").drop("_k")
