"""Custom keyed state: rate limits, first-value caches, rolling conversations.

Each processor keeps a few values per key.  A timer clears the state of a key once the watermark
has passed the point after which the state can no longer matter.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import fixed_values as V
from ..operators.dialog import summary_line

# Spark also loads the processors in a driver-side worker that does not see shipped packages, so
# they travel by value.
for _module in (sys.modules[__name__], V):
    cloudpickle.register_pickle_by_value(_module)


def _sorted(rows, order: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in event order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class _Expiring(StatefulProcessor):
    """One tuple of state per key that becomes useless at an event time."""

    fields: str

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def expire_at(self, us: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class RateLimiter(_Expiring):
    """Calls since the last quiet period of at least ``window`` microseconds.

    A call that comes late counts in the running period and never moves its end back.
    """

    fields = "last_us long, calls long"

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["us", "event_id"])
        last, calls = self.state.get() if self.state.exists() else (None, 0)
        numbers = []
        for us in pdf["us"]:
            calls = calls + 1 if last is not None and us - last < self.window else 1
            last = us if last is None else max(last, us)
            numbers.append(calls)
        self.state.update((int(last), int(calls)))
        self.expire_at(int(last) + self.window)
        yield pd.DataFrame({"event_id": pdf["event_id"], "call_no": numbers,
                            "allowed": [n <= self.limit for n in numbers]})


class FirstValueCache(_Expiring):
    """The first value stays until its deadline; the deadline is not renewed.

    A row that comes late, from before the cached value, gets the value that is cached when it is
    processed: what was handed out is never changed, and the deadline stays.
    """

    fields = "deadline long, value double"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["us", "event_id"])
        deadline, kept = self.state.get() if self.state.exists() else (None, None)
        cached, hits = [], []
        for us, value in zip(pdf["us"], pdf["value"]):
            hit = deadline is not None and us < deadline
            if not hit:
                deadline, kept = int(us) + self.ttl, float(value)
            cached.append(kept)
            hits.append(hit)
        self.state.update((int(deadline), float(kept)))
        self.expire_at(int(deadline))
        yield pd.DataFrame({"event_id": pdf["event_id"], "cached": cached, "hit": hits})


class RollingConversation(StatefulProcessor):
    """Recent messages and summary of every conversation, emitted after each micro-batch.

    The state is bounded: at most ``n`` recent messages once the threshold is passed, below it at
    most ``threshold`` characters, and a summary of at most 6000 characters.  It goes after ``idle``
    milliseconds without a message.
    """

    def __init__(self, n: int, threshold: int, idle: int):
        self.n, self.threshold, self.idle = n, threshold, idle

    def init(self, handle) -> None:
        self.recent = handle.getListState(
            "recent", "turn long, chars long, line string, key string", self.idle)
        self.summary = handle.getValueState("summary", "text string", self.idle)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["turn"])
        msgs = [tuple(m) for m in self.recent.get()] if self.recent.exists() else []
        msgs += zip(pdf["turn"].tolist(), pdf["chars"].tolist(), pdf["line"].tolist(),
                    pdf["key"].tolist())
        summary = self.summary.get()[0] if self.summary.exists() else ""
        trimmed = 0
        if sum(m[1] for m in msgs) >= self.threshold and len(msgs) > self.n:
            trimmed = len(msgs) - self.n
            summary = merge_summary(summary, [m[2:] for m in msgs[:trimmed]])
            msgs = msgs[trimmed:]
        self.recent.put([(int(a), int(b), c, d) for a, b, c, d in msgs])
        self.summary.update((summary,))
        yield pd.DataFrame({"conv_id": [key[0]], "last_turn": [int(msgs[-1][0])],
                            "kept": [len(msgs)], "trimmed": [trimmed], "summary": [summary]})

    def close(self) -> None:
        pass


def merge_summary(previous: str, lines) -> str:
    """The previous summary and the ``(line, key)`` pairs behind it; a key counts once."""
    fresh: dict = {}
    for i, (line, key) in enumerate(lines):
        if line:
            fresh.setdefault(key or i, line)
    body = [previous] if previous else []
    return "\n".join([*body, *fresh.values()])[:V.SUMMARY_CHARS]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state_store(df: DataFrame) -> DataFrame:
    """Custom state needs the RocksDB store; it is a session setting, so set it where it is not."""
    if df.sparkSession.conf.get(_PROVIDER, "") != _ROCKSDB:
        df.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return df


def _timed(events: DataFrame, key: str, watermark: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return (_with_state_store(events).select(F.col(key).alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"),
                          "event_id", *(["value"] if "value" in events.columns else []))
            .withWatermark("ts", watermark).groupBy("key"))


def rate_limit(events: DataFrame, limit: int, window_seconds: float, key: str = "key",
               watermark: str = "1 hour") -> DataFrame:
    """``(event_id, call_no, allowed)`` for a stream with key, ts and event_id."""
    out = T.StructType([T.StructField("event_id", T.LongType()),
                        T.StructField("call_no", T.LongType()),
                        T.StructField("allowed", T.BooleanType())])
    return _timed(events, key, watermark).transformWithStateInPandas(
        RateLimiter(limit, int(window_seconds * 1_000_000)), out, "Append", "EventTime")


def ttl_first_value(events: DataFrame, ttl_seconds: float, key: str = "key",
                    watermark: str = "1 hour") -> DataFrame:
    """``(event_id, cached, hit)`` for a stream with key, ts, event_id and value."""
    out = T.StructType([T.StructField("event_id", T.LongType()),
                        T.StructField("cached", T.DoubleType()),
                        T.StructField("hit", T.BooleanType())])
    return _timed(events, key, watermark).transformWithStateInPandas(
        FirstValueCache(int(ttl_seconds * 1_000_000)), out, "Append", "EventTime")


def rolling_conversations(messages: DataFrame, n: int = V.RECENT_MESSAGES,
                          threshold: int = V.SUMMARY_CHARS, idle_seconds: float = 30 * 86400
                          ) -> DataFrame:
    """State of every touched conversation after each micro-batch."""
    out = T.StructType([T.StructField("conv_id", T.LongType()),
                        T.StructField("last_turn", T.LongType()),
                        T.StructField("kept", T.LongType()),
                        T.StructField("trimmed", T.LongType()),
                        T.StructField("summary", T.StringType())])
    lines = messages.select(
        "conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
        summary_line(F.col("role"), F.col("text")).alias("s")).select(
        "conv_id", "turn", "chars", "s.line", "s.key")
    return _with_state_store(lines).groupBy("conv_id").transformWithStateInPandas(
        RollingConversation(n, threshold, int(idle_seconds * 1000)), out, "Append",
        "ProcessingTime")
