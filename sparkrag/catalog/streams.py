"""Streaming jobs run to completion over the driver tables; the SQL is that of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.stage import shared_dir
from ..streaming import jobs as J
from ..streaming import stateful as S
from . import operations as B
from .base import query, table
from .dialog import N, THRESHOLD, _CUT, summary_sql


def _places(spark, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    return base + "/out", base + "/checkpoint"


def _stream(spark, sf_dir, name):
    return J.read_stream(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema)


@query("stream_window_counts", "SELECT c.* FROM (" + B.COUNTS + ") c, (SELECT max(ts) AS top FROM events) m"
       " WHERE window_start + INTERVAL '1 hour' <= top - INTERVAL '1 hour'")
def stream_window_counts(spark, sf_dir):
    """The windows that the watermark has closed; open ones are not part of an append feed."""
    out, ck = _places(spark, "windows")
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    J.append(J.window_counts(events), out, ck)
    return spark.read.schema("window_start timestamp, event_type string, n long").parquet(out)


@query("stream_idempotent_create", B.QUERY_IDEMPOTENT)
def stream_idempotent_create(spark, sf_dir):
    out, ck = _places(spark, "create")
    e = _stream(spark, sf_dir, "events")
    J.create_tasks(B.request_rows(e), out, ["ts", "event_id"], ck)
    tasks = spark.read.schema("idempotency_key string, event_id long, status string").parquet(out)
    return tasks.select("idempotency_key", "event_id", "status")


@query("stream_dedup_requests", f"WITH {B.REQ} SELECT k AS idempotency_key FROM rq GROUP BY k")
def stream_dedup_requests(spark, sf_dir):
    out, ck = _places(spark, "dedup")
    e = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    J.append(J.dedup_requests(B.request_rows(e), "400 days").select("idempotency_key"), out, ck)
    return spark.read.schema("idempotency_key string").parquet(out)


@query("stream_patch_upsert", "WITH " + B.PATCHED)
def stream_patch_upsert(spark, sf_dir):
    out, ck = _places(spark, "patch")
    J.log_patches(B.patch_rows(_stream(spark, sf_dir, "events")), out, ["ts", "event_id"], ck)
    return J.current_tasks(B.tasks(spark, sf_dir), spark.read.parquet(out))


@query("stream_newest_wins", B.QUERY_NEWEST)
def stream_newest_wins(spark, sf_dir):
    out, ck = _places(spark, "newest")
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    J.log_newest(rows, out, ["user_id"], ["ts", "event_id"], ck)
    from ..operators.ops import newest_wins
    return newest_wins(spark.read.parquet(out).drop("batch_no"), ["user_id"],
                       ["ts", "event_id"]).drop("ts")


@query("stream_rate_limit", "WITH " + B.CALLS)
def stream_rate_limit(spark, sf_dir):
    out, ck = _places(spark, "rate")
    e = _stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    J.append(S.rate_limit(e, B.LIMIT, B.WINDOW, key="user_id"), out, ck)
    return spark.read.schema("event_id long, call_no long, allowed boolean").parquet(out)


@query("stream_ttl_first_value", "WITH RECURSIVE " + B.FOLD)
def stream_ttl_first_value(spark, sf_dir):
    out, ck = _places(spark, "ttl")
    e = _stream(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    J.append(S.ttl_first_value(e, B.TTL, key="user_id"), out, ck)
    return spark.read.schema("event_id long, cached double, hit boolean").parquet(out)


@query("stream_conversations", f"""WITH {_CUT}, {summary_sql("s", "o")}, k AS (SELECT conv_id,
  count(*) FILTER (WHERE recency > {N} AND chars >= {THRESHOLD}) AS trimmed, count(*) AS total
  FROM r GROUP BY conv_id)
SELECT conv_id, total - trimmed AS kept, trimmed, coalesce(summary, '') AS summary
FROM k LEFT JOIN s USING (conv_id)""".replace("CASE WHEN c.role = 'user' AND c.conv_id % 5 = 0 "
                                              "THEN ' OK ' WHEN c.role = 'assistant'\n  AND c.turn"
                                              " = 5 THEN coalesce(f.text, c.text) ELSE c.text END",
                                              "c.text"))
def stream_conversations(spark, sf_dir):
    out, ck = _places(spark, "conv")
    c = _stream(spark, sf_dir, "conversations").withColumn("role", F.when(
        F.col("role") == "system", "tool").otherwise(F.col("role")))
    J.append(S.rolling_conversations(c, N, THRESHOLD), out, ck, empty_batches=False)
    rows = spark.read.schema("conv_id long, last_turn long, kept long, trimmed long, "
                             "summary string").parquet(out)
    return rows.select("conv_id", "kept", "trimmed", "summary")
