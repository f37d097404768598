"""Operational tables: lookups, tasks, confirmations, limits, caches and traces (batch forms).

The batch forms define the truth that the streaming forms in ``sparkrag.streaming`` follow.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.tagging import first_case
from ..functions.text import estimate_tokens, strip
from .prefix import first_wins, prefix, time_bucket, top_n


def _lit_or_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- lookups -------------------------------------------------------------------------------------


def asset_type(col) -> Column:
    """Plural or singular asset type to its singular name, NULL when unknown."""
    t = F.lower(strip(F.coalesce(_lit_or_col(col), F.lit(""))))
    return first_case([(t == k, F.lit(v)) for k, v in V.ASSET_TYPES.items()],
                      F.lit(None).cast("string"))


def default_orchard(orchard: str | None, scope: list[str]) -> str | None:
    """The only orchard of a user is the default of a lookup."""
    return orchard or (scope[0] if len(scope) == 1 else None)


def lookup(df: DataFrame, params: dict[str, object | None], order: list[str],
           limit: int | None = V.LOOKUP_ROWS) -> DataFrame:
    """Rows that match every given parameter; a missing parameter does not filter.

    A tuple key ``("id", "orchard")`` matches either column.  At most 20 rows, in key order.
    """
    for name, value in params.items():
        if value is not None:
            names = name if isinstance(name, tuple) else (name,)
            hit = F.lit(False)
            for n in names:
                hit = hit | F.coalesce(F.col(n) == F.lit(value), F.lit(False))
            df = df.filter(hit)
    return df if limit is None else df.orderBy(*order).limit(limit)


def lookup_each(df: DataFrame, params: DataFrame, on: list[str], order: list[str],
                limit: int = V.LOOKUP_ROWS) -> DataFrame:
    """The same for a table of lookups ``(lookup_id, p_<column>...)`` with NULL = no filter.

    Lookups are grouped by which parameters they give.  Each group meets a table that is cut to
    ``limit`` rows per value combination first, so a value that holds most rows costs ``limit``.
    """
    out = None
    for n in range(len(on) + 1):
        for given in combinations(on, n):
            rest = [c for c in on if c not in given]
            asked = params
            for c in given:
                asked = asked.filter(F.col("p_" + c).isNotNull())
            for c in rest:
                asked = asked.filter(F.col("p_" + c).isNull())
            keys = [F.col(c).alias("__k" + str(i)) for i, c in enumerate(given)]
            asks = [F.col("p_" + c).alias("__k" + str(i)) for i, c in enumerate(given)]
            # Without parameters the constant key stands for the whole (already cut) table.
            keys, asks = keys or [F.lit(0).alias("__k0")], asks or [F.lit(0).alias("__k0")]
            names = ["__k" + str(i) for i in range(len(keys))]
            if given:
                cut = top_n(df.select("*", *keys), names, [F.asc(c) for c in order], limit,
                            "row_no")
            else:
                few = df.orderBy(*order).limit(limit).select("*", *keys)
                cut = top_n(few, names, [F.asc(c) for c in order], limit, "row_no")
            part = cut.join(asked.select("lookup_id", *asks), names).drop(*names)
            out = part if out is None else out.unionByName(part)
    return out


def clamp_days(days) -> Column:
    d = F.coalesce(F.nullif(_lit_or_col(days).try_cast("int"), F.lit(0)),
                   F.lit(V.FORECAST_DEFAULT_DAYS))
    return F.greatest(F.lit(1), F.least(d, F.lit(V.FORECAST_MAX_DAYS)))


def forecast(weather: DataFrame, requests: DataFrame, today) -> DataFrame:
    """Next days of weather per request; unknown locations get the default location's rows.

    ``weather``: location, date, rainfall_mm, temp_c_max, temp_c_min.  ``requests``: request_id,
    location, days.
    """
    start = _lit_or_col(today) if isinstance(today, Column) else F.lit(today).cast("date")
    known = weather.select(F.col("location").alias("__known")).distinct()
    r = (requests.withColumn("days", clamp_days("days"))
         .join(known, F.col("location") == F.col("__known"), "left")
         .withColumn("__loc", F.coalesce("__known", F.lit(V.FORECAST_DEFAULT_LOCATION)))
         .withColumn("date", F.explode(F.transform(
             F.sequence(F.lit(0), F.col("days") - 1), lambda i: F.date_add(start, i)))))
    w = weather.withColumnRenamed("location", "__loc")
    return r.join(w, ["__loc", "date"]).select(
        "request_id", "location", "date", "rainfall_mm", (F.col("rainfall_mm") > 0).alias("rain"),
        "temp_c_max", "temp_c_min")


def sensor_reading(readings: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest reading per (orchard, plot); a key without plot reads the orchard-level row."""
    value = [c for c in readings.columns if c not in ("orchard", "plot")]
    newest = (readings.groupBy("orchard", "plot")
              .agg(F.max_by(F.struct(*value), "updated").alias("r")))
    k = keys.select(F.col("orchard").alias("__o"), F.col("plot").alias("__p"),
                    *[c for c in keys.columns if c not in ("orchard", "plot")])
    hit = F.col("orchard").eqNullSafe(F.col("__o")) & F.col("plot").eqNullSafe(F.col("__p"))
    return newest.join(k, hit).drop("__o", "__p").select("*", "r.*").drop("r")


# --- tasks ---------------------------------------------------------------------------------------


def create_error() -> Column:
    title = strip(F.coalesce("title", F.lit("")))
    return (F.when(title == "", V.TASK_ERRORS["title"])
            .when(~F.coalesce("priority", F.lit("normal")).isin(*V.TASK_PRIORITIES),
                  V.TASK_ERRORS["priority"]))


def update_error() -> Column:
    filled = F.lit(False)
    for f in V.PATCH_FIELDS:
        filled = filled | (F.coalesce(F.col(f), F.lit("")) != "")
    return (F.when(strip(F.coalesce("task_id", F.lit(""))) == "", V.TASK_ERRORS["task_id"])
            .when(F.col("status").isNotNull() & ~F.col("status").isin(*V.TASK_STATUSES),
                  V.TASK_ERRORS["status"])
            .when(~filled, V.TASK_ERRORS["patch"]))


def validate_tasks(df: DataFrame, kind: str) -> DataFrame:
    """Add ``error`` (NULL when valid) for ``create`` or ``update`` requests."""
    return df.withColumn("error", create_error() if kind == "create" else update_error())


def idempotency_key() -> Column:
    own = F.nullif("idempotency_key", F.lit(""))
    return F.coalesce(own, F.concat_ws(":", "thread_id", strip(F.col("title"))))


def idempotent_create(requests: DataFrame, order: list[str], existing: DataFrame | None = None
                      ) -> DataFrame:
    """New tasks: the first request of every idempotency key that is not stored yet."""
    keyed = requests.withColumn("idempotency_key", idempotency_key())
    new = first_wins(keyed, ["idempotency_key"], order)
    if existing is not None:
        new = new.join(existing.select("idempotency_key"), "idempotency_key", "left_anti")
    return new.withColumn("status", F.lit("pending"))


def patch_upsert(tasks: DataFrame, patches: DataFrame, order: list[str],
                 fields: tuple[str, ...] = V.PATCH_FIELDS) -> DataFrame:
    """Apply patches: per task the last non-null value of every field wins."""
    at = F.struct(*order)
    last = patches.groupBy("task_id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias("__" + f) for f in fields])
    out = tasks.join(last, "task_id", "left")
    return out.withColumns({f: F.coalesce("__" + f, f) for f in fields}).select(*tasks.columns)


def newest_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert history to current rows: the newest row per key."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
            .select(*key, "__r.*").select(*df.columns))


def apply_confirmations(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of every decision: not_found, forbidden, cancelled or executed.

    ``pending``: confirmation_id, thread_id, tool, args.  ``decisions``: decision_id, ts,
    confirmation_id, thread_id, approved.  The first decision from the right thread consumes the
    operation; later ones find nothing.
    """
    p = pending.select("confirmation_id", F.col("thread_id").alias("__thread"), "tool", "args")
    d = decisions.join(p, "confirmation_id", "left").withColumn(
        "__mine", F.col("__thread").isNotNull() & (F.col("thread_id") == F.col("__thread")))
    used = (d.filter("__mine").groupBy("confirmation_id")
            .agg(F.min(F.struct("ts", "decision_id")).alias("__used")))
    d = d.join(used, "confirmation_id", "left")
    at = F.struct("ts", "decision_id")
    status = (F.when(F.col("__thread").isNull() | (at > F.col("__used")), "not_found")
              .when(~F.col("__mine"), "forbidden")
              .when(F.col("approved"), "executed").otherwise("cancelled"))
    return d.select("decision_id", "confirmation_id", status.alias("status"),
                    F.when(status == "executed", F.col("tool")).alias("tool"))


# --- limits and caches ---------------------------------------------------------------------------


def _quiet(df: DataFrame, key: list[str], ts: str, tie: str, seconds: float, bucket: int
           ) -> DataFrame:
    """Add ``call`` (running number per key) and ``fresh``: no row of the key within the window."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    out = prefix(df.withColumn("__us", us), key, [ts, tie], time_bucket(ts, bucket),
                 sums={"call": F.lit(1)}, prevs={"__prev": F.col("__us")})
    gap = F.col("__us") - F.col("__prev") >= F.lit(int(seconds * 1_000_000))
    return out.withColumn("fresh", F.coalesce(gap, F.lit(True)))


def rate_limit(df: DataFrame, limit: int, window_seconds: float, key: str = "key",
               ts: str = "ts", tie: str = "event_id", bucket: int = 86400) -> DataFrame:
    """Add ``call_no`` and ``allowed``.  Every call renews the window, so it counts calls since
    the last quiet period of at least ``window_seconds``."""
    q = _quiet(df, [key], ts, tie, window_seconds, bucket)
    q = prefix(q, [key], [ts, tie], time_bucket(ts, bucket),
               lasts={"__start": F.when(F.col("fresh"), F.col("call"))})
    n = F.col("call") - F.col("__start") + 1
    return q.withColumn("call_no", n).withColumn("allowed", n <= limit).select(
        *df.columns, "call_no", "allowed")


def ttl_first_value(df: DataFrame, ttl_seconds: float, value: str = "value", key: str = "key",
                    ts: str = "ts", tie: str = "event_id", bucket: int = 86400) -> DataFrame:
    """Add ``cached`` and ``hit``: the first value is reused until its deadline, then replaced.

    A gap of at least the TTL always starts afresh, so a key splits into independent stretches.
    Tasks fold sorted stretches batch by batch and hold one open deadline each.
    """
    q = _quiet(df, [key], ts, tie, ttl_seconds, bucket)
    q = prefix(q, [key], [ts, tie], time_bucket(ts, bucket),
               sums={"__part": F.col("fresh").cast("int")})
    schema = T.StructType([*df.schema.fields,
                           T.StructField("cached", df.schema[value].dataType),
                           T.StructField("hit", T.BooleanType())])
    names, ttl = df.columns, int(ttl_seconds * 1_000_000)

    def fold(batches):
        stretch, deadline, kept = None, 0, None
        for pdf in batches:
            us = pdf["__us"].to_numpy()
            vals = pdf[value].to_numpy()
            owner = (pdf[key].astype(str) + "\0" + pdf["__part"].astype(str)).to_numpy()
            cached = np.empty(len(pdf), dtype=vals.dtype if vals.dtype != object else object)
            hit = np.ones(len(pdf), dtype=bool)
            cuts = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) + 1
            ends = cuts[np.searchsorted(cuts, np.arange(len(pdf)), side="right")]
            i = 0
            while i < len(pdf):
                if owner[i] != stretch or us[i] >= deadline:
                    stretch, deadline, kept = owner[i], us[i] + ttl, vals[i]
                    hit[i] = False
                # Rows of a stretch are sorted, so everything before the deadline is one slice.
                end = int(ends[i])
                stop = i + max(1, int(np.searchsorted(us[i:end], deadline)))
                cached[i:stop] = kept
                i = stop
            out = pdf[names].copy()
            out["cached"], out["hit"] = cached, hit
            yield out

    order = [key, "__part", "__us", tie]
    return (q.repartition(key, "__part").sortWithinPartitions(*order)
            .select(*names, "__us", "__part").mapInPandas(fold, schema))


def window_counts(df: DataFrame, ts: str = "ts", kind: str = "event_type",
                  width: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and type."""
    return (df.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), kind, "n"))


# --- audit and trace -----------------------------------------------------------------------------


def audit_trail(df: DataFrame, thread_id) -> DataFrame:
    """Audit rows of one thread in insertion order."""
    return df.filter(F.col("thread_id") == thread_id).orderBy("audit_id")


def newest(df: DataFrame, keep: int = V.TRACE_KEEP, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(keep)


def trace_records(requests: DataFrame, calls: DataFrame, docs: DataFrame, ranked: DataFrame
                  ) -> DataFrame:
    """One trace row per request.

    ``requests``: trace_id, thread_id, user_id, tenant_id, route, intent, latency_ms, query,
    summary, answer, evidence_sufficient, compressions, retries, last_error.  ``calls``: trace_id,
    step, tool_name.  ``docs``: trace_id, source_route.  ``ranked``: trace_id, pos, chunk_id,
    text, rrf_rank, rerank_score.
    """
    tools = calls.filter(F.coalesce("tool_name", F.lit("")) != "").groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "tool_name")))["tool_name"].alias("tools"))
    sources = docs.filter(F.coalesce("source_route", F.lit("")) != "").groupBy("trace_id").agg(
        F.array_sort(F.collect_set("source_route")).alias("sources"))
    best = top_n(ranked.select("trace_id", "pos", "chunk_id", "rrf_rank", "rerank_score"),
                 ["trace_id"], [F.asc("pos")], V.TRACE_DOCS, "__n")
    item = F.struct("pos", F.col("chunk_id").cast("string").alias("id"),
                    F.coalesce("rrf_rank", F.lit(0)).cast("int").alias("rank"),
                    F.round("rerank_score", 3).alias("score"))
    maps = best.groupBy("trace_id").agg(F.array_sort(F.collect_list(item)).alias("d")).select(
        "trace_id",
        F.map_from_entries(F.transform("d", lambda x: F.struct(x["id"], x["rank"]))).alias("rr"),
        F.map_from_entries(F.transform(F.filter("d", lambda x: x["score"].isNotNull()),
                                       lambda x: F.struct(x["id"], x["score"]))).alias("rs"))
    # The texts are counted, not collected: wide and other characters add up over documents.
    wide = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(V.TOKEN_CLASS))
    sizes = ranked.groupBy("trace_id").agg(
        F.count("*").alias("n_docs"), F.sum(wide).alias("wide"),
        F.sum(F.length(F.coalesce("text", F.lit(""))) - wide).alias("other"))
    own = F.concat(F.coalesce("query", F.lit("")), F.coalesce("summary", F.lit("")))
    own_wide = F.regexp_count(own, F.lit(V.TOKEN_CLASS))
    n = F.coalesce("n_docs", F.lit(0))
    other = (F.coalesce("other", F.lit(0)) + F.length(own) - own_wide
             + F.greatest(n - 1, F.lit(0)))
    token_in = F.coalesce("wide", F.lit(0)) + own_wide + F.floor((other + 3) / 4)
    r = (requests.join(tools, "trace_id", "left").join(sources, "trace_id", "left")
         .join(maps, "trace_id", "left").join(sizes, "trace_id", "left"))
    none = F.array().cast("array<string>")
    enough = F.coalesce("evidence_sufficient", F.lit(False))
    return r.select(
        "trace_id", "thread_id", "user_id", "tenant_id", "route", "intent",
        F.coalesce("tools", none).alias("tool_sequence"),
        F.round("latency_ms", 1).alias("retrieval_latency_ms"),
        F.coalesce("sources", none).alias("retrieval_sources"),
        F.coalesce("rr", F.create_map().cast("map<string,int>")).alias("rrf_ranks"),
        F.coalesce("rs", F.create_map().cast("map<string,double>")).alias("reranker_scores"),
        F.when(enough, "sufficient").when(n > 0, "insufficient").otherwise("no_result")
        .alias("evidence_decision"),
        token_in.cast("int").alias("token_input"), estimate_tokens("answer").alias("token_output"),
        F.coalesce("compressions", F.lit(0)).alias("memory_compressions"),
        F.coalesce("retries", F.lit(0)).alias("fallback_count"),
        ((F.coalesce("answer", F.lit("")) != "") & (F.coalesce("last_error", F.lit("")) == ""))
        .alias("final_success"), F.coalesce("last_error", F.lit("")).alias("last_error"))


def tool_sequences(messages: DataFrame) -> DataFrame:
    """``trace_id, step, tool_name`` of the tool calls that the assistant's messages hold as JSON:
    for traces without call records.  ``messages``: trace_id, turn, role, text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    call = F.when(F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull(), text)
    tool = F.get_json_object(call, "$.action.tool")
    return (messages.filter("role = 'assistant'")
            .select("trace_id", F.col("turn").alias("step"), tool.alias("tool_name"))
            .filter("tool_name <> ''"))


def with_logged_tools(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Call records ``trace_id, step, tool_name``, and the logged ones of traces that have none."""
    logged = tool_sequences(messages).join(
        calls.filter("tool_name <> ''").select("trace_id").distinct(), "trace_id", "left_anti")
    return calls.select("trace_id", "step", "tool_name").unionByName(logged)
