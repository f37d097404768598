"""Tasks, lookups, confirmations, limits and caches over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import ops as O
from .base import query, quote, table


def request_rows(events):
    """Events as create requests; clicks carry a key, the rest fall back to thread and title."""
    i, u = F.col("event_id"), F.col("user_id")
    return events.select(
        "event_id", "ts", F.concat(F.lit("t"), u.cast("string")).alias("thread_id"),
        F.concat(F.lit(" "), F.col("event_type")).alias("title"),
        F.when(i % 7 == 0, "urgent").when(i % 7 == 1, "high").alias("priority"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("k"), (i % 50).cast("string")))
        .alias("idempotency_key"))


def requests(spark, sf_dir):
    return request_rows(table(spark, sf_dir, "events"))


REQ = """rq AS (SELECT event_id, ts, CASE WHEN event_type = 'click' THEN 'k' || (event_id % 50)
  ELSE 't' || user_id || ':' || event_type END AS k FROM events)"""


QUERY_IDEMPOTENT = f"""WITH {REQ} SELECT k AS idempotency_key, arg_min(event_id,
  (ts, event_id)) AS event_id, 'pending' AS status FROM rq GROUP BY k"""


@query("idempotent_create", QUERY_IDEMPOTENT)
def idempotent_create(spark, sf_dir):
    return O.idempotent_create(requests(spark, sf_dir), ["ts", "event_id"]).select(
        "idempotency_key", "event_id", "status")


@query("create_against_stored", f"""WITH {REQ} SELECT k AS idempotency_key, min(event_id) AS event_id
FROM rq WHERE k NOT IN (SELECT 'k' || (p_partkey % 25) FROM part) GROUP BY k""")
def create_against_stored(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(F.concat(
        F.lit("k"), (F.col("p_partkey") % 25).cast("string")).alias("idempotency_key"))
    return O.idempotent_create(requests(spark, sf_dir), ["event_id"], stored).select(
        "idempotency_key", "event_id")


def tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"),
                    F.lit("").alias("assignee"), F.col("o_orderpriority").alias("title"),
                    F.lit(None).cast("string").alias("description"))


def patch_rows(events):
    i = F.col("event_id")
    return events.select(
        "event_id", "ts", (i * 7 % 3000).alias("task_id"),
        F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error",
                                                           "cancelled").alias("status"),
        F.when(i % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .alias("assignee"), F.lit(None).cast("string").alias("title"),
        F.when(i % 5 == 0, F.col("props")).alias("description"))


def patches(spark, sf_dir):
    return patch_rows(table(spark, sf_dir, "events"))


PATCHED = """p AS (SELECT event_id, event_id * 7 % 3000 AS task_id, (ts, event_id) AS o,
  CASE event_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'cancelled' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'u' || user_id END AS assignee,
  CASE WHEN event_id % 5 = 0 THEN props END AS description FROM events),
l AS (SELECT task_id, arg_max(status, o) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(assignee, o) FILTER (WHERE assignee IS NOT NULL) AS assignee,
  arg_max(description, o) FILTER (WHERE description IS NOT NULL) AS description
  FROM p GROUP BY task_id)
SELECT o_orderkey AS task_id, coalesce(l.status, o_orderstatus) AS status,
  coalesce(l.assignee, '') AS assignee, o_orderpriority AS title, l.description AS description
FROM orders LEFT JOIN l ON l.task_id = o_orderkey"""


@query("patch_upsert", "WITH " + PATCHED)
def patch_upsert(spark, sf_dir):
    return O.patch_upsert(tasks(spark, sf_dir), patches(spark, sf_dir), ["ts", "event_id"])




QUERY_NEWEST = """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"""


@query("newest_wins", QUERY_NEWEST)
def newest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return O.newest_wins(e, ["user_id"], ["ts", "event_id"]).drop("ts")


LIMIT, WINDOW = 3, 3600
CALLS = f"""s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) < {WINDOW * 1000000} THEN 0 ELSE 1 END AS fresh FROM events),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM s),
n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id)
  AS call_no FROM c) SELECT event_id, call_no, call_no <= {LIMIT} AS allowed FROM n"""


@query("rate_limit", "WITH " + CALLS)
def rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return O.rate_limit(e, LIMIT, WINDOW, key="user_id").select("event_id", "call_no", "allowed")


TTL = 21600
FOLD = f"""o AS (SELECT event_id, user_id, epoch_us(ts) AS us, value, row_number() OVER (
    PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, us, rn, value AS cached, us + {TTL * 1000000} AS deadline,
    false AS hit FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.user_id, o.us, o.rn, CASE WHEN o.us >= f.deadline THEN o.value
    ELSE f.cached END, CASE WHEN o.us >= f.deadline THEN o.us + {TTL * 1000000} ELSE f.deadline
    END, o.us < f.deadline FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT event_id, cached, hit FROM f"""


@query("ttl_first_value", "WITH RECURSIVE " + FOLD)
def ttl_first_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return O.ttl_first_value(e, TTL, key="user_id").select("event_id", "cached", "hit")


COUNTS = """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n
FROM events GROUP BY 1, 2"""


@query("window_counts", COUNTS)
def window_counts(spark, sf_dir):
    return O.window_counts(table(spark, sf_dir, "events"))


@query("lookup_assets", """SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#2'
ORDER BY p_partkey LIMIT 20""")
def lookup_assets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return O.lookup(p, {"p_brand": "Brand#2", "p_size": None}, ["p_partkey"]).select(
        "p_partkey", "p_brand", "p_size")


@query("lookup_limit", """WITH q AS (SELECT s_suppkey AS lookup_id, CASE WHEN s_suppkey % 3 > 0
  THEN list_extract(['F', 'O', 'P'], CAST(s_suppkey % 3 AS INTEGER) + 1) END AS st, CASE WHEN
  s_suppkey % 2 = 0 THEN list_extract(['1-URGENT', '5-LOW'], CAST(s_suppkey // 2 % 2 AS INTEGER)
  + 1) END AS pr FROM supplier)
SELECT lookup_id, o_orderkey, CAST(row_no AS INTEGER) AS row_no FROM (SELECT lookup_id, o_orderkey,
  row_number() OVER (PARTITION BY lookup_id ORDER BY o_orderkey) AS row_no FROM q JOIN orders
  ON (st IS NULL OR o_orderstatus = st) AND (pr IS NULL OR o_orderpriority = pr))
WHERE row_no <= 20""")
def lookup_limit(spark, sf_dir):
    k = F.col("s_suppkey")
    status = F.get(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (k % 3).cast("int"))
    prio = F.get(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), (F.floor(k / 2) % 2).cast("int"))
    params = table(spark, sf_dir, "supplier").select(
        k.alias("lookup_id"), F.when(k % 3 > 0, status).alias("p_o_orderstatus"),
        F.when(k % 2 == 0, prio).alias("p_o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return O.lookup_each(o, params, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]).select(
        "lookup_id", "o_orderkey", "row_no")


@query("forecast", """WITH d AS (SELECT 'L' || (o_custkey % 20) AS location,
  CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderkey FROM orders),
w AS (SELECT location, date, round(max(o_totalprice) / 1000, 2) AS rainfall_mm FROM d
  GROUP BY location, date
  UNION ALL SELECT 'DEFAULT', date, 0.0 FROM d GROUP BY date),
r AS (SELECT c_custkey AS request_id, 'L' || (c_custkey % 25) AS location,
  greatest(1, least(CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE c_custkey % 10 END, 7)) AS days
  FROM customer),
x AS (SELECT *, CASE WHEN location IN (SELECT location FROM w) THEN location ELSE 'DEFAULT' END AS loc
  FROM r)
SELECT request_id, x.location, w.date, rainfall_mm, rainfall_mm > 0 AS rain FROM x JOIN w
  ON w.location = x.loc AND w.date >= DATE '1997-03-01' AND w.date < DATE '1997-03-01' + days::INT""")
def forecast(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), (F.col("o_custkey") % 20).cast("string")).alias("location"),
        F.to_date("o_orderdate").alias("date"), "o_totalprice")
    w = d.groupBy("location", "date").agg(F.round(F.max("o_totalprice") / 1000, 2)
                                          .alias("rainfall_mm"))
    w = w.unionByName(d.select("date").distinct().select(
        F.lit("DEFAULT").alias("location"), "date", F.lit(0.0).alias("rainfall_mm")))
    w = w.withColumns({"temp_c_max": F.lit(32), "temp_c_min": F.lit(24)})
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.concat(F.lit("L"), (k % 25).cast("string")).alias("location"),
        (k % 10).cast("string").alias("days"))
    return O.forecast(w, r, "1997-03-01").select("request_id", "location", "date", "rainfall_mm",
                                                 "rain")


@query("sensor_readings", """WITH s AS (SELECT 'O' || (user_id % 30) AS orchard, CASE WHEN user_id
  % 4 > 0 THEN 'P' || (user_id % 4) END AS plot, value, ts, event_id FROM events),
n AS (SELECT orchard, plot, arg_max(value, (ts, event_id)) AS value FROM s GROUP BY orchard, plot),
k AS (SELECT s_suppkey AS key_id, 'O' || (s_suppkey % 35) AS orchard, CASE WHEN s_suppkey % 3 > 0
  THEN 'P' || (s_suppkey % 3) END AS plot FROM supplier)
SELECT key_id, n.orchard, n.plot, value FROM k JOIN n ON n.orchard = k.orchard
  AND n.plot IS NOT DISTINCT FROM k.plot""")
def sensor_readings(spark, sf_dir):
    u, k = F.col("user_id"), F.col("s_suppkey")
    r = table(spark, sf_dir, "events").select(
        F.concat(F.lit("O"), (u % 30).cast("string")).alias("orchard"),
        F.when(u % 4 > 0, F.concat(F.lit("P"), (u % 4).cast("string"))).alias("plot"), "value",
        F.struct("ts", "event_id").alias("updated"))
    keys = table(spark, sf_dir, "supplier").select(
        k.alias("key_id"), F.concat(F.lit("O"), (k % 35).cast("string")).alias("orchard"),
        F.when(k % 3 > 0, F.concat(F.lit("P"), (k % 3).cast("string"))).alias("plot"))
    return O.sensor_reading(r, keys).select("key_id", "orchard", "plot", "value")


@query("asset_types", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'orchard' WHEN 1 THEN 'plot'
  WHEN 2 THEN 'device' WHEN 3 THEN 'worker' END AS asset_type FROM part""")
def asset_types(spark, sf_dir):
    names = F.array(*map(F.lit, ["Orchards", " plots ", "device", "WORKERS", "tree"]))
    return table(spark, sf_dir, "part").select("p_partkey", O.asset_type(
        F.get(names, (F.col("p_size") % 5).cast("int"))).alias("asset_type"))


@query("task_validation", f"""SELECT event_id, CASE WHEN event_type = 'view' THEN
  {quote(V.TASK_ERRORS['title'])} WHEN event_id % 7 = 0 THEN {quote(V.TASK_ERRORS['priority'])}
  END AS create_error, CASE WHEN event_id % 11 = 0 THEN {quote(V.TASK_ERRORS['task_id'])}
  WHEN event_type = 'signup' THEN {quote(V.TASK_ERRORS['status'])}
  WHEN event_type NOT IN ('view', 'error') AND event_id % 3 > 0
    AND event_id % 5 > 0 THEN {quote(V.TASK_ERRORS['patch'])} END AS update_error FROM events""")
def task_validation(spark, sf_dir):
    i = F.col("event_id")
    c = O.validate_tasks(requests(spark, sf_dir).withColumn("title", F.when(
        F.trim("title") != "view", F.col("title"))), "create")
    p = patches(spark, sf_dir).join(table(spark, sf_dir, "events").select(
        "event_id", "event_type"), "event_id")
    p = p.withColumns({"task_id": F.when(i % 11 > 0, F.col("task_id").cast("string")),
                       "status": F.when(F.col("event_type") == "signup", "open")
                       .otherwise(F.col("status"))})
    u = O.validate_tasks(p, "update")
    return c.select("event_id", F.col("error").alias("create_error")).join(
        u.select("event_id", F.col("error").alias("update_error")), "event_id")


@query("confirmations", """WITH pd AS (SELECT o_orderkey AS confirmation_id, 't' || (o_orderkey % 5)
  AS thread FROM orders),
d AS (SELECT event_id, ts, event_id * 13 % 4000 AS cid, 't' || (user_id % 5) AS thread,
  event_type <> 'error' AS approved FROM events),
j AS (SELECT d.*, pd.thread AS owner FROM d LEFT JOIN pd ON pd.confirmation_id = d.cid),
u AS (SELECT *, min(CASE WHEN owner = thread THEN (ts, event_id) END) OVER (PARTITION BY cid)
  AS used FROM j)
SELECT event_id AS decision_id, cid AS confirmation_id, CASE WHEN owner IS NULL
  OR (ts, event_id) > used THEN 'not_found' WHEN owner <> thread THEN 'forbidden'
  WHEN approved THEN 'executed' ELSE 'cancelled' END AS status FROM u""")
def confirmations(spark, sf_dir):
    o = F.col("o_orderkey")
    pending = table(spark, sf_dir, "orders").select(
        o.alias("confirmation_id"), F.concat(F.lit("t"), (o % 5).cast("string"))
        .alias("thread_id"), F.lit("task_create").alias("tool"), F.lit("{}").alias("args"))
    decisions = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("decision_id"), "ts",
        (F.col("event_id") * 13 % 4000).alias("confirmation_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("thread_id"),
        (F.col("event_type") != "error").alias("approved"))
    return O.apply_confirmations(pending, decisions).select("decision_id", "confirmation_id",
                                                            "status")


@query("audit_trail", """SELECT event_id AS audit_id, event_type AS tool_name FROM events
WHERE user_id = 7""")
def audit_trail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("audit_id"), F.col("user_id").alias("thread_id"),
        F.col("event_type").alias("tool_name"))
    return O.audit_trail(e, 7).select("audit_id", "tool_name")


@query("user_scopes", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'default' AS tenant_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'manager' ELSE 'worker' END AS role,
  CASE WHEN c_custkey % 3 = 0 THEN 'ORCHARD_1' WHEN c_custkey % 3 = 1 THEN 'ORCHARD_2' ELSE 'ALL' END
  AS orchards FROM customer""")
def user_scopes(spark, sf_dir):
    from ..functions.tagging import normalize_scope
    from ..operators.permissions import user_scope
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    u = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("user_id"), F.lit(None).cast("string").alias("tenant_id"),
        F.when(k % 2 == 0, "manager").alias("role"),
        F.when(k % 3 == 0, F.array(F.lit("ORCHARD_1"))).otherwise(none)
        .alias("user_orchard_scope"),
        F.when(k % 3 == 2, F.array(F.lit(""))).otherwise(F.array(F.lit("ORCHARD_2")))
        .alias("orchard_scope"))
    return user_scope(u).select("user_id", "tenant_id", "role", F.concat_ws(
        ",", normalize_scope("orchard_scope")).alias("orchards"))
