"""Conversation windows, summaries, levels and budgets over the driver conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dialog as D
from ..functions.text import estimate_tokens
from ..operators import dialog as O
from .base import query, quote, table

N, THRESHOLD = 4, 2000  # short driver conversations need a small window and threshold


def _messages(spark, sf_dir):
    """Driver messages; system rows play tool output, every fifth user row is small talk and
    every answer at turn 5 repeats the one at turn 1."""
    c = table(spark, sf_dir, "conversations")
    first = c.filter("turn = 1 AND role = 'assistant'").select(
        "conv_id", F.col("text").alias("__first"))
    return c.join(first, "conv_id", "left").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))
        .alias("role"),
        F.when((F.col("role") == "user") & (F.col("conv_id") % 5 == 0), " OK ")
        .when((F.col("role") == "assistant") & (F.col("turn") == 5), F.coalesce("__first", "text"))
        .otherwise(F.col("text")).alias("text"))


_MSG = """m AS (SELECT c.conv_id, c.turn, CASE c.role WHEN 'system' THEN 'tool' ELSE c.role END
  AS role, CASE WHEN c.role = 'user' AND c.conv_id % 5 = 0 THEN ' OK ' WHEN c.role = 'assistant'
  AND c.turn = 5 THEN coalesce(f.text, c.text) ELSE c.text END AS text FROM conversations c
  LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 1 AND f.role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency,
  count(*) OVER (PARTITION BY conv_id) AS n, sum(length(text)) OVER (PARTITION BY conv_id)
  AS chars FROM m)"""


def summary_sql(out: str, source: str) -> str:
    """CTE ``out(conv_id, summary)``: rule summary of the messages in ``source``."""
    return f"""{out}_l AS (
  SELECT conv_id, turn, '用户问：' || substr(trim(text), 1, 60) AS line FROM {source}
    WHERE role = 'user' AND length(trim(text)) > 1 AND lower(trim(text)) NOT IN (
      {', '.join(map(quote, V.SMALLTALK))})
  UNION ALL SELECT conv_id, turn, '回答要点：' || substr(t, 1, 80) FROM (SELECT conv_id, turn,
      {_strip('text')} AS t FROM {source} WHERE role = 'assistant') WHERE length(t) > 1
    QUALIFY row_number() OVER (PARTITION BY conv_id, substr(t, 1, 40) ORDER BY turn) = 1
  UNION ALL SELECT conv_id, turn, '工具结果：' || substr(text, 1, 60) FROM {source}
    WHERE role = 'tool'),
{out} AS (SELECT conv_id, substr(string_agg(line, chr(10) ORDER BY turn), 1, 6000) AS summary
  FROM {out}_l GROUP BY conv_id)"""


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


@query("recent_window", f"WITH {_MSG} SELECT conv_id, turn, recency <= {N} AS recent FROM r")
def recent_window(spark, sf_dir):
    return O.split_window(_messages(spark, sf_dir), N).select("conv_id", "turn", "recent")


@query("newest_messages", f"""WITH {_MSG} SELECT conv_id, turn, CAST(recency AS INTEGER) AS recency
FROM r WHERE recency <= {N}""")
def newest_messages(spark, sf_dir):
    return O.recent_window(_messages(spark, sf_dir), N).select("conv_id", "turn", "recency")


@query("critical_messages", f"""WITH {_MSG} SELECT conv_id, turn FROM m WHERE role <> 'tool'
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def critical_messages(spark, sf_dir):
    return O.critical_messages(_messages(spark, sf_dir)).select("conv_id", "turn")


@query("shrink_window", f"""WITH {_MSG} SELECT conv_id, turn FROM r
WHERE recency <= greatest(2, n // 2)""")
def shrink_window(spark, sf_dir):
    return O.shrink_window(_messages(spark, sf_dir)).select("conv_id", "turn")


@query("rule_summary", f"""WITH {_MSG}, {summary_sql("s", "m")}
SELECT DISTINCT m.conv_id, coalesce(summary, '') AS summary FROM m LEFT JOIN s
  ON s.conv_id = m.conv_id""")
def rule_summary(spark, sf_dir):
    return O.rule_summary(_messages(spark, sf_dir))


_CUT = f"{_MSG}, o AS (SELECT * FROM r WHERE recency > {N} AND chars >= {THRESHOLD})"


@query("compress_messages", f"""WITH {_MSG} SELECT conv_id, turn, recency > {N}
  AND chars >= {THRESHOLD} AS trimmed FROM r""")
def compress_messages(spark, sf_dir):
    return O.compress(_messages(spark, sf_dir), N, THRESHOLD)[0].select(
        "conv_id", "turn", "trimmed")


@query("compress_summaries", f"""WITH {_CUT}, {summary_sql("s", "o")}
SELECT DISTINCT m.conv_id, coalesce(summary, '') AS summary FROM m LEFT JOIN s
  ON s.conv_id = m.conv_id""")
def compress_summaries(spark, sf_dir):
    return O.compress(_messages(spark, sf_dir), N, THRESHOLD)[1]


@query("summary_choice", f"""WITH {_MSG}, {summary_sql("s", "m")}
SELECT DISTINCT m.conv_id, CASE WHEN m.conv_id % 3 = 0 THEN 'model ' || m.conv_id
  ELSE CASE WHEN summary IS NULL THEN 'before' ELSE substr('before' || chr(10) || summary, 1, 6000)
  END END AS summary FROM m LEFT JOIN s ON s.conv_id = m.conv_id""")
def summary_choice(spark, sf_dir):
    m = _messages(spark, sf_dir)
    convs = m.select("conv_id").distinct()
    prev = convs.withColumn("summary", F.lit("before"))
    model = convs.withColumn("model_summary", F.when(
        F.col("conv_id") % 3 == 0, F.concat(F.lit(" model "), F.col("conv_id").cast("string")))
        .otherwise(" "))
    return O.summarize(m, prev, model)


def tokens_sql(e: str) -> str:
    wide = f"len(regexp_extract_all({e}, '[\\x{{2e80}}-\\x{{9fff}}\\x{{e00}}-\\x{{e7f}}" \
        "\\x{f900}-\\x{faff}]'))"
    return f"({wide} + (length({e}) - {wide} + 3) // 4)"


def _context(m):
    return m.groupBy("conv_id").agg(F.lit("目标 goal").alias("business_state"),
                                    F.max_by("text", "turn").alias("query"),
                                    F.min_by("text", "turn").alias("summary"))


_LEVELS = f"""{_MSG}, k AS (SELECT *, CASE WHEN role <> 'tool' THEN row_number() OVER (
    PARTITION BY conv_id, role = 'tool' ORDER BY turn DESC) END AS talk FROM r),
x AS (SELECT conv_id, {tokens_sql("'目标 goal'")} + {tokens_sql("arg_max(text, turn)")} AS base,
  {tokens_sql("arg_min(text, turn)")} AS summ, sum({tokens_sql('text')}) AS m0,
  sum(CASE WHEN recency <= greatest(2, n // 2) THEN {tokens_sql('text')} ELSE 0 END) AS m1,
  sum(CASE WHEN role = 'tool' THEN {tokens_sql(quote(V.TOOL_OMITTED))} ELSE {tokens_sql('text')}
    END) AS m2, sum(CASE WHEN talk <= 2 THEN {tokens_sql('text')} ELSE 0 END) AS m3
  FROM k GROUP BY conv_id),
lv AS (SELECT conv_id, (m0 + summ + base)::BIGINT AS l0, (m1 + summ + base)::BIGINT AS l1,
  (m2 + summ + base)::BIGINT AS l2, (m3 + summ + base)::BIGINT AS l3, base::BIGINT AS l4 FROM x)"""


@query("level_tokens", f"WITH {_LEVELS} SELECT * FROM lv")
def level_tokens(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return O.level_tokens(m, _context(m))


@query("fit_level", f"""WITH {_LEVELS} SELECT conv_id, CAST(CASE WHEN l0 <= 300 THEN 0
  WHEN l1 <= 300 THEN 1 WHEN l2 <= 300 THEN 2 WHEN l3 <= 300 THEN 3 ELSE 4 END AS INTEGER)
  AS level, CASE WHEN l0 <= 300 THEN l0 WHEN l1 <= 300 THEN l1 WHEN l2 <= 300 THEN l2
  WHEN l3 <= 300 THEN l3 ELSE l4 END AS tokens FROM lv""")
def fit_level(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return O.fit_level(m, _context(m), 300)


@query("apply_levels", f"""WITH {_MSG} SELECT 1 AS level, conv_id, turn, text FROM r
  WHERE recency <= greatest(2, n // 2)
UNION ALL SELECT 2, conv_id, turn, CASE WHEN role = 'tool' THEN {quote(V.TOOL_OMITTED)}
  ELSE text END FROM m
UNION ALL SELECT 3, conv_id, turn, text FROM (SELECT * FROM m WHERE role <> 'tool'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2)""")
def apply_levels(spark, sf_dir):
    m = _messages(spark, sf_dir)
    parts = [O.apply_level(m, i).select(F.lit(i).alias("level"), "conv_id", "turn", "text")
             for i in (1, 2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_CAPS = D.budget_caps()
_SECTION = {"user": "query", "assistant": "rag", "tool": "summary"}


@query("budget_report", f"""WITH {_MSG}, s AS (SELECT conv_id, turn, CASE role WHEN 'user'
  THEN 'query' WHEN 'assistant' THEN 'rag' ELSE 'summary' END AS section,
  {tokens_sql('text')} AS used FROM m)
SELECT conv_id, turn, section, CAST(used AS INTEGER) AS used, CAST(CASE section WHEN 'query'
  THEN {_CAPS['query']} WHEN 'rag' THEN {_CAPS['rag']} ELSE {_CAPS['summary']} END AS INTEGER)
  AS cap, used > CASE section WHEN 'query' THEN {_CAPS['query']} WHEN 'rag' THEN {_CAPS['rag']}
  ELSE {_CAPS['summary']} END AS over FROM s""")
def budget_report(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for kv in _SECTION.items() for x in kv])[F.col("role")]
    m = _messages(spark, sf_dir).withColumn("section", name)
    # The report keeps one row per section text; the turn travels in the conversation key.
    keyed = m.withColumn("conv_id", F.struct("conv_id", "turn"))
    return O.budget_report(keyed).select("conv_id.conv_id", "conv_id.turn", "section", "used",
                                         "cap", "over")


@query("fit_sections", f"""WITH {_MSG} SELECT conv_id, turn, md5(CASE WHEN length(text) <= 40
  THEN text ELSE right(text, 40) END) AS query, md5(CASE WHEN length(text) <= 280 THEN text
  ELSE right(text, 280) END) AS rag FROM m""")
def fit_sections(spark, sf_dir):
    return _messages(spark, sf_dir).select(
        "conv_id", "turn", F.md5(D.fit("text", "query", 800)).alias("query"),
        F.md5(D.fit("text", "rag", 800)).alias("rag"))


_RENDER = f"""h AS (SELECT conv_id, string_agg('[' || CASE role WHEN 'user' THEN '用户'
  WHEN 'assistant' THEN '助手' WHEN 'tool' THEN '工具' ELSE '消息' END || '] '
  || substr(text, 1, 300), chr(10) ORDER BY turn) AS history FROM r WHERE recency <= {N}
  GROUP BY conv_id)"""


@query("render_history", f"WITH {_MSG}, {_RENDER} SELECT conv_id, md5(history) AS history_md5 FROM h")
def render_history(spark, sf_dir):
    return O.render_messages(_messages(spark, sf_dir), N).select(
        "conv_id", F.md5("history").alias("history_md5"))


@query("build_context", f"""WITH {_MSG}, {_RENDER}, {summary_sql("s", "m")},
q AS (SELECT conv_id, arg_max(text, turn) AS query FROM m GROUP BY conv_id)
SELECT q.conv_id, md5('Answer from evidence.' || CASE WHEN coalesce(summary, '') <> ''
    THEN chr(10) || chr(10) || '【会话摘要】' || CASE WHEN length(summary) <= 300 THEN summary
      ELSE right(summary, 300) END ELSE '' END || chr(10) || chr(10) || '【最近对话】'
  || CASE WHEN length(history) <= 500 THEN history ELSE right(history, 500) END
  || chr(10) || chr(10) || '【当前问题】' || CASE WHEN length(query) <= 100 THEN query
    ELSE right(query, 100) END) AS context_md5
FROM q LEFT JOIN h USING (conv_id) LEFT JOIN s USING (conv_id)""")
def build_context(spark, sf_dir):
    m = _messages(spark, sf_dir)
    q = m.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    j = (q.join(O.render_messages(m, N), "conv_id", "left")
         .join(O.rule_summary(m), "conv_id", "left"))
    text = D.build_context(F.lit("Answer from evidence."), "summary", "history", F.lit(""),
                           "query", 2000)
    return j.select("conv_id", F.md5(text).alias("context_md5"))


@query("token_estimates", f"""SELECT doc_id, CAST({tokens_sql('text')} AS INTEGER) AS tokens
FROM documents""")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens("text")
                                                    .alias("tokens"))


@query("business_state", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '涉及实体：disease='
  || event_type || CASE WHEN event_id % 3 = 0 THEN '，plot=' || user_id ELSE '' END || chr(10)
  ELSE CASE WHEN event_id % 3 = 0 THEN '涉及实体：plot=' || user_id || chr(10) ELSE '' END END
  || '生育阶段：harvest' || CASE WHEN event_id % 5 = 0 THEN chr(10) || '待确认操作：task_create'
  ELSE '' END AS state FROM events""")
def business_state(spark, sf_dir):
    i = F.col("event_id")
    e = F.create_map(F.lit("disease"), F.when(i % 2 == 0, F.col("event_type")), F.lit("plot"),
                     F.when(i % 3 == 0, F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", D.business_state(
        e, F.lit("harvest"), F.when(i % 5 == 0, "task_create"), F.lit("")).alias("state"))


@query("smalltalk", f"""WITH {_MSG} SELECT conv_id, turn, lower({_strip('text')}) IN (
  {', '.join(map(quote, V.SMALLTALK))}) OR length({_strip('text')}) = 1 AS smalltalk FROM m""")
def smalltalk(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", D.is_smalltalk("text")
                                           .alias("smalltalk"))


_ERR = ["LLM_TIMEOUT", "TOOL_TIMEOUT", "SUMMARY_FAILED", "LLM_TOKEN_OVERFLOW", "RAG_NO_RESULT",
        "OTHER", "TASK_CREATE_FAILED"]


@query("next_level", f"""WITH e AS (SELECT event_id, list_extract([{', '.join(map(quote, _ERR))}],
  CAST(event_id % {len(_ERR)} AS INTEGER) + 1) AS error, event_id % 5 AS level FROM events)
SELECT event_id, CAST(CASE WHEN error IN ('LLM_TIMEOUT', 'TOOL_TIMEOUT') THEN level
  WHEN error = 'SUMMARY_FAILED' THEN greatest(level, 3) ELSE least(level + 1, 4) END AS INTEGER)
  AS level FROM e""")
def next_level(spark, sf_dir):
    i = F.col("event_id")
    err = F.get(F.array(*map(F.lit, _ERR)), (i % len(_ERR)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", D.next_level(err, i % 5)
                                                 .alias("level"))
