"""Coverage, gold sets, generation metrics, failures and traces over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dialog as D
from ..functions.json_text import citations
from ..operators import metrics as M
from ..operators import ops as O
from ..sources.readers import ingest_corpus, normalize_gold
from .base import query, quote, table


def _chunks(spark, sf_dir):
    i = (F.col("doc_id") % 10).cast("int")
    kinds = ["text"] * 5 + ["qa_pair", "table", "table_broken", "image", "table"]
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.get(F.array(*map(F.lit, kinds)), i).alias("block_type"))


_CHUNKS = """c AS (SELECT CASE WHEN doc_id % 10 <= 5 THEN 'text' WHEN doc_id % 10 IN (6, 9)
  THEN 'table' WHEN doc_id % 10 = 8 THEN 'image' END AS type FROM documents),
ix AS (SELECT t.type, count(c.type) AS indexed FROM (VALUES ('text'), ('table'), ('image'),
  ('scan_page')) t(type) LEFT JOIN c USING (type) GROUP BY t.type)"""


@query("indexed_counts", f"WITH {_CHUNKS} SELECT type, indexed FROM ix")
def indexed_counts(spark, sf_dir):
    return M.indexed_counts(_chunks(spark, sf_dir)).select("type", "indexed")


@query("coverage", f"""WITH {_CHUNKS}, n AS (SELECT count(*) AS n FROM labels),
a AS (SELECT 'text' AS type, n AS annotated FROM n UNION ALL SELECT 'table', n // 4 FROM n
  UNION ALL SELECT 'image', 0 FROM n UNION ALL SELECT 'scan_page', 0 FROM n),
j AS (SELECT type, indexed, annotated FROM ix JOIN a USING (type))
SELECT type, indexed, annotated, CASE WHEN annotated > 0 THEN round(indexed / annotated, 4) END
  AS coverage FROM j
UNION ALL SELECT 'overall', sum(CASE WHEN annotated > 0 THEN indexed ELSE 0 END)::BIGINT,
  sum(annotated)::BIGINT, round(sum(CASE WHEN annotated > 0 THEN indexed ELSE 0 END)
    / sum(annotated), 4) FROM j""")
def coverage(spark, sf_dir):
    n = F.count("*")
    counts = table(spark, sf_dir, "labels").agg(F.to_json(F.struct(
        n.alias("text"), F.floor(n / 4).alias("table"))).alias("annotations"))
    return M.parse_coverage(_chunks(spark, sf_dir), M.load_annotations(counts))


def _gold(spark, sf_dir):
    """Documents as gold questions: language, category and difficulty partly missing."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    raw = d.select(
        F.when(i % 17 == 0, " ").otherwise(F.concat(F.lit("q "), F.col("text"))).alias("question"),
        F.when(i % 4 == 0, "en").when(i % 4 == 1, "fr").alias("q_lang"),
        F.when(i % 3 == 0, "th").alias("language"),
        F.when(i % 5 > 0, F.col("source")).alias("category"),
        F.when(i % 7 == 0, "Colloquial").when(i % 7 == 1, " ").alias("difficulty"),
        (i % 11 == 0).alias("cross_lingual"), F.col("doc_id").cast("string").alias("ref_doc_id"),
        F.array(F.col("doc_id").cast("string")).alias("anchors"), F.lit(None).cast("string")
        .alias("gold_answer"))
    return normalize_gold(raw, ["thble", "nicht", "on"])


_GOLD = """g AS (SELECT doc_id, 'q ' || text AS q, CASE WHEN doc_id % 4 = 0 THEN 'en'
  WHEN doc_id % 3 = 0 THEN 'th' ELSE 'zh' END AS language,
  CASE WHEN doc_id % 5 > 0 THEN source ELSE 'unknown' END AS intent FROM documents
  WHERE doc_id % 17 <> 0),
gd AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'Cross-language' WHEN doc_id % 7 = 0
  THEN 'Colloquial' WHEN contains(lower(q), 'thble') OR contains(lower(q), 'nicht') THEN 'Alias'
  WHEN length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) > CASE WHEN language = 'en' THEN 60
  ELSE 30 END THEN 'Long query' ELSE 'Easy' END AS difficulty FROM g)"""


@query("gold_set", f"WITH {_GOLD} SELECT CAST(doc_id AS VARCHAR) AS id, language, intent, difficulty FROM gd")
def gold_set(spark, sf_dir):
    return _gold(spark, sf_dir).select(F.get("gold_chunk_ids", F.lit(0)).alias("id"), "language",
                                       "intent", "difficulty")


@query("gold_report", f"""WITH {_GOLD} SELECT CASE WHEN grouping(language) = 0 THEN 'language'
  WHEN grouping(intent) = 0 THEN 'intent' WHEN grouping(difficulty) = 0 THEN 'difficulty'
  ELSE 'total' END AS dimension, coalesce(language, intent, difficulty, 'all') AS value,
  count(*) AS n FROM gd GROUP BY GROUPING SETS ((language), (intent), (difficulty), ())""")
def gold_report(spark, sf_dir):
    return M.gold_report(_gold(spark, sf_dir))


def _cases(spark, sf_dir):
    """Assistant messages as answers: neighbours are evidence, ids are cited in the text."""
    c = table(spark, sf_dir, "conversations")
    i = F.col("conv_id") + F.col("turn")
    ev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    a = c.filter("role = 'assistant'").join(ev, ["conv_id", "turn"], "left")
    k = F.col("conv_id").cast("string")
    return a.select(
        "conv_id", "turn",
        F.concat("text", F.when(i % 3 == 0, F.concat(F.lit(" [c"), k, F.lit("] [x9] [c"), k,
                                                     F.lit("]")))
                 .when(i % 3 == 1, " insufficient evidence").otherwise("")).alias("answer"),
        F.when(i % 3 == 0, F.array(F.concat(F.lit("c"), k), F.lit("x9"),
                                   F.concat(F.lit("c"), k)))
        .otherwise(F.array().cast("array<string>")).alias("cited_ids"),
        F.array(F.concat(F.lit("c"), k), F.lit("d1")).alias("provided_ids"),
        F.array(F.lit("de la"), F.lit("the of"), F.lit("on")).alias("gold_points"),
        F.array(F.coalesce("prev", F.lit("")), F.lit("on the way")).alias("evidence_texts"),
        F.col("prev").isNotNull().alias("has_evidence"),
        F.when(i % 4 == 0, 0.5).when(i % 4 == 1, 0.9).cast("double").alias("faithfulness"),
        F.lit(None).cast("double").alias("answer_correctness"))


_CASES = """cs AS (SELECT a.conv_id, a.turn, (a.conv_id + a.turn) % 3 AS i3,
  (a.conv_id + a.turn) % 4 AS i4, p.text IS NOT NULL AS has_evidence,
  a.text || CASE (a.conv_id + a.turn) % 3 WHEN 0 THEN ' [c' || a.conv_id || '] [x9] [c'
    || a.conv_id || ']' WHEN 1 THEN ' insufficient evidence' ELSE '' END AS answer,
  coalesce(p.text, '') || chr(10) || 'on the way' AS ev
  FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


@query("citations", f"""WITH {_CASES} SELECT conv_id, turn, CASE WHEN i3 = 0 THEN 'c' || conv_id
  ELSE '' END AS cited FROM cs""")
def citations_query(spark, sf_dir):
    return _cases(spark, sf_dir).select("conv_id", "turn", F.concat_ws(
        ",", citations("answer", "provided_ids")).alias("cited"))


_COVER = "((contains(ev, 'de') AND contains(ev, 'la'))::INT + (contains(ev, 'the') " \
    "AND contains(ev, 'of'))::INT + contains(ev, 'on')::INT) / 3.0"


@query("citation_accuracy", f"""WITH {_CASES} SELECT conv_id, turn, round(CASE WHEN i3 = 0
  THEN 2.0 / 3 ELSE 0.0 END, 6)::DOUBLE AS accuracy, round({_COVER}, 6)::DOUBLE AS coverage FROM cs""")
def citation_accuracy(spark, sf_dir):
    return _cases(spark, sf_dir).select(
        "conv_id", "turn", F.round(M.citation_accuracy("cited_ids", "provided_ids"), 6)
        .alias("accuracy"), F.round(M.evidence_coverage("gold_points", "evidence_texts"), 6)
        .alias("coverage"))


@query("generation_report", f"""WITH {_CASES} SELECT 0.0::DOUBLE AS answer_correctness,
  round(avg(CASE i4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 END), 4)::DOUBLE AS faithfulness,
  round(avg(CASE WHEN i3 = 0 THEN 2.0 / 3 ELSE 0.0 END), 4)::DOUBLE AS citation_accuracy,
  round(avg({_COVER}), 4)::DOUBLE AS evidence_coverage FROM cs""")
def generation_report(spark, sf_dir):
    return M.generation_report(_cases(spark, sf_dir))


@query("abstention_accuracy", f"""WITH {_CASES} SELECT avg(CASE WHEN (NOT has_evidence) =
  contains(answer, 'insufficient evidence') THEN 1.0 ELSE 0.0 END)::DOUBLE AS abstention_accuracy,
  count(*) AS n_cases FROM cs""")
def abstention_accuracy(spark, sf_dir):
    return M.abstention_accuracy(_cases(spark, sf_dir))


_FAIL = ["", "token overflow", " 摘要失败", " 最大上下文", " 未能完成"]


def _answers(spark, sf_dir):
    i = ((F.col("conv_id") * 3 + F.col("turn")) % 23).cast("int")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.when(i == 7, "  ").otherwise(F.concat("text", F.coalesce(
            F.get(F.array(*map(F.lit, _FAIL)), i), F.lit("")))).alias("answer"))


_ANS = f"""an AS (SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 23 WHEN 7 THEN 'NO_RESPONSE'
  WHEN 1 THEN 'LLM_TOKEN_OVERFLOW' WHEN 2 THEN 'SUMMARY_FAILED' WHEN 3 THEN 'MODEL_CONTEXT_ERROR'
  WHEN 4 THEN 'NO_RESPONSE' END AS failure FROM conversations WHERE role = 'assistant')"""


@query("failure_classes", f"WITH {_ANS} SELECT conv_id, turn, failure FROM an")
def failure_classes(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", D.classify_failure("answer")
                                          .alias("failure"))


@query("dialog_success", f"""WITH {_ANS}, f AS (SELECT failure, count(*) AS n FROM an
  WHERE failure IS NOT NULL GROUP BY failure)
SELECT count(*) AS total_requests, count(*) - count(failure) AS successful,
  round((count(*) - count(failure)) / count(*), 4) AS success_rate,
  (SELECT string_agg(failure || '=' || n, ',' ORDER BY failure) FROM f) AS failures FROM an""")
def dialog_success(spark, sf_dir):
    r = M.dialog_success(_answers(spark, sf_dir))
    shown = F.transform(F.map_entries("failures_by_type"),
                        lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return r.select("total_requests", "successful", "success_rate",
                    F.concat_ws(",", shown).alias("failures"))


@query("abstentions", f"""WITH {_CASES} SELECT conv_id, turn, i3 = 1 AS abstains FROM cs""")
def abstentions(spark, sf_dir):
    return _cases(spark, sf_dir).select("conv_id", "turn", D.is_abstention("answer")
                                        .alias("abstains"))


_MSGS = [("TimeoutError", "gave up", "llm"), ("X", "read timed out", "tool"),
         ("ApiError", "maximum context reached", "llm"), ("PermissionError", "no", "tool"),
         ("Y", "权限不足: 角色", "llm"), ("ValueError", "bad", "tool"), ("ValueError", "bad", "llm"),
         ("Z", "参数错误: x", "tool"), ("Q", "boom", "tool"), ("Q", "token count limit", "tool")]
_KIND = ["LLM_TIMEOUT", "TOOL_TIMEOUT", "LLM_TOKEN_OVERFLOW", "TOOL_PERMISSION_DENIED",
         "TOOL_PERMISSION_DENIED", "TOOL_INVALID_ARGUMENT", "LLM_TIMEOUT", "TOOL_INVALID_ARGUMENT",
         "TOOL_TIMEOUT", "LLM_TOKEN_OVERFLOW"]


def _errors(spark, sf_dir):
    k = (F.col("event_id") % len(_MSGS)).cast("int")
    cols = [F.get(F.array(*[F.lit(m[j]) for m in _MSGS]), k).alias(n)
            for j, n in enumerate(("kind", "message", "domain"))]
    e = table(spark, sf_dir, "events").select("event_id", *cols)
    return e.withColumn("error", D.classify_error("kind", "message", "domain"))


_ERR = f"""er AS (SELECT event_id, list_extract([{', '.join(map(quote, _KIND))}],
  CAST(event_id % {len(_KIND)} AS INTEGER) + 1) AS error FROM events)"""


@query("error_classes", f"WITH {_ERR} SELECT event_id, error FROM er")
def error_classes(spark, sf_dir):
    return _errors(spark, sf_dir).select("event_id", "error")


@query("error_strategies", f"""WITH {_ERR}, st AS (SELECT * FROM (VALUES
  """ + ", ".join(f"({quote(k)}, {quote(a)}, {quote(b) if b else 'NULL'})"
                  for k, (a, b, _) in V.ERROR_STRATEGIES.items())
       + """) t(error, action, retry_budget))
SELECT event_id, coalesce(action, 'retry_once') AS action, retry_budget,
  coalesce(action, '') = 'memory_degrade' AS degrades FROM er LEFT JOIN st USING (error)""")
def error_strategies(spark, sf_dir):
    e = _errors(spark, sf_dir)
    return e.select("event_id", D.error_strategy("error")["action"].alias("action"),
                    D.error_strategy("error")["retry_budget"].alias("retry_budget"),
                    D.degrades_memory("error").alias("degrades"))


def _trace_tables(spark, sf_dir):
    """Users as requests, their events as tool calls, documents of one source as evidence."""
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    req = c.select(
        key.alias("trace_id"), F.concat(F.lit("t"), (key % 50).cast("string")).alias("thread_id"),
        F.col("c_name").alias("user_id"), F.lit("default").alias("tenant_id"),
        F.lit("MUST_RAG").alias("route"), F.lit("harvest").alias("intent"),
        F.col("c_acctbal").alias("latency_ms"), F.col("c_name").alias("query"),
        F.lit("总结").alias("summary"), F.when(key % 4 > 0, F.col("c_mktsegment")).alias("answer"),
        (key % 3 == 0).alias("evidence_sufficient"), F.lit(1).alias("compressions"),
        F.lit(0).alias("retries"), F.when(key % 8 == 1, "LLM_TIMEOUT").alias("last_error"))
    n = c.agg(F.max("c_custkey").alias("n")).select("n").scalar()
    who = F.col("event_id") % (n + 1)
    calls = e.select(who.alias("trace_id"), F.col("event_id").alias("step"),
                     F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool_name"))
    docs = e.select(who.alias("trace_id"), F.when(F.col("user_id") % 2 == 0, "bm25_original")
                    .otherwise("dense_original").alias("source_route"))
    ranked = e.select(
        who.alias("trace_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("chunk_id"),
        F.concat(F.col("event_type"), F.lit("榴莲")).alias("text"),
        F.col("user_id").cast("int").alias("rrf_rank"),
        F.when(F.col("user_id") % 3 > 0, F.col("value")).alias("rerank_score"))
    return req, calls, docs, ranked


@query("trace_records", """WITH n AS (SELECT max(c_custkey) + 1 AS n FROM customer),
e AS (SELECT *, event_id % (SELECT n FROM n) AS tid FROM events),
tl AS (SELECT tid, string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE event_type <> 'view')
  AS tools, string_agg(DISTINCT CASE WHEN user_id % 2 = 0 THEN 'bm25_original'
    ELSE 'dense_original' END, ',' ORDER BY CASE WHEN user_id % 2 = 0 THEN 'bm25_original'
    ELSE 'dense_original' END) AS sources FROM e GROUP BY tid),
dk AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY event_id) AS p FROM e),
dc AS (SELECT tid, count(*) AS nd, sum(length(event_type)) AS nc, string_agg(CASE WHEN p <= 10 THEN event_id || '=' || user_id END,
    ',' ORDER BY event_id) AS ranks FROM dk GROUP BY tid)
SELECT c_custkey AS trace_id, coalesce(tools, '') AS tools, coalesce(sources, '') AS sources,
  coalesce(ranks, '') AS ranks, CASE WHEN c_custkey % 3 = 0 THEN 'sufficient'
    WHEN coalesce(nd, 0) > 0 THEN 'insufficient' ELSE 'no_result' END AS decision,
  CAST(2 + 2 * coalesce(nd, 0) + (length(c_name) + coalesce(nc, 0)
    + greatest(coalesce(nd, 0) - 1, 0) + 3) // 4 AS INTEGER) AS token_input,
  CAST(CASE WHEN c_custkey % 4 > 0 THEN (length(c_mktsegment) + 3) // 4 ELSE 0 END AS INTEGER)
    AS token_output, c_custkey % 4 > 0 AND c_custkey % 8 <> 1 AS success
FROM customer LEFT JOIN tl ON tl.tid = c_custkey LEFT JOIN dc ON dc.tid = c_custkey""")
def trace_records(spark, sf_dir):
    t = O.trace_records(*_trace_tables(spark, sf_dir))
    ranks = F.transform(F.map_entries("rrf_ranks"),
                        lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return t.select("trace_id", F.concat_ws(",", "tool_sequence").alias("tools"),
                    F.concat_ws(",", "retrieval_sources").alias("sources"),
                    F.concat_ws(",", ranks).alias("ranks"),
                    F.col("evidence_decision").alias("decision"), "token_input", "token_output",
                    F.col("final_success").alias("success"))


@query("tool_sequences", """SELECT conv_id AS trace_id, CAST(turn AS BIGINT) AS step, CASE WHEN turn % 2 = 0
    THEN 'asset_query' ELSE 'weather' END AS tool_name FROM conversations
WHERE role = 'assistant' AND length(text) % 3 = 0""")
def tool_sequences(spark, sf_dir):
    """Tool calls out of message logs: some answers are calls, some only look like it."""
    n = F.length("text")
    tool = F.when(F.col("turn") % 2 == 0, "asset_query").otherwise("weather")
    call = F.to_json(F.struct(F.struct(tool.alias("tool"), F.col("text").alias("args"))
                              .alias("action")))
    said = (F.when(n % 3 == 0, F.concat(F.lit("  "), call))
            .when(n % 3 == 1, F.concat(F.lit("{"), call)).otherwise(F.col("text")))
    log = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("trace_id"), "turn", "role", said.alias("text"))
    none = spark.createDataFrame([], "trace_id long, step long, tool_name string")
    return O.with_logged_tools(none, log)


@query("newest_traces", """SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC
LIMIT 1000""")
def newest_traces(spark, sf_dir):
    return O.newest(table(spark, sf_dir, "events"), order=("ts", "event_id")).select(
        "event_id", "ts")


@query("ingest_corpus", """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id,
  CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'zh' END AS language, length(text) AS n_chars,
  'text' AS block_type FROM documents WHERE text <> '' AND doc_id % 9 <> 0""")
def ingest_corpus_query(spark, sf_dir):
    i = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 2 == 0, F.col("source")).alias("source_file"),
        F.col("source").alias("doc"), F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("text"))
        .alias("index_text"), F.when(i % 9 > 0, F.col("text")).alias("text"),
        F.when(i % 2 == 0, F.create_map(F.lit("src_lang"), F.col("lang"))).alias("metadata"),
        F.lit(None).cast("string").alias("provenance"), F.lit("").alias("block_type"))
    return ingest_corpus(raw).select(
        "chunk_id", "document_id", "language", F.length("text").cast("long").alias("n_chars"),
        "block_type")
