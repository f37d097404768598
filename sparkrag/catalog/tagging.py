"""Terminology, labels, risk flags, routes and chunk records over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import json_text as J
from ..functions import tagging as G
from ..functions.text import normalize_text, once, spread
from ..operators import tagging as T
from ..plans.semantic import route, semantic_parse
from ..sources.stage import staged
from .base import TERMS, documents, query, quote, table, terms
from .retrieval import _EXPANDED, slots_sql

# Requests in four languages; every document is asked one of them about itself.
PHRASES = [
    "帮我创建一个巡检工单", "把工单5标记为已完成", "查一下工单123的状态", "今天有什么告警",
    "3号园有多少台传感器", "create an inspection task for plot 5", "mark task 5 as completed",
    "check the status of task 123", "any alarms today", "list all devices in orchard 3",
    "buat tugasan pemeriksaan esok", "semak tugasan 45 untuk saya", "开花期施什么肥 25 ml",
    "花芽分化怎么管理", "sop for export and food safety", "will it rain, weather forecast",
    "soil moisture sensor", "what disease is this", "农药浓度多少", "post-harvest ripening",
    "สวนที่ 3 ออกดอก", "petak 5 berbunga", "坐果期灌溉", "nothing special here",
]


def _asked(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return d.select("doc_id", F.concat("text", F.lit(" "), phrase).alias("text"))


_ASKED = ("asked AS (SELECT doc_id, text || ' ' || list_extract([" + ", ".join(map(quote, PHRASES))
          + f"], CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1) AS text FROM documents)")


def _value(spark, sf_dir):
    return once(_asked(spark, sf_dir), "v", normalize_text("text"))


def _cases(e: str, pairs, default: str) -> str:
    return ("CASE " + " ".join(f"WHEN {c} THEN {quote(v)}" for c, v in pairs)
            + f" ELSE {default} END").replace("{e}", e)


_STAGE = _cases("text", [(f"contains({{e}}, {quote(t)})", s) for t, s in
                         sorted(V.STAGE_TERMS, key=lambda t: -len(t[0]))], "'unknown'")


@query("growth_stage", f"WITH {_ASKED} SELECT doc_id, {_STAGE} AS stage FROM asked")
def growth_stage(spark, sf_dir):
    return _value(spark, sf_dir).select("doc_id", G.growth_stage("v").alias("stage"))


def _re2(p: str) -> str:
    """The same pattern for RE2, which has no lookahead and no ``\\p{Nd}`` quirks to mind."""
    return p.replace("(?![a-z0-9])", "(?:[^a-zA-Z0-9]|$)").replace("\\p{Nd}", "[0-9]")


def _match(p: str) -> str:
    return f"regexp_matches({{e}}, {quote(_re2(p))})"


_INTENT = _cases("text", [(" OR ".join(_match(p) for p in ps), n) for n, ps in V.RULE_INTENTS],
                 "'unknown'")


@query("rule_intent", f"WITH {_ASKED} SELECT doc_id, {_INTENT} AS intent FROM asked")
def rule_intent(spark, sf_dir):
    return _value(spark, sf_dir).select("doc_id", G.rule_intent("v").alias("intent"))


def _in(names) -> str:
    return "(" + ", ".join(map(quote, names)) + ")"


_RISKS = {
    "diagnosis_requested": f"intent IN {_in(V.DIAGNOSIS_INTENTS)} OR " + _match(V.DIAGNOSIS),
    "dosage_requested": _match(V.DOSE), "pesticide_related": _match(V.PESTICIDE),
    "regulation_related": _match(V.REGULATION), "weather_dependent": _match(V.WEATHER),
    "realtime_data_required": _match(V.REALTIME),
    "domain_knowledge_required": f"intent IN {_in(V.KNOWLEDGE_INTENTS)}",
    "business_action_required": f"intent IN {_in(V.BUSINESS_WRITE_INTENTS)} OR "
    + _match(V.BUSINESS_ACTION),
}
_FLAGS = (f"{_ASKED}, ai AS (SELECT *, {_INTENT} AS intent FROM asked), fl AS (SELECT *, "
          + ", ".join(f"({c}) AS {k}" for k, c in _RISKS.items()).replace("{e}", "text")
          + " FROM ai)")


@query("risk_flags", f"WITH {_FLAGS} SELECT doc_id, intent, {', '.join(V.RISK_FLAGS)} FROM fl")
def risk_flags(spark, sf_dir):
    df = once(_value(spark, sf_dir), "intent", G.rule_intent("v"))
    return once(df, "r", G.risk_features("v", "intent")).select("doc_id", "intent", "r.*")


@query("merge_risks", f"""WITH {_FLAGS} SELECT a.doc_id, {', '.join(
    f'(a.{k} OR coalesce(b.{k}, false)) AS {k}' for k in V.RISK_FLAGS)}
FROM fl a LEFT JOIN fl b ON b.doc_id = a.doc_id + 1""")
def merge_risks(spark, sf_dir):
    df = once(_value(spark, sf_dir), "intent", G.rule_intent("v"))
    # Both sides of the join read the flags of a document: computed once, with every flag once.
    r = staged(once(df, "r", G.risk_features("v", "intent")).select("doc_id", "r"), "risks")
    nxt = r.select((F.col("doc_id") - 1).alias("doc_id"), F.col("r").alias("n"))
    return r.join(nxt, "doc_id", "left").select("doc_id", G.merge_risks("r", "n").alias("m")
                                                ).select("doc_id", "m.*")


@query("entity_codes", f"""WITH {_ASKED} SELECT doc_id, CASE
  WHEN regexp_extract(text, '(?i)orchard\\s*[-_]?\\s*([0-9]+)', 1) <> ''
    THEN 'ORCHARD_' || CAST(regexp_extract(text, '(?i)orchard\\s*[-_]?\\s*([0-9]+)', 1) AS BIGINT)
  WHEN regexp_extract(text, '([0-9]+)\\s*号园', 1) <> ''
    THEN 'ORCHARD_' || CAST(regexp_extract(text, '([0-9]+)\\s*号园', 1) AS BIGINT)
  WHEN regexp_extract(text, 'สวน\\s*(?:ที่\\s*)?([0-9]+)', 1) <> ''
    THEN 'ORCHARD_' || CAST(regexp_extract(text, 'สวน\\s*(?:ที่\\s*)?([0-9]+)', 1) AS BIGINT)
  END AS orchard, CASE
  WHEN regexp_extract(text, '(?i)plot\\s*[-_]?\\s*([0-9]+)', 1) <> ''
    THEN 'PLOT_' || CAST(regexp_extract(text, '(?i)plot\\s*[-_]?\\s*([0-9]+)', 1) AS BIGINT)
  WHEN regexp_extract(text, '(?i)petak\\s*([0-9]+)', 1) <> ''
    THEN 'PLOT_' || CAST(regexp_extract(text, '(?i)petak\\s*([0-9]+)', 1) AS BIGINT) END AS plot
FROM asked""")
def entity_codes(spark, sf_dir):
    return _value(spark, sf_dir).select("doc_id", G.orchard_code("v").alias("orchard"),
                                        G.plot_code("v").alias("plot"))


_SLOTS = ("cultivar", "disease", "fertilizer", "pest")
_ENT = f"WITH {_EXPANDED}, {slots_sql('ds', 'documents', 'doc_id')}"


@query("detect_entities", _ENT + " SELECT doc_id, " + ", ".join(
    f"max(CASE WHEN slot = '{s}' THEN canonical END) AS {s}" for s in _SLOTS)
    + " FROM documents LEFT JOIN ds ON id = doc_id GROUP BY doc_id")
def detect_entities(spark, sf_dir):
    words = T.dictionary(T.entity_keys(terms(spark)))
    e = T.detect_entities(spread(table(spark, sf_dir, "documents")), words)
    return e.select("doc_id", *[F.col("entities")[s].alias(s) for s in _SLOTS])


_CONCEPT_IDS = """cid AS (SELECT canonical, prefix || '_' || lpad(CAST(row_number() OVER (
    PARTITION BY prefix ORDER BY canonical) AS VARCHAR), 3, '0') AS canonical_id FROM (
  SELECT canonical, arg_min(CASE WHEN category LIKE 'variety%' THEN 'CULTIVAR'
    ELSE upper(category) END, category_ord * 1000 + alias_ord) AS prefix FROM kv
  GROUP BY canonical))"""


_ENT_ID = (f"WITH {_EXPANDED}, "
           + slots_sql("ds", "documents", "doc_id", order="canonical, key"))


_WIDE = """kw AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(regexp_extract_all(text,
    '[A-Za-z]{7,}')) AS w FROM benchmark))"""


@query("detect_entities_wide", f"""WITH {_WIDE}, h AS (SELECT doc_id, key, 's' || length(key) % 5
    AS slot FROM documents JOIN kw ON contains(lower(text), key))
SELECT doc_id, slot, key AS name FROM h
QUALIFY row_number() OVER (PARTITION BY doc_id, slot ORDER BY length(key) DESC, key) = 1""")
def detect_entities_wide(spark, sf_dir):
    """All long words of the benchmark as a dictionary table, found in the documents by automata."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("key"))
    keys = words.distinct().select(
        "key", F.col("key").alias("value"), F.concat(
            F.lit("s"), (F.length("key") % 5).cast("string")).alias("slot"),
        F.col("key").alias("ord"))
    texts = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), F.lower("text").alias("v"))
    return T.find_keys(texts, keys).select(F.col("id").alias("doc_id"), "slot",
                                           F.col("value").alias("name"))


@query("detect_entity_ids", _ENT_ID + f", {_CONCEPT_IDS} SELECT doc_id, " + ", ".join(
    f"max(CASE WHEN slot = '{s}' THEN canonical_id END) AS {s}" for s in _SLOTS)
    + " FROM documents LEFT JOIN ds ON id = doc_id LEFT JOIN cid ON cid.canonical = ds.canonical"
    + " GROUP BY doc_id")
def detect_entity_ids(spark, sf_dir):
    words = T.dictionary(T.concept_keys(T.build_concepts(terms(spark))))
    e = T.detect_entities(spread(table(spark, sf_dir, "documents")), words)
    return e.select("doc_id", *[F.col("entities")[s].alias(s) for s in _SLOTS])


# A term table that grows with the data: parts as aliases, brand and type as canonical names.
_CATS = ["variety_thai", "disease", "pest", "nutrient", "malay_common", "symptom", "tools"]


def _part_terms(spark, sf_dir):
    k = F.col("p_partkey")
    ord_ = (F.col("p_size") % 7).cast("int")
    return table(spark, sf_dir, "part").select(
        F.get(F.array(*map(F.lit, _CATS)), ord_).alias("category"), ord_.alias("category_ord"),
        k.cast("int").alias("alias_ord"),
        F.concat_ws(" ", "p_name", (k % 40).cast("string"),
                    F.when(k % 9 == 0, "树").when(k % 9 == 1, "ใบ")).alias("alias"),
        F.concat_ws(" ", "p_brand", "p_type").alias("canonical"))


_PT = """pt AS (SELECT list_extract(['variety_thai', 'disease', 'pest', 'nutrient', 'malay_common',
    'symptom', 'tools'], p_size % 7 + 1) AS category, p_size % 7 AS category_ord,
  p_partkey AS alias_ord, p_name || ' ' || (p_partkey % 40) || CASE WHEN p_partkey % 9 = 0
    THEN ' 树' WHEN p_partkey % 9 = 1 THEN ' ใบ' ELSE '' END AS alias,
  p_brand || ' ' || p_type AS canonical FROM part)"""


@query("concept_ids", f"""WITH {_PT}, f AS (SELECT canonical, arg_min(category,
    category_ord::BIGINT * 1000000000 + alias_ord) AS first, string_agg(DISTINCT category, ',' ORDER BY
    category) AS source_categories FROM pt GROUP BY canonical),
g AS (SELECT *, CASE first WHEN 'variety_thai' THEN 'CULTIVAR' WHEN 'tools' THEN 'TERM'
    ELSE upper(first) END AS prefix, CASE first WHEN 'variety_thai' THEN 'cultivar'
    WHEN 'tools' THEN 'unknown' ELSE first END AS type FROM f),
a AS (SELECT DISTINCT canonical, alias FROM pt),
n AS (SELECT canonical, count(*) AS n_aliases, count(*) FILTER (WHERE contains(alias, 'ใบ')) AS n_th,
  count(*) FILTER (WHERE contains(alias, '树')) AS n_zh FROM a GROUP BY canonical)
SELECT canonical AS canonical_name, type, prefix || '_' || CASE WHEN r < 1000
  THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS canonical_id,
  source_categories, n_aliases + 1 AS n_aliases, n_th, n_zh
FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY canonical) AS r FROM g)
JOIN n USING (canonical)""")
def concept_ids(spark, sf_dir):
    c = T.build_concepts(_part_terms(spark, sf_dir))
    sizes = [F.size("aliases." + g) for g in V.LANGUAGES]
    return c.select("canonical_name", "type", "canonical_id",
                    F.concat_ws(",", "source_categories").alias("source_categories"),
                    sum(sizes[1:], sizes[0]).cast("long").alias("n_aliases"),
                    F.size("aliases.th").cast("long").alias("n_th"),
                    F.size("aliases.zh").cast("long").alias("n_zh"))


@query("flat_terms", f"""WITH {_PT} SELECT alias, arg_max(canonical, category_ord::BIGINT * 1000000000
  + alias_ord) AS canonical FROM pt GROUP BY alias""")
def flat_terms(spark, sf_dir):
    return T.flat_terms(_part_terms(spark, sf_dir))


@query("alias_lists", f"""WITH {_PT}, f AS (SELECT alias, arg_max(canonical, category_ord::BIGINT
  * 1000000000 + alias_ord) AS canonical, min(category_ord::BIGINT * 1000000000 + alias_ord) AS o
  FROM pt GROUP BY alias)
SELECT canonical, string_agg(alias, ';' ORDER BY o) AS aliases FROM f GROUP BY canonical""")
def alias_lists(spark, sf_dir):
    return T.alias_lists(_part_terms(spark, sf_dir)).select(
        "canonical", F.concat_ws(";", "aliases").alias("aliases"))


@query("alias_languages", f"""WITH {_PT} SELECT CASE WHEN contains(alias, 'ใบ') THEN 'th'
  WHEN contains(alias, '树') THEN 'zh' WHEN category = 'malay_common' THEN 'ms' ELSE 'en' END
  AS lang, count(*) AS n FROM pt GROUP BY 1""")
def alias_languages(spark, sf_dir):
    t = _part_terms(spark, sf_dir)
    return t.groupBy(G.alias_language("alias", "category").alias("lang")).agg(
        F.count("*").alias("n"))


@query("symptom_tags", f"""WITH {_EXPANDED} SELECT doc_id, (SELECT string_agg(canonical, ',' ORDER
  BY o) FROM (SELECT canonical, min(alias_ord) AS o FROM kv WHERE category = 'symptom'
    AND contains(text, alias) GROUP BY canonical)) AS symptoms FROM documents""")
def symptom_tags(spark, sf_dir):
    pairs = [(a, c) for cat, _, _, a, c in TERMS if cat == "symptom"]
    d = once(spread(table(spark, sf_dir, "documents")), "v", normalize_text("text"))
    return d.select("doc_id", F.nullif(F.concat_ws(",", G.symptoms("v", pairs)), F.lit(""))
                    .alias("symptoms"))


_DOMAIN = "CASE " + " ".join(f"WHEN {s} THEN '{d}'" for s, d in [
    ("disease IS NOT NULL", "plant_protection"), ("pest IS NOT NULL", "plant_protection"),
    ("fertilizer IS NOT NULL", "fertilization"), ("cultivar IS NOT NULL", "variety")]
    + [(" OR ".join(f"contains(text, {quote(w)})" for w in ws), d) for d, ws in
       V.DOMAIN_KEYWORDS]) + " ELSE 'general' END"


@query("chunk_records", _ENT + f""", {_ASKED}, e AS (SELECT a.doc_id, a.text, d.source, d.lang,
  """ + ", ".join(f"max(CASE WHEN slot = '{s}' THEN canonical END) AS {s}" for s in _SLOTS) + f"""
  FROM asked a JOIN documents d ON d.doc_id = a.doc_id LEFT JOIN ds ON ds.id = a.doc_id
  GROUP BY 1, 2, 3, 4)
SELECT doc_id AS chunk_id, source AS document_id, lang AS language, source AS title,
  {_DOMAIN} AS domain, CASE doc_id % 3 WHEN 0 THEN 'faq' WHEN 1 THEN 'literature'
  ELSE 'document' END AS source_type FROM e""")
def chunk_records(spark, sf_dir):
    docs = documents(spark, sf_dir).drop("text").withColumnRenamed("chunk_id", "doc_id")
    i = F.col("doc_id") % 3
    raw = _asked(spark, sf_dir).join(docs, "doc_id").withColumns({
        "provenance": F.when(i == 0, "legacy_faq").when(i == 1, "legacy_lit_salvage")
        .otherwise("other"), "block_type": F.lit("text")}).withColumnRenamed("doc_id", "chunk_id")
    words = T.dictionary(T.entity_keys(terms(spark)))
    return T.chunk_records(raw, words).select("chunk_id", "document_id", "language", "title",
                                              "domain", "source_type")


def _semantic(spark, sf_dir):
    words = T.dictionary(T.entity_keys(terms(spark)))
    pairs = [(a, c) for cat, _, _, a, c in TERMS if cat == "symptom"]
    return semantic_parse(_asked(spark, sf_dir), words, pairs)


_HIT = {k: " OR ".join(names) for k, names in
        (("c", V.COMPLEX_FLAGS), ("r", V.EVIDENCE_FLAGS))}


@query("route_decision", _ENT + f""", {_FLAGS}, e AS (SELECT DISTINCT id FROM ds WHERE slot IN
  ('disease', 'pest'))
SELECT doc_id, CASE WHEN {_HIT['c']} OR intent IN {_in(V.TOOL_INTENTS)} THEN 'COMPLEX_TASK'
  WHEN {_HIT['r']} OR intent IN {_in(V.EVIDENCE_INTENTS)} OR e.id IS NOT NULL THEN 'MUST_RAG'
  ELSE 'SIMPLE' END AS route FROM fl LEFT JOIN e ON e.id = doc_id""")
def route_decision(spark, sf_dir):
    return route(_semantic(spark, sf_dir)).select("doc_id", "route")


@query("semantic_parse", _ENT + f""", {_FLAGS}, st AS (SELECT doc_id, {_STAGE} AS stage FROM asked)
SELECT fl.doc_id, fl.intent, st.stage, d.canonical AS disease,
  ({' OR '.join(V.RISK_FLAGS)}) AS any_risk
FROM fl JOIN st USING (doc_id) LEFT JOIN ds d ON d.id = fl.doc_id AND d.slot = 'disease'""")
def semantic_parse_query(spark, sf_dir):
    s = _semantic(spark, sf_dir)
    risk = F.lit(False)
    for k in V.RISK_FLAGS:
        risk = risk | F.col("semantic.risk_features")[k]
    return s.select("doc_id", F.col("semantic.intent").alias("intent"),
                    F.col("semantic.growth_stage").alias("stage"),
                    F.col("semantic.entities")["disease"].alias("disease"),
                    risk.alias("any_risk"))


@query("evidence_gate", f"""WITH {_FLAGS} SELECT doc_id, (intent IN {_in(V.GATE_INTENTS)}
  OR {_HIT['r']} OR (weather_dependent AND intent NOT IN {_in(V.TOOL_INTENTS)}))
  AND doc_id % 5 <> 0 AND NOT (doc_id % 2 = 0 AND doc_id % 3 > 0) AS must_search FROM fl""")
def evidence_gate(spark, sf_dir):
    s, i = _semantic(spark, sf_dir), F.col("doc_id")
    sem = F.col("semantic")
    return s.select("doc_id", G.needs_evidence(
        sem["intent"], sem["secondary_intents"], sem["risk_features"], i % 5 == 0, i % 2 == 0,
        i % 3).alias("must_search"))


# --- model output --------------------------------------------------------------------------------


def _model_text(spark, sf_dir):
    """Events as model answers: a JSON object, fenced, with chatter around it, or broken."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    intents = F.array(*[F.lit(x) for x in ("irrigation_decision", "harvest", " pruning ", "fly")])
    body = F.to_json(F.struct(
        F.get(intents, (i % 4).cast("int")).alias("intent"),
        F.array(F.lit("harvest"), F.lit("nope"), F.lit("harvest")).alias("secondary_intents"),
        F.struct(F.lit(" leaf ").alias("cultivar"), F.lit("").alias("pest")).alias("entities"),
        F.when(i % 2 == 0, "flowering").otherwise("later").alias("growth_stage"),
        F.array(F.lit("leaf"), F.lit("wing")).alias("plant_parts")))
    return e.select("event_id", F.when(i % 5 == 0, F.concat(F.lit("```json\n"), body,
                                                            F.lit("\n```")))
                    .when(i % 5 == 1, F.concat(F.lit("Sure: "), body, F.lit(" ok")))
                    .when(i % 5 == 2, F.concat(F.lit("{broken "), body))
                    .when(i % 5 == 3, F.lit("no object")).otherwise(body).alias("answer"))


@query("clean_semantic", """SELECT event_id, CASE WHEN event_id % 5 IN (2, 3) THEN 'unknown'
  ELSE list_extract(['irrigation', 'harvest', 'pruning', 'unknown'],
    CAST(event_id % 4 AS INTEGER) + 1) END AS intent,
  CASE WHEN event_id % 5 IN (2, 3) THEN '' ELSE 'harvest' END AS secondary,
  CASE WHEN event_id % 5 IN (2, 3) THEN NULL ELSE 'leaf' END AS cultivar,
  CAST(NULL AS VARCHAR) AS pest, CASE WHEN event_id % 5 IN (2, 3) OR event_id % 2 = 1
    THEN 'unknown' ELSE 'flowering' END AS stage,
  CASE WHEN event_id % 5 IN (2, 3) THEN '' ELSE 'leaf' END AS parts FROM events""")
def clean_semantic(spark, sf_dir):
    s = _model_text(spark, sf_dir).select("event_id", G.clean_semantic("answer").alias("s"))
    return s.select("event_id", "s.intent", F.concat_ws(",", "s.secondary_intents")
                    .alias("secondary"), "s.entities.cultivar", "s.entities.pest",
                    F.col("s.growth_stage").alias("stage"),
                    F.concat_ws(",", "s.plant_parts").alias("parts"))


@query("parse_description", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
  ELSE 'plain ' || event_type END AS description, CASE WHEN event_id % 3 = 0 THEN
  event_type || chr(10) || '图中文字：' || user_id ELSE 'plain ' || event_type END AS text
FROM events""")
def parse_description(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(
        F.col("event_type").alias("description"),
        F.col("user_id").cast("string").alias("text_in_image")))).otherwise(
        F.concat(F.lit("plain "), "event_type"))
    d = e.select("event_id", J.parse_description(raw).alias("i"))
    return d.select("event_id", "i.description", J.describe_to_text(F.col("i")).alias("text"))


@query("parse_steps", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type END AS tool,
  CASE event_id % 4 WHEN 1 THEN 'done ' || user_id END AS final_answer,
  CASE event_id % 4 WHEN 2 THEN 'task_create' END AS pending_tool,
  CASE WHEN event_id % 4 = 3 THEN 'error' ELSE 'ok' END AS status FROM events""")
def parse_steps(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    call = F.to_json(F.struct(F.struct(F.col("event_type").alias("tool"),
                                       F.struct("user_id").alias("args")).alias("action")))
    final = F.to_json(F.struct(F.concat(F.lit(" done "), F.col("user_id").cast("string"))
                               .alias("final_answer")))
    wait = F.concat(F.lit(V.PENDING_PREFIX), F.to_json(F.struct(
        F.lit("task_create").alias("tool"), F.struct("user_id").alias("args"))))
    log = (F.when(i % 4 == 0, call).when(i % 4 == 1, final).when(i % 4 == 2, wait)
           .otherwise("工具不存在: x"))
    s = e.select("event_id", log.alias("log")).select(
        "event_id", J.parse_step(F.when(~F.col("log").startswith(V.PENDING_PREFIX), F.col("log")))
        .alias("s"), J.parse_pending("log").alias("p"), J.call_status("log").alias("status"))
    return s.select("event_id", F.col("s.tool").alias("tool"), "s.final_answer",
                    F.col("p.tool").alias("pending_tool"), "status")


@query("judge_scores", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.5 + event_id % 5 / 10.0
  WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS score FROM events""")
def judge_scores(spark, sf_dir):
    i = F.col("event_id")
    text = (F.when(i % 4 == 0, F.concat(F.lit("score: 0."), (5 + i % 5).cast("string")))
            .when(i % 4 == 1, "I say 1.0!").when(i % 4 == 2, "12 no, 0").otherwise("7 of 10"))
    return table(spark, sf_dir, "events").select("event_id", J.judge_score(text).alias("score"))
