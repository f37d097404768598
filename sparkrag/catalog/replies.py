"""Parsing of model and tool replies over whole texts of the driver, with the fixed part behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialog as D
from ..functions import json_text as J
from ..functions import tagging as G
from ..functions.text import once, spread
from .base import query, table


@query("judge_texts", r"""SELECT doc_id, nullif(regexp_extract(text || ' so 0.7',
  '(?:^|[^\pL\pN_])(0(?:\.[0-9])?|1(?:\.0)?)(?:$|[^\pL\pN_])', 1), '')::DOUBLE AS score FROM documents""")
def judge_texts(spark, sf_dir):
    """The first score that stands alone in a whole text; one stands at its end."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", J.judge_score(F.concat("text", F.lit(" so 0.7"))).alias("score"))


_HINTS = [("the", "harvest", "flowering"), ("der", "irrigation_decision", "fruit_set"),
          ("les", " pruning ", "blooming"), ("que", "no such thing", " seedling ")]


def _hint(column: int):
    out = F.substring("text", 1, 12)
    for word, *values in reversed(_HINTS):
        out = F.when(F.contains("text", F.lit(word)), F.lit(values[column])).otherwise(out)
    return out


def _hint_sql(values: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{v}'" for w, v in values.items()) \
        + " ELSE 'unknown' END"


@query("answer_texts", f"""SELECT doc_id,
  {_hint_sql({'the': 'harvest', 'der': 'irrigation', 'les': 'pruning', 'que': 'unknown'})} AS intent,
  {_hint_sql({'the': 'flowering', 'der': 'fruit_set', 'les': 'unknown', 'que': 'seedling'})} AS stage,
  nullif(trim(substr(text, 1, 30), ' ' || chr(10)), '') AS cultivar,
  CASE WHEN contains(text, 'the') THEN 'harvest' ELSE '' END AS secondary,
  md5(text) AS pest_md5 FROM documents""")
def answer_texts(spark, sf_dir):
    """Model answers that think aloud with a whole text before the JSON, and hold it in a field."""
    d = spread(table(spark, sf_dir, "documents"))
    body = F.to_json(F.struct(
        _hint(0).alias("intent"), F.array(F.when(F.contains("text", F.lit("the")), " harvest ")
                                          .otherwise("noise"), F.lit("unknown"))
        .alias("secondary_intents"), _hint(1).alias("growth_stage"),
        F.struct(F.substring("text", 1, 30).alias("cultivar"),
                 F.concat(F.lit("p"), "text", F.lit("p")).alias("pest")).alias("entities")))
    reply = F.concat(F.regexp_replace("text", "[`{}]", " "), F.lit("\n```json\n"), body, F.lit("\n```"))
    d = once(d, "s", G.clean_semantic(reply))
    pest = F.col("s.entities.pest")
    return d.select("doc_id", "s.intent", F.col("s.growth_stage").alias("stage"),
                    "s.entities.cultivar", F.concat_ws(",", "s.secondary_intents").alias("secondary"),
                    F.md5(F.substr(pest, F.lit(2), F.length(pest) - 2)).alias("pest_md5"))


_ENDS = [("the", " read timed out"), ("der", " context length"), ("les", "：权限不足"),
         ("que", " 参数错误")]


def _failed(spark, sf_dir):
    """Whole texts as error messages; what they say decides how they end."""
    d = table(spark, sf_dir, "documents")
    end = F.lit(" ended")
    for word, said in reversed(_ENDS):
        end = F.when(F.contains("text", F.lit(word)), F.lit(said)).otherwise(end)
    kind = F.when(F.contains("text", F.lit("zu")), "ValueError").otherwise("Failure")
    domain = F.when(F.length("text") % 2 == 0, "tool").otherwise("llm")
    return spread(d).select("doc_id", F.length("text").alias("n"), D.classify_error(
        kind, F.concat(F.regexp_replace("text", "(?i)time|token|context", "t"), end), domain)
        .alias("error"))


_FAILED = """f AS (SELECT doc_id, length(text) AS n, CASE
  WHEN contains(text, 'the') THEN CASE WHEN length(text) % 2 = 0 THEN 'TOOL_TIMEOUT'
    ELSE 'LLM_TIMEOUT' END
  WHEN contains(text, 'der') THEN 'LLM_TOKEN_OVERFLOW'
  WHEN contains(text, 'les') THEN 'TOOL_PERMISSION_DENIED'
  WHEN length(text) % 2 = 0 AND (contains(text, 'que') OR contains(text, 'zu'))
    THEN 'TOOL_INVALID_ARGUMENT'
  WHEN length(text) % 2 = 0 THEN 'TOOL_TIMEOUT' ELSE 'LLM_TIMEOUT' END AS error FROM documents)"""


@query("error_texts", f"""WITH {_FAILED} SELECT doc_id, error, CASE error
  WHEN 'LLM_TIMEOUT' THEN 'LLM' WHEN 'LLM_TOKEN_OVERFLOW' THEN 'LLM' ELSE 'TOOL' END AS side
FROM f""")
def error_texts(spark, sf_dir):
    """Error types of whole texts."""
    return _failed(spark, sf_dir).select("doc_id", "error",
                                         F.substring_index("error", "_", 1).alias("side"))


@query("degrade_texts", f"""WITH {_FAILED} SELECT doc_id, CAST(CASE WHEN error IN ('LLM_TIMEOUT',
    'TOOL_TIMEOUT') THEN n % 5 WHEN error = 'SUMMARY_FAILED' THEN greatest(n % 5, 3)
  ELSE least(n % 5 + 1, 4) END AS INTEGER) AS level FROM f""")
def degrade_texts(spark, sf_dir):
    """The degrade level behind the error that a whole text stands for."""
    return _failed(spark, sf_dir).select(
        "doc_id", D.next_level("error", F.col("n") % 5).cast("int").alias("level"))


@query("strategy_texts", f"""WITH {_FAILED} SELECT doc_id, error = 'LLM_TOKEN_OVERFLOW' AS degrades
FROM f""")
def strategy_texts(spark, sf_dir):
    """Whether the strategy for the error of a whole text gives memory up."""
    return _failed(spark, sf_dir).select("doc_id", D.degrades_memory("error").alias("degrades"))
