"""JSON objects inside model output and tool messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .text import let, strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def json_object_text(col) -> Column:
    """Text of the JSON object in a message (fenced or bare), NULL when there is no valid one."""
    c = F.coalesce(_c(col), F.lit(""))
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    text = F.when(fenced != "", fenced).otherwise(bare)
    return F.when((text != "") & F.try_parse_json(text).isNotNull(), text)


def extract_json(col, schema) -> Column:
    return F.from_json(json_object_text(col), schema)


def _field(parsed: Column, name: str) -> Column:
    return F.trim(F.coalesce(parsed[name], F.lit("")))


def parse_description(col) -> Column:
    """Image description struct; text that is no JSON becomes the description (first 500)."""
    names = ("description", "text_in_image", "agricultural_semantics")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = F.substring(strip(F.coalesce(_c(col), F.lit(""))), 1, 500)
    return let(extract_json(col, schema), lambda parsed: F.when(parsed.isNull(), F.struct(raw.alias(names[0]), F.lit("").alias(names[1]),
                                            F.lit("").alias(names[2]))).otherwise(
        F.struct(*[_field(parsed, n).alias(n) for n in names])))


def describe_to_text(info: Column) -> Column:
    """The three parts of an image description as indexable lines."""
    seen, meaning = V.IMAGE_TEXT_LABELS
    parts = [F.nullif(info["description"], F.lit("")),
             F.concat(F.lit(seen), F.nullif(info["text_in_image"], F.lit(""))),
             F.concat(F.lit(meaning), F.nullif(info["agricultural_semantics"], F.lit("")))]
    return strip(F.concat_ws("\n", *parts))


def parse_step(col) -> Column:
    """One step of a tool log: a tool call, a final answer, or NULL."""
    schema = T.StructType([
        T.StructField("action", T.StructType([T.StructField("tool", T.StringType()),
                                              T.StructField("args", T.StringType())])),
        T.StructField("final_answer", T.StringType())])
    return let(extract_json(col, schema), _step)


def _step(p: Column) -> Column:
    answer = F.nullif(strip(p["final_answer"]), F.lit(""))
    none = F.lit(None).cast("string")
    return (F.when(p["action"]["tool"].isNotNull(),
                   F.struct(p["action"]["tool"].alias("tool"),
                            F.coalesce(p["action"]["args"], F.lit("{}")).alias("args"),
                            none.alias("final_answer")))
            .when(answer.isNotNull(), F.struct(none.alias("tool"), none.alias("args"),
                                               answer.alias("final_answer"))))


def parse_pending(col) -> Column:
    """Tool and arguments of an observation that waits for confirmation, else NULL."""
    c = _c(col)
    body = F.substring(c, F.lit(len(V.PENDING_PREFIX) + 1), F.length(c))
    parsed = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body),
                         "tool string, args string")
    return F.when(c.startswith(V.PENDING_PREFIX), parsed)


def call_status(col) -> Column:
    """``ok`` or ``error`` from the first words of an observation."""
    c, bad = F.coalesce(_c(col), F.lit("")), F.lit(False)
    for p in V.ERROR_OBSERVATION_PREFIXES:
        bad = bad | c.startswith(p)
    return F.when(bad, "error").otherwise("ok")


def judge_score(col) -> Column:
    """First ``0``, ``0.d``, ``1`` or ``1.0`` standing alone."""
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), V.JUDGE_SCORE, 1).try_cast("double")


def citations(answer, provided) -> Column:
    """Ids cited as ``[id]`` that were supplied, in order of first citation."""
    found = F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(V.CITATION), F.lit(1))
    given = _c(provided)
    return F.filter(F.array_distinct(found), lambda x: F.array_contains(given, x))
