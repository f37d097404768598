"""Semantic parse of a table of queries, and the route decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import tagging as G
from ..functions.text import normalize_query, once
from ..operators.tagging import detect_entities


def semantic_parse(df: DataFrame, words, symptom_terms, text: str = "text",
                   model_col: str | None = None) -> DataFrame:
    """Add ``normalized`` and ``semantic``: rules, merged with model output where there is some.

    Model intent wins when valid; rule entities override; the stage is model first; flags are OR.
    """
    df = once(df, "normalized", normalize_query(text))
    df = detect_entities(df, words, "normalized", "__rule", normalized=True)
    df = once(df, "__m", G.clean_semantic(
        F.col(model_col) if model_col else F.lit(None).cast("string")))
    m, v, known = F.col("__m"), F.col("normalized"), F.col("__m.intent") != "unknown"
    intent = F.when(known, m["intent"]).otherwise(G.rule_intent(v))
    df = once(df, "__intent", intent)  # each flag reads it
    df = once(df, "__risks", G.risk_features(v, F.col("__intent")))
    slots = F.map_from_entries(F.array(*[F.struct(F.lit(s).alias("k"), F.coalesce(
        F.col("__rule")[s], m["entities"][s]).alias("v")) for s in V.ENTITY_SLOTS]))
    stage = F.when(m["growth_stage"] != "unknown", m["growth_stage"]).otherwise(G.growth_stage(v))
    found = F.array_distinct(F.concat(m["symptoms"], G.symptoms(v, symptom_terms)))
    none = F.array().cast("array<string>")
    semantic = F.struct(
        m["language"].alias("language"), F.col("__intent").alias("intent"),
        F.when(known, m["secondary_intents"]).otherwise(none).alias("secondary_intents"),
        slots.alias("entities"), stage.alias("growth_stage"),
        m["plant_parts"].alias("plant_parts"), found.alias("symptoms"),
        m["environment"].alias("environment"),
        G.merge_risks(m["risk_features"], "__risks").alias("risk_features"))
    return df.withColumn("semantic", semantic).drop("__rule", "__m", "__intent", "__risks")


def route(df: DataFrame, col: str = "semantic") -> DataFrame:
    """Add ``route`` and ``route_reason``."""
    s = F.col(col)
    r = G.route(s["intent"], s["secondary_intents"], s["risk_features"], s["entities"])
    return df.withColumn("__r", r).withColumns(
        {"route": F.col("__r.route"), "route_reason": F.col("__r.reason")}).drop("__r")
