"""Labels from text: codes, growth stage, intent, risk flags, route.  Column expressions only.

Inputs named ``value`` are texts that went through ``normalize_text``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .json_text import json_object_text
from .text import contains_any, let, strip

NO_TEXTS = "array<string>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE WHEN over ordered (condition, value) pairs."""
    if not pairs:
        return default
    case = F.when(*pairs[0])
    for cond, val in pairs[1:]:
        case = case.when(cond, val)
    return case.otherwise(default)


def _code(value: Column, patterns: list[str], prefix: str) -> Column:
    found = F.coalesce(*[F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in patterns])
    return F.concat(F.lit(prefix + "_"), found.cast("decimal(38,0)").cast("string"))


def orchard_code(value) -> Column:
    return _code(_c(value), V.ORCHARD_PATTERNS, "ORCHARD")


def plot_code(value) -> Column:
    return _code(_c(value), V.PLOT_PATTERNS, "PLOT")


def growth_stage(value) -> Column:
    """Stage of the longest term that occurs; ties keep list order; no case folding."""
    v = _c(value)
    terms = sorted(V.STAGE_TERMS, key=lambda t: -len(t[0]))
    return first_case([(F.contains(v, F.lit(t)), F.lit(s)) for t, s in terms], F.lit("unknown"))


def clean_stage(col) -> Column:
    s = strip(F.coalesce(_c(col), F.lit("")))
    return F.when(s.isin(*V.GROWTH_STAGES), s).otherwise("unknown")


def _matches(value: Column, lowered: Column, pattern: str) -> Column:
    """``value.rlike(pattern)``, tried only where the text holds the words that the pattern needs."""
    hit = value.rlike(pattern)
    for words in reversed(V.NEEDS.get(pattern, ())):
        hit = contains_any(lowered, words) & hit
    return hit


def rule_intent(value) -> Column:
    """First rule group with a hit, else ``unknown``."""
    v = _c(value)

    def cases(low):
        return first_case([(functools.reduce(Column.__or__, [_matches(v, low, p) for p in ps]),
                            F.lit(name)) for name, ps in V.RULE_INTENTS], F.lit("unknown"))
    return let(F.lower(v), cases)


def clean_intent(col) -> Column:
    s = strip(F.coalesce(_c(col), F.lit("")))
    for alias, name in V.INTENT_ALIASES.items():
        s = F.when(s == alias, name).otherwise(s)
    return F.when(s.isin(*V.INTENTS), s).otherwise("unknown")


def clean_secondary(arr) -> Column:
    a = F.coalesce(_c(arr), F.array().cast(NO_TEXTS))
    return F.filter(F.array_distinct(F.transform(a, clean_intent)), lambda x: x != "unknown")


def risk_features(value, intent=None) -> Column:
    """Struct of the eight risk flags, from the text and, where known, the intent."""
    v = _c(value)
    i = F.lit("unknown") if intent is None else F.coalesce(_c(intent), F.lit("unknown"))

    def flags(low):
        found = {
            "diagnosis_requested": i.isin(*V.DIAGNOSIS_INTENTS) | _matches(v, low, V.DIAGNOSIS),
            "dosage_requested": _matches(v, low, V.DOSE),
            "pesticide_related": _matches(v, low, V.PESTICIDE),
            "regulation_related": _matches(v, low, V.REGULATION),
            "weather_dependent": _matches(v, low, V.WEATHER),
            "realtime_data_required": _matches(v, low, V.REALTIME),
            "domain_knowledge_required": i.isin(*V.KNOWLEDGE_INTENTS),
            "business_action_required": i.isin(*V.BUSINESS_WRITE_INTENTS)
            | _matches(v, low, V.BUSINESS_ACTION),
        }
        return F.struct(*[found[k].alias(k) for k in V.RISK_FLAGS])
    return let(F.lower(v), flags)


def merge_risks(*layers) -> Column:
    """OR of flag structs; missing layers and flags count as false."""
    def flag(k):
        out = F.lit(False)
        for layer in layers:
            out = out | F.coalesce(_c(layer)[k], F.lit(False))
        return out.alias(k)
    return F.struct(*[flag(k) for k in V.RISK_FLAGS])


def symptoms(value, terms: list[tuple[str, str]]) -> Column:
    """Canonical names of all symptom aliases that occur, in dictionary order."""
    v = _c(value)
    if not terms:
        return F.array().cast(NO_TEXTS)
    hits = F.array(*[F.when(F.contains(v, F.lit(a)), F.lit(c)) for a, c in terms])
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


_MODEL_SCHEMA = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("secondary_intents", T.ArrayType(T.StringType())),
    T.StructField("entities", T.StructType(
        [T.StructField(s, T.StringType()) for s in V.ENTITY_SLOTS])),
    T.StructField("growth_stage", T.StringType()),
    T.StructField("plant_parts", T.ArrayType(T.StringType())),
    T.StructField("symptoms", T.ArrayType(T.StringType())),
    T.StructField("environment", T.StructType(
        [T.StructField(s, T.StringType()) for s in V.ENVIRONMENT_KEYS])),
    T.StructField("risk_features", T.StructType(
        [T.StructField(s, T.StringType()) for s in V.RISK_FLAGS])),
])


def clean_semantic(col) -> Column:
    """Model output as a typed struct: unknown keys dropped, texts trimmed, lists filtered."""
    return let(F.from_json(json_object_text(col), _MODEL_SCHEMA), _clean_parsed)


def _clean_parsed(p: Column) -> Column:
    def text(c):
        return F.nullif(strip(c), F.lit(""))

    def texts(c):
        a = F.coalesce(c, F.array().cast(NO_TEXTS))
        return F.filter(F.transform(a, text), lambda x: x.isNotNull())

    def true(c):
        return ~F.coalesce(c, F.lit("")).isin("", "false", "0", "0.0", "null", "[]", "{}")

    parts = F.filter(texts(p["plant_parts"]), lambda x: x.isin(*V.PLANT_PARTS))
    return F.struct(
        strip(F.coalesce(p["language"], F.lit(""))).alias("language"),
        clean_intent(p["intent"]).alias("intent"),
        clean_secondary(p["secondary_intents"]).alias("secondary_intents"),
        F.struct(*[text(p["entities"][s]).alias(s) for s in V.ENTITY_SLOTS]).alias("entities"),
        clean_stage(p["growth_stage"]).alias("growth_stage"),
        parts.alias("plant_parts"), texts(p["symptoms"]).alias("symptoms"),
        F.struct(*[text(p["environment"][s]).alias(s) for s in V.ENVIRONMENT_KEYS])
        .alias("environment"),
        F.struct(*[true(p["risk_features"][s]).alias(s) for s in V.RISK_FLAGS])
        .alias("risk_features"))


def _listing(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def _on(items) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def route(intent, secondary, risks, entities) -> Column:
    """Struct ``(route, reason)``.  ``entities`` is the slot -> name map."""
    intent = F.coalesce(_c(intent), F.lit("unknown"))
    labels = F.concat(F.array(intent), F.coalesce(_c(secondary), F.array().cast(NO_TEXTS)))
    risks, entities = _c(risks), _c(entities)

    def flags(names):
        return _on([F.when(risks[n], F.lit(n)) for n in names])

    def among(names):
        return F.filter(labels, lambda x: x.isin(*names))

    slots = _on([F.when(F.coalesce(entities[s], F.lit("")) != "", F.lit(s))
                 for s in ("disease", "pest")])
    steps = [("COMPLEX_TASK", "complex_flags", flags(V.COMPLEX_FLAGS)),
             ("COMPLEX_TASK", "tool_intents", among(V.TOOL_INTENTS)),
             ("MUST_RAG", "evidence_flags", flags(V.EVIDENCE_FLAGS)),
             ("MUST_RAG", "evidence_intents", among(V.EVIDENCE_INTENTS)),
             ("MUST_RAG", "entities", slots)]

    def decide(name, key, shown):
        pre, post = V.ROUTE_REASONS[key]
        return F.struct(F.lit(name).alias("route"),
                        F.concat(F.lit(pre), shown, F.lit(post)).alias("reason"))

    return first_case([(F.size(hit) > 0, decide(name, key, _listing(hit)))
                       for name, key, hit in steps], decide("SIMPLE", "simple", intent))


def professional(intent, secondary, risks) -> Column:
    """Does the request lead to a professional conclusion that needs evidence?"""
    intent, risks = F.coalesce(_c(intent), F.lit("unknown")), _c(risks)
    flagged = F.lit(False)
    for f in V.EVIDENCE_FLAGS:
        flagged = flagged | risks[f]
    return (intent.isin(*V.GATE_INTENTS)
            | F.exists(F.coalesce(_c(secondary), F.array().cast(NO_TEXTS)),
                       lambda x: x.isin(*V.GATE_INTENTS))
            | flagged | (risks["weather_dependent"] & ~intent.isin(*V.TOOL_INTENTS)))


def needs_evidence(intent, secondary, risks, forced, sufficient, n_docs) -> Column:
    """Must evidence be fetched before answering?  At most once per request."""
    ok = F.coalesce(_c(sufficient), F.lit(False)) & (F.coalesce(_c(n_docs), F.lit(0)) > 0)
    return professional(intent, secondary, risks) & ~F.coalesce(_c(forced), F.lit(False)) & ~ok


def infer_domain(value, entities) -> Column:
    """Domain of a chunk: entity slot first, then the first keyword list with a hit."""
    v, e = _c(value), _c(entities)
    pairs = [(F.coalesce(e[s], F.lit("")) != "", F.lit(d)) for s, d in V.DOMAIN_BY_SLOT]
    for domain, words in V.DOMAIN_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(v, F.lit(w))
        pairs.append((hit, F.lit(domain)))
    return first_case(pairs, F.lit("general"))


def source_type(provenance, block_type, default="document") -> Column:
    p = _c(provenance)
    return first_case(
        [(_c(block_type) == "qa_pair", F.lit("faq"))]
        + [(p == k, F.lit(t)) for k, t in V.SOURCE_TYPE_BY_PROVENANCE.items()], F.lit(default))


def alias_language(alias, category) -> Column:
    a = _c(alias)
    return (F.when(a.rlike("[" + V.THAI + "]"), "th").when(a.rlike("[" + V.CJK + "]"), "zh")
            .when(_c(category) == V.MALAY_CATEGORY, "ms").otherwise("en"))


def normalize_scope(arr) -> Column:
    """Blank entries removed; an empty scope means every orchard."""
    a = F.filter(F.coalesce(_c(arr), F.array().cast(NO_TEXTS)),
                 lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(a) == 0, F.array(F.lit(V.ALL_ORCHARDS))).otherwise(a)
