"""Evidence check: can the retrieved documents support an answer?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import numbers, once

_NEED = "struct<slot:string,name:string,forms:array<string>>"


def check_evidence(queries: DataFrame, docs: DataFrame, aliases: dict[str, list[str]]
                   ) -> DataFrame:
    """One verdict per query: entities, symptoms, numbers, conflict, single source.

    ``queries``: query_id, query, entities (slot -> name), symptoms.  ``docs``: query_id,
    chunk_id, text.  ``aliases`` maps a canonical name to its other surface forms.
    """
    forms = (F.create_map(*[x for k, v in aliases.items() for x in (
        F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
        if aliases else F.create_map().cast("map<string,array<string>>"))

    def need(slot):
        name = F.col("entities")[slot]
        return F.when(F.coalesce(name, F.lit("")) != "", F.struct(
            F.lit(slot).alias("slot"), name.alias("name"),
            F.transform(F.concat(F.array(name), F.coalesce(
                forms[name], F.array().cast("array<string>"))), F.lower).alias("forms")))

    needs = F.filter(F.array(*[need(s) for s in V.REQUIRED_SLOTS]), lambda x: x.isNotNull())
    asked = F.when(F.col("query").rlike(V.NUMERIC_CONDITION), numbers("query"))
    q = once(queries, "__needs", needs.cast(f"array<{_NEED}>"))
    q = once(q, "__key", F.get(asked, F.lit(0))).select(
        "query_id", F.col("__needs").alias("needs"),
        F.coalesce("symptoms", F.array().cast("array<string>")).alias("symptoms"),
        F.col("__key").alias("key"))

    body = F.coalesce("text", F.lit(""))
    d = once(once(docs, "t", F.lower(body)), "nums", numbers(body)).select(
        "query_id", "chunk_id", "t", "nums")
    near = F.exists("nums", lambda n: F.abs(n - F.col("key")) <= F.greatest(
        F.lit(0.5), F.abs(F.col("key")) * 0.05))
    j = q.join(d, "query_id", "left").select(
        "query_id", "needs", "symptoms", "key", "chunk_id",
        F.transform("needs", lambda n: F.exists(n["forms"], lambda f: F.contains(F.col("t"), f)))
        .alias("met"),
        F.filter("symptoms", lambda s: F.contains(F.col("t"), F.lower(s))).alias("seen"),
        (F.size("nums") > 0).alias("has_num"), near.alias("near"))
    top = len(V.REQUIRED_SLOTS)
    g = j.groupBy("query_id").agg(
        F.any_value("needs").alias("needs"), F.any_value("symptoms").alias("symptoms"),
        F.any_value("key").alias("key"), F.count("chunk_id").alias("n"),
        F.array(*[F.coalesce(F.bool_or(F.get("met", F.lit(i))), F.lit(False))
                  for i in range(top)]).alias("met"),
        F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"),
        F.count_if("has_num").alias("n_num"),
        F.coalesce(F.bool_or(F.col("has_num") & F.col("near")), F.lit(False)).alias("near"))

    conflict = (F.col("key").isNotNull() & (F.col("n_num") >= 2) & ~F.col("near"))
    entity = F.filter(F.transform("needs", lambda n, i: F.when(
        ~F.get("met", i), F.concat(F.lit(V.REASON_ENTITY), n["slot"], F.lit("="), n["name"]))),
        lambda x: x.isNotNull())
    symptom = F.transform(F.filter("symptoms", lambda s: ~F.array_contains("seen", s)),
                          lambda s: F.concat(F.lit(V.REASON_SYMPTOM), s))
    rest = F.filter(F.array(
        F.when(F.col("key").isNotNull() & (F.col("n_num") == 0), V.REASON_NO_NUMBER),
        F.when(conflict, F.concat(F.lit(V.REASON_CONFLICT[0]), F.col("key").cast("string"),
                                  F.lit(V.REASON_CONFLICT[1]))),
        F.when((F.col("n") < V.MIN_EVIDENCE_DOCS) & ~conflict,
               F.concat(F.lit(V.REASON_SINGLE[0]), F.col("n").cast("string"),
                        F.lit(V.REASON_SINGLE[1])))), lambda x: x.isNotNull())
    reasons = F.when(F.col("n") == 0, F.array(F.lit(V.REASON_NO_EVIDENCE))).otherwise(
        F.concat(entity, symptom, rest))
    return g.select("query_id", (F.size(reasons) == 0).alias("sufficient"),
                    reasons.alias("reasons"), F.col("n").alias("evidence_count"),
                    (F.col("n") > 0).__and__(conflict).alias("entity_conflict"))
