"""Retrieval, generation, coverage and dialog metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dialog as D
from ..functions.text import strip

DIGITS = 4


def retrieval_metrics(queries: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 10,
                      gold_size: str | None = None) -> DataFrame:
    """hit@1, hit@3, recall@k, MRR and NDCG per query; no gold means zero.

    ``queries``: query_id and any labels.  ``hits``: query_id, chunk_id, rank.  ``gold``:
    query_id, chunk_id.  ``gold_size`` names a query column with the number of gold chunks; then
    ``gold`` may be cut down to the chunks that were hit.
    """
    g = gold.select("query_id", "chunk_id").distinct()
    size = (queries.select("query_id", F.col(gold_size).alias("__n")) if gold_size else
            g.groupBy("query_id").agg(F.count("*").alias("__n")))
    good = hits.join(g, ["query_id", "chunk_id"], "left_semi")
    top = F.col("rank") <= k
    m = good.groupBy("query_id").agg(
        F.min("rank").alias("best"),
        F.count_distinct(F.when(top, F.col("chunk_id"))).alias("found"),
        F.sum(F.when(top, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = [sum(1.0 / math.log2(r + 1) for r in range(1, n + 1)) for n in range(k + 1)]
    idcg = F.element_at(F.array(*map(F.lit, ideal)),
                        F.least(F.col("__n"), F.lit(k)).cast("int") + 1)

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    return (queries.join(size, "query_id", "left").join(m, "query_id", "left").select(
        *queries.columns,
        F.when(F.col("best") == 1, 1.0).otherwise(0.0).alias("hit_at_1"),
        F.when(F.col("best") <= 3, 1.0).otherwise(0.0).alias("hit_at_3"),
        zero(F.col("found") / F.col("__n")).alias("recall_at_k"),
        zero(1.0 / F.col("best")).alias("mrr"),
        zero(F.col("dcg") / idcg).alias("ndcg")))


METRICS = ("hit_at_1", "hit_at_3", "recall_at_k", "mrr", "ndcg")


def metrics_report(per_query: DataFrame, label: str = "language") -> DataFrame:
    """Means per label and overall (label NULL -> ``overall``), with query counts."""
    return (per_query.groupingSets([[label], []], label).agg(
        F.grouping(label).alias("__all"), F.count("*").alias("n_queries"),
        *[F.round(F.avg(m), DIGITS).alias(m) for m in METRICS])
        .select(F.when(F.col("__all") == 1, "overall").otherwise(F.col(label).cast("string"))
                .alias("label"), "n_queries", *METRICS))


def indexed_counts(chunks: DataFrame) -> DataFrame:
    """Indexed units for each of the four coverage types, zero included."""
    kind = F.create_map(*[F.lit(x) for kv in V.COVERAGE_BY_BLOCK.items() for x in kv])[
        F.coalesce("block_type", F.lit("text"))]
    counts = chunks.select(kind.alias("type")).filter("type IS NOT NULL").groupBy("type").agg(
        F.count("*").alias("n"))
    spark = chunks.sparkSession
    types = spark.createDataFrame([(i, t) for i, t in enumerate(V.COVERAGE_TYPES)],
                                  "ord int, type string")
    return types.join(counts, "type", "left").select(
        "type", "ord", F.coalesce("n", F.lit(0)).alias("indexed"))


def load_annotations(df: DataFrame, col: str = "annotations") -> DataFrame:
    """JSON text or map of annotated counts to typed rows ``(type, annotated)``; missing is 0."""
    m = F.col(col)
    if df.schema[col].dataType.typeName() == "string":
        m = F.from_json(m, "map<string,long>")
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.coalesce(m[t].cast("long"), F.lit(0))
                               .alias("annotated")) for t in V.COVERAGE_TYPES])
    return df.select(F.inline(pairs))


def parse_coverage(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Indexed over annotated per type and overall; types without a baseline have no ratio."""
    layers = (indexed_counts(chunks).join(annotations, "type", "left")
              .withColumn("annotated", F.coalesce("annotated", F.lit(0))))
    based = F.col("annotated") > 0
    total = layers.agg(F.sum(F.when(based, F.col("indexed")).otherwise(0)).alias("indexed"),
                       F.sum(F.when(based, F.col("annotated")).otherwise(0)).alias("annotated"))

    def ratio(df, name):
        r = F.when(F.col("annotated") > 0,
                   F.round(F.col("indexed") / F.col("annotated"), DIGITS))
        return df.select(name.alias("type"), "indexed", "annotated", r.alias("coverage"))

    return ratio(layers, F.col("type")).unionByName(ratio(total, F.lit("overall")))


def citation_accuracy(cited, provided) -> Column:
    """Share of citations that were supplied (duplicates count); nothing cited gives 0."""
    c = F.coalesce(F.col(cited), F.array().cast("array<string>"))
    p = F.coalesce(F.col(provided), F.array().cast("array<string>"))
    return F.when(F.size(c) == 0, 0.0).otherwise(
        F.size(F.filter(c, lambda x: F.array_contains(p, x))) / F.size(c))


def evidence_coverage(points, evidence) -> Column:
    """Share of gold points whose words all occur in the evidence texts."""
    p = F.coalesce(F.col(points), F.array().cast("array<string>"))
    joined = F.concat_ws("\n", F.col(evidence))
    words = lambda x: F.filter(F.split(strip(x), V.WS + "+"), lambda w: w != "")
    hit = F.filter(p, lambda x: F.forall(words(x), lambda w: F.contains(joined, w)))
    return F.when(F.size(p) == 0, 0.0).otherwise(F.size(hit) / F.size(p))


def abstention_accuracy(cases: DataFrame) -> DataFrame:
    """Share of cases that abstain exactly when there is no evidence."""
    right = ~F.coalesce("has_evidence", F.lit(False)) == D.is_abstention("answer")
    return cases.agg(F.coalesce(F.avg(right.cast("double")), F.lit(0.0))
                     .alias("abstention_accuracy"), F.count("*").alias("n_cases"))


def generation_report(cases: DataFrame) -> DataFrame:
    """Means of correctness, faithfulness, citation accuracy and evidence coverage.

    ``answer_correctness`` and ``faithfulness`` are judge scores; unscored rows do not count.
    """
    scored = cases.select("answer_correctness", "faithfulness",
                          citation_accuracy("cited_ids", "provided_ids")
                          .alias("citation_accuracy"),
                          evidence_coverage("gold_points", "evidence_texts")
                          .alias("evidence_coverage"))
    return scored.agg(*[F.coalesce(F.round(F.avg(c), DIGITS), F.lit(0.0)).alias(c)
                        for c in scored.columns])


def dialog_success(answers: DataFrame) -> DataFrame:
    """Success rate of requests and failures by type."""
    kinds = answers.groupBy(D.classify_failure("answer").alias("failure")).agg(
        F.count("*").alias("n"))
    total, bad = F.sum("n"), F.sum(F.when(F.col("failure").isNotNull(), F.col("n")).otherwise(0))
    pairs = F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(),
                                               F.struct("failure", "n"))))
    return kinds.agg(
        F.coalesce(total, F.lit(0)).alias("total_requests"),
        F.coalesce(total - bad, F.lit(0)).alias("successful"),
        F.coalesce(F.round((total - bad) / total, DIGITS), F.lit(0.0)).alias("success_rate"),
        F.map_from_entries(pairs).alias("failures_by_type"))


def pick_language(*cols: str) -> Column:
    known = [F.when(F.col(c).isin(*V.LANGUAGES), F.col(c)) for c in cols]
    return F.coalesce(*known, F.lit("zh"))


def derive_difficulty(query, language, cross_lingual, given, aliases: list[str]) -> Column:
    """Cross-language, given difficulty, alias hit, long query, else easy."""
    q = F.col(query)
    low, hit = F.lower(q), F.lit(False)
    for a in aliases:
        if len(a) >= 3:
            hit = hit | F.contains(low, F.lit(a.lower()))
    limit = F.when(F.col(language).isin("zh", "th"), 30).otherwise(60)
    own = F.nullif(strip(F.col(given)), F.lit(""))
    return (F.when(F.coalesce(cross_lingual, F.lit(False)), "Cross-language")
            .when(own.isNotNull(), own).when(hit, "Alias")
            .when(F.length(q) > limit, "Long query").otherwise("Easy"))


def gold_report(gold: DataFrame) -> DataFrame:
    """Counts by language, by intent, by difficulty and in total."""
    dims = ["language", "intent", "difficulty"]
    g = gold.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.count("*").alias("n"), F.grouping_id(*dims).alias("gid"))
    kind = (F.when(F.col("gid") == 3, "language").when(F.col("gid") == 5, "intent")
            .when(F.col("gid") == 6, "difficulty").otherwise("total"))
    return g.select(kind.alias("dimension"),
                    F.coalesce("language", "intent", "difficulty", F.lit("all")).alias("value"),
                    "n")
