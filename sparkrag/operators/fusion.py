"""Ranks, weighted reciprocal rank fusion, reranking and record lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from .prefix import numbered, top_n


def rank_hits(hits: DataFrame) -> DataFrame:
    """1-based rank within (query, route) by score, ties by chunk id; a query may have any number
    of hits."""
    return numbered(hits, ["query_id", "route"], [F.desc("score"), F.asc("chunk_id")], "rank")


def weighted_rrf(hits: DataFrame, weights: dict[str, float] | None = None, k: int = V.RRF_K,
                 top_n_docs: int | None = None) -> DataFrame:
    """Fuse ranked routes: score = sum of weight / (k + rank); unknown routes weigh nothing.

    A chunk listed twice in a route counts once, with its best rank.
    """
    weights = {r: w for r, w in (weights or V.RRF_WEIGHTS).items() if w > 0}
    order = {r: i for i, r in enumerate(weights)}

    def table(d, kind):
        return F.create_map(*[x for r, v in d.items() for x in (F.lit(r), F.lit(v))])[
            F.col("route")].cast(kind)

    best = (hits.filter(F.col("route").isin(*weights)).groupBy("query_id", "route", "chunk_id")
            .agg(F.min("rank").alias("rank")))
    part = F.struct(table(order, "int").alias("o"), F.col("rank").alias("rank"),
                    F.col("route").alias("route"),
                    (table(weights, "double") / (k + F.col("rank"))).alias("s"))
    # At most one entry per route, so the list is as short as the list of routes.
    fused = (best.groupBy("query_id", "chunk_id")
             .agg(F.array_sort(F.collect_list(part)).alias("p"))
             .select("query_id", "chunk_id",
                     F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"]), 12)
                     .alias("score"),
                     F.map_from_entries(F.transform("p", lambda x: F.struct(
                         x["route"], x["rank"].cast("int")))).alias("sources"),
                     F.col("p")[0]["o"].alias("__o"), F.col("p")[0]["rank"].alias("__r")))
    by = [F.desc("score"), F.asc("__o"), F.asc("__r"), F.asc("chunk_id")]
    if top_n_docs is not None:
        out = top_n(fused, ["query_id"], by, top_n_docs, "rrf_rank")
    else:
        w = Window.partitionBy("query_id").orderBy(*by)
        out = fused.withColumn("rrf_rank", F.row_number().over(w))
    return out.select("query_id", "chunk_id", "score", "rrf_rank", "sources")


def attach_records(fused: DataFrame, records: DataFrame) -> DataFrame:
    """Look the records of ranked chunks up; ranks without a record stay."""
    return fused.join(records, "chunk_id", "left")


def rerank(pairs: DataFrame, score: Column, k: int = V.RERANK_TOP_K,
           min_score: float = V.RERANK_MIN_SCORE, rank: str = "rrf_rank") -> DataFrame:
    """Reorder by a relevance score, drop weak rows, keep ``k``; ties keep the earlier order."""
    scored = pairs.withColumn("rerank_score", score).filter(F.col("rerank_score") >= min_score)
    return top_n(scored, ["query_id"], [F.desc("rerank_score"), F.asc(rank)], k, "rerank_rank")


def passage(col) -> Column:
    """The part of a passage that a reranker reads."""
    return F.substring(col, 1, V.RERANK_PASSAGE_CHARS)


def overlap_score(query_tokens, passage_tokens) -> Column:
    """Deterministic stand-in reranker: share of the query tokens found in the passage."""
    q = F.col(query_tokens) if isinstance(query_tokens, str) else query_tokens
    p = F.col(passage_tokens) if isinstance(passage_tokens, str) else passage_tokens
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, p)) / F.size(q))


def evidence_block(docs: DataFrame, rank: str = "rrf_rank") -> DataFrame:
    """One text per query: ``[id] (document) text`` lines in rank order (a bounded list)."""
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] ("),
                    F.coalesce(F.col("document_id").cast("string"), F.lit("?")), F.lit(") "),
                    F.coalesce("text", F.lit("")))
    return docs.groupBy("query_id").agg(F.concat_ws("\n", F.array_sort(
        F.collect_list(F.struct(rank, line.alias("line"))))["line"]).alias("evidence"))


def cited_sources(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Ranked documents whose id the answer cites; ``title`` is the document id."""
    found = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(V.CITATION), F.lit(1))
    cited = answers.select("query_id", F.explode(F.array_distinct(found)).alias("cited"))
    hit = ((docs["query_id"] == cited["query_id"])
           & (docs["chunk_id"].cast("string") == cited["cited"]))
    return docs.join(cited, hit, "left_semi").select(
        "query_id", F.col("document_id"), F.col("chunk_id"),
        F.col("document_id").alias("title"), F.lit("").alias("section"))
