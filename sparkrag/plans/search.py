"""Search over a table of queries: four-way recall, fusion, rerank, evidence, bounded retry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import number_texts, strip
from ..operators import fusion
from ..operators.bm25 import BM25Index, bm25_index, bm25_search
from ..operators.dense import dense_search
from ..operators.evidence import check_evidence
from ..operators.metrics import metrics_report, retrieval_metrics
from ..operators.permissions import visible
from ..operators.tagging import build_queries
from ..sources.stage import staged

_ACL = ("tenant_id", "role_scope", "orchard_scope")


@dataclass
class SearchSetup:
    """What a search needs: the corpus, its indexes, the dictionary and the model hooks.

    ``records``: chunk_id, document_id, text, vec (when dense), tenant_id, role_scope,
    orchard_scope (when scoped).  ``embed`` is ``(df, text column, output column) -> df``.
    ``relevance`` is a column over query text and passage for the reranker.
    """

    records: DataFrame
    words: list = field(default_factory=list)
    aliases: dict = field(default_factory=dict)
    thai: tuple = ()
    embed: Callable | None = None
    relevance: Callable[[Column, Column], Column] | None = None
    scoped: bool = False
    index: BM25Index | None = None

    def bm25(self) -> BM25Index:
        if self.index is None:
            keep = _ACL if self.scoped else ()
            self.index = bm25_index(self.records, "text", self.thai, keep)
        return self.index


def four_way_recall(queries: DataFrame, s: SearchSetup, k: int = 10) -> DataFrame:
    """Hits ``(query_id, route, chunk_id, score, rank)`` of the four routes.

    ``queries``: query_id, text, and with ``scoped`` tenant_id, role, orchard_scope.  The row
    permission holds in every route; BM25 statistics come from the whole corpus.
    """
    scope = ["tenant_id", "role", "orchard_scope"] if s.scoped else []
    q = build_queries(queries, s.words, s.aliases)

    def stack(*routes):
        pairs = F.array(*[F.struct(F.lit(r).alias("route"), F.col(c).alias("q"))
                          for r, c in routes])
        return q.select("query_id", *scope, F.inline(pairs)).filter("q <> ''")

    lexical = stack(("bm25_original", "original"), ("bm25_expanded", "expanded"))
    rule, carry = None, ()
    if s.scoped:
        lexical = lexical.select("query_id", "route", "q", F.col("tenant_id").alias("__qt"),
                                 F.col("role").alias("__qr"),
                                 F.col("orchard_scope").alias("__qo"))
        carry = ("__qt", "__qr", "__qo")
        rule = visible(*[F.col(c) for c in (*_ACL, *carry)])
    hits = bm25_search(lexical, s.bm25(), k, ["query_id", "route"], "q", s.thai, rule, carry)
    if s.embed is not None:
        vectors = s.embed(stack(("dense_original", "original"),
                                ("dense_canonical", "canonical")), "q", "vec")
        hits = hits.unionByName(dense_search(
            vectors, s.records, k, V.DENSE_MIN_SCORE, ["query_id", "route"], scoped=s.scoped))
    return hits


def search(queries: DataFrame, s: SearchSetup, k: int = 10, top: int = V.EVIDENCE_TOP_N
           ) -> tuple[DataFrame, DataFrame]:
    """(documents per query, verdict per query).

    ``queries``: query_id, text, entities, symptoms and, with ``scoped``, the scope columns.  A
    ``query`` column, where present, is what rerank and evidence check read (the text may be a
    rewrite of it).
    """
    fused = fusion.weighted_rrf(four_way_recall(queries, s, k), top_n_docs=top)
    docs = fusion.attach_records(fused, s.records.select("chunk_id", "document_id", "text"))
    query = F.col("query" if "query" in queries.columns else "text")
    if s.relevance is not None:
        asked = queries.select("query_id", query.alias("__q"))
        score = s.relevance(F.col("__q"), fusion.passage("text"))
        docs = fusion.rerank(docs.join(asked, "query_id"), score).drop("__q")
    docs = staged(docs, "docs")
    facts = queries.select("query_id", query.alias("query"), "entities", "symptoms")
    return docs, check_evidence(facts, docs, s.aliases)


def introduces_numbers(original, rewritten) -> Column:
    """Does a rewrite hold a number that the original does not have?"""
    return F.size(F.array_except(number_texts(rewritten), number_texts(original))) > 0


def rewrite_queries(queries: DataFrame, s: SearchSetup, model_col: str | None = None
                    ) -> DataFrame:
    """Replace ``text``: the model rewrite unless empty, unchanged or guarded, else the expanded
    query."""
    built = build_queries(queries, s.words, s.aliases, entities="entities")
    rule = F.coalesce(F.nullif("expanded", F.lit("")), "canonical")
    if model_col:
        m = F.regexp_replace(F.regexp_replace(strip(F.col(model_col)), '^"+|"+$', ""),
                             "^'+|'+$", "")
        use = (m != "") & (m != F.col("text")) & ~introduces_numbers("text", m)
        rule = F.when(use, m).otherwise(rule)
    return built.withColumn("text", rule).select(*queries.columns)


def search_with_retry(queries: DataFrame, s: SearchSetup, max_rounds: int = V.MAX_RETRIEVALS,
                      k: int = 10, model_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Search; rewrite and repeat the queries whose evidence fails, at most ``max_rounds`` times.

    The loop runs over rounds (two by default), each a full job on the failing queries whose
    result is written to the shared folder.  Verdicts carry ``rounds`` and, for queries that end
    without evidence, ``error = RAG_NO_RESULT``.
    """
    if "query" not in queries.columns:
        queries = queries.withColumn("query", F.col("text"))
    open_queries, docs, verdicts = queries, None, None
    for n in range(1, max_rounds + 1):
        d, v = search(open_queries, s, k)
        v = staged(v.withColumn("rounds", F.lit(n)), "verdict")
        last = n == max_rounds
        done = v if last else v.filter("sufficient")
        d = d.join(done.select("query_id"), "query_id", "left_semi")
        docs = d if docs is None else docs.unionByName(d)
        verdicts = done if verdicts is None else verdicts.unionByName(done)
        if not last:
            failing = open_queries.join(v.filter(~F.col("sufficient")).select("query_id"),
                                        "query_id", "left_semi")
            open_queries = staged(rewrite_queries(failing, s, model_col), "retry")
    error = F.when(~F.col("sufficient"), "RAG_NO_RESULT")
    return docs, verdicts.withColumn("error", error)


def evaluate_search(gold: DataFrame, labels: DataFrame, run: Callable[[DataFrame], DataFrame],
                    k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(metrics per query, report per language) of a search function over a gold set.

    ``gold``: query_id, chunk_id.  ``labels``: query_id, language, and what ``run`` reads.
    """
    per_query = retrieval_metrics(labels.select("query_id", "language"), run(labels), gold, k)
    return per_query, metrics_report(per_query)
