"""BM25, cosine, fusion, rerank, evidence, permissions and search over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import multilingual_tokens, normalize_text, once, spread, with_tokens
from ..models import embed_with_hash, hash_embed
from ..operators import fusion
from ..operators import tagging as T
from ..operators.bm25 import BM25Index, bm25_index, bm25_search, idf
from ..operators.dense import dense_search
from ..operators.evidence import check_evidence
from ..operators.metrics import metrics_report, retrieval_metrics
from ..operators.permissions import allowed_tools, request_context, scope_filter
from ..operators.quotes import quoted_pairs
from ..plans.search import SearchSetup, evaluate_search, four_way_recall, introduces_numbers
from ..plans.search import rewrite_queries, search, search_with_retry
from ..sources.stage import staged
from .base import TERMS, TERMS_SQL, bm25_sql, documents, items, query, table, terms, tokens_sql

_TOK = (tokens_sql("dt", "documents", "doc_id") + ","
        + tokens_sql("qt", "benchmark", "item_id") + "," + bm25_sql("bm", "dt", "qt"))


@query("bm25_topk", f"""WITH {_TOK}
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM bm) WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    index = bm25_index(documents(spark, sf_dir))
    hits = bm25_search(items(spark, sf_dir), index, 5)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_term_stats", f"""WITH {tokens_sql("dt", "documents", "doc_id")}
SELECT term, count(*) AS df, round(ln(1.0 + ((SELECT count(*) FROM documents) - count(*) + 0.5)
  / (count(*) + 0.5)), 6) AS idf FROM dt GROUP BY term""")
def bm25_term_stats(spark, sf_dir):
    index = bm25_index(documents(spark, sf_dir))
    n = index.stats().select("n_docs").scalar()
    return index.terms().select("term", "df", F.round(idf(n, F.col("df")), 6).alias("idf"))


@query("multilingual_tokens", f"""WITH {tokens_sql("dt", "documents", "doc_id")}
SELECT d.doc_id, count(t.term) AS n_tokens, coalesce(md5(string_agg(t.term, ' ' ORDER BY t.term)),
  md5('')) AS tokens_md5 FROM documents d LEFT JOIN dt t ON t.id = d.doc_id GROUP BY d.doc_id""")
def tokens(spark, sf_dir):
    df = with_tokens(spread(table(spark, sf_dir, "documents")), "text", "t")
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                     F.md5(F.concat_ws(" ", F.array_sort("t"))).alias("tokens_md5"))


_NEAR = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS ql,
  b.label AS cl, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)
  AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, chunk_id) AS rank FROM pairs {floor}) WHERE rank <= 10)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    corpus = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), corpus


@query("dense_topk", "WITH " + _NEAR.format(floor="WHERE score >= 0.3")
       + " SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"
       + " FROM top")
def dense_topk(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    hits = dense_search(q, c, 10, V.DENSE_MIN_SCORE, exclude_self="query_id")
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_METRIC = "WITH " + _NEAR.format(floor="") + """,
size AS (SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a JOIN embeddings b
  ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1),
g AS (SELECT query_id, min(rank) AS best, count(*) AS found, sum(1.0 / log2(rank + 1)) AS dcg
  FROM top WHERE ql = cl GROUP BY 1),
ideal AS (SELECT k, sum(1.0 / log2(r + 1)) AS idcg FROM range(1, 11) a(k), range(1, 11) b(r)
  WHERE r <= k GROUP BY k),
m AS (SELECT e.vec_id AS query_id, e.label, CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END AS hit_at_1,
  CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END AS hit_at_3,
  coalesce(found / n, 0.0) AS recall_at_k, coalesce(1.0 / best, 0.0) AS mrr,
  coalesce(dcg / idcg, 0.0) AS ndcg
  FROM embeddings e LEFT JOIN size ON size.query_id = e.vec_id
  LEFT JOIN g ON g.query_id = e.vec_id LEFT JOIN ideal ON k = least(n, 10))
"""


def _metrics(spark, sf_dir):
    q, c = _vectors(spark, sf_dir)
    hits = staged(dense_search(q, c, 10, None, exclude_self="query_id"), "hits")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    # Gold (same label) stays a label: pairing all members of a label would be quadratic.
    other = e.select(F.col("query_id").alias("chunk_id"), F.col("label").alias("chunk_label"))
    gold = (hits.join(e, "query_id").join(other, "chunk_id")
            .filter("label = chunk_label").select("query_id", "chunk_id"))
    size = e.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    return hits, gold, e.join(size, "label")


def _per_query(spark, sf_dir):
    hits, gold, q = _metrics(spark, sf_dir)
    return retrieval_metrics(q, hits, gold, 10, gold_size="n_gold").drop("n_gold")


_ROUND = ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}"
                   for m in ("hit_at_1", "hit_at_3", "recall_at_k", "mrr", "ndcg"))


@query("retrieval_metrics", _METRIC + f"SELECT query_id, label, {_ROUND} FROM m")
def retrieval_metrics_query(spark, sf_dir):
    m = _per_query(spark, sf_dir)
    return m.select("query_id", "label", *[F.round(c, 6).alias(c) for c in (
        "hit_at_1", "hit_at_3", "recall_at_k", "mrr", "ndcg")])


@query("metrics_by_label", _METRIC + """
SELECT CASE WHEN grouping(label) = 1 THEN 'overall' ELSE CAST(label AS VARCHAR) END AS label,
  count(*) AS n_queries, """ + ", ".join(
    f"round(CAST(avg({m}) AS DOUBLE), 4) AS {m}"
    for m in ("hit_at_1", "hit_at_3", "recall_at_k", "mrr", "ndcg"))
    + " FROM m GROUP BY GROUPING SETS ((label), ())")
def metrics_by_label(spark, sf_dir):
    return metrics_report(_per_query(spark, sf_dir), "label")


# --- fusion and rerank ---------------------------------------------------------------------------

_EXPANDED = """kv AS (""" + TERMS_SQL + """),
kk AS (SELECT lower(alias) AS key, canonical, CASE WHEN category LIKE 'variety%' THEN 'cultivar'
    WHEN category = 'nutrient' THEN 'fertilizer' ELSE category END AS slot, category_ord,
    alias_ord, 0 AS o FROM kv WHERE category NOT IN ('symptom', 'malay_common')
  UNION ALL SELECT lower(canonical), canonical, CASE WHEN category LIKE 'variety%' THEN 'cultivar'
    WHEN category = 'nutrient' THEN 'fertilizer' ELSE category END, category_ord, alias_ord, 1
  FROM kv WHERE category NOT IN ('symptom', 'malay_common')),
kd AS (SELECT key, slot, canonical, category_ord, alias_ord, o FROM kk QUALIFY row_number() OVER (
  PARTITION BY key, slot ORDER BY category_ord, alias_ord, o, canonical) = 1)"""


def slots_sql(out: str, source: str, key: str, text: str = "text",
              order: str = "category_ord, alias_ord, o, canonical") -> str:
    """CTE ``out(id, slot, canonical, pos)``: longest dictionary key per slot, in match order."""
    return f"""{out}_m AS (SELECT s.{key} AS id, kd.* FROM {source} s JOIN kd
    ON contains(lower(s.{text}), kd.key)
  QUALIFY row_number() OVER (PARTITION BY s.{key}, slot
    ORDER BY length(key) DESC, {order}) = 1),
{out} AS (SELECT id, slot, canonical, row_number() OVER (PARTITION BY id
    ORDER BY length(key) DESC, {order}) AS pos FROM {out}_m)"""


_FUSE = f"""WITH {_EXPANDED}, {slots_sql("bs", "benchmark", "item_id")},
al AS (SELECT canonical, string_agg(alias, ' ' ORDER BY category_ord, alias_ord) AS a
  FROM kv WHERE alias <> canonical GROUP BY canonical),
ex AS (SELECT b.item_id, b.text || coalesce(string_agg(
    ' ' || bs.canonical || coalesce(' ' || al.a, ''), '' ORDER BY pos), '') AS text
  FROM benchmark b LEFT JOIN bs ON bs.id = b.item_id LEFT JOIN al ON al.canonical = bs.canonical
  GROUP BY b.item_id, b.text), {_TOK}, {tokens_sql("xt", "ex", "item_id")},
{bm25_sql("bx", "dt", "xt")},
hits AS (SELECT * FROM (SELECT 'bm25_original' AS route, 0 AS o, *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10
  UNION ALL SELECT * FROM (SELECT 'bm25_expanded' AS route, 1 AS o, *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bx) WHERE rank <= 10),
fused AS (SELECT query_id, chunk_id, round(sum(CASE route WHEN 'bm25_original' THEN 0.15
    ELSE 0.35 END / (60 + rank)), 12) AS score, max(CASE WHEN route = 'bm25_original' THEN rank
    END) AS r1, max(CASE WHEN route = 'bm25_expanded' THEN rank END) AS r2
  FROM hits GROUP BY query_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
    CASE WHEN r1 IS NULL THEN 1 ELSE 0 END, coalesce(r1, r2), chunk_id) AS rrf_rank FROM fused)
"""


def _words(spark):
    t = terms(spark)
    return T.dictionary(T.entity_keys(t)), T.alias_map(t)


def _setup(spark, sf_dir, **kw):
    words, aliases = _words(spark)
    return SearchSetup(documents(spark, sf_dir), words, aliases, **kw)


def _fused(spark, sf_dir, top=None):
    hits = four_way_recall(items(spark, sf_dir), _setup(spark, sf_dir))
    return fusion.weighted_rrf(hits, top_n_docs=top)


@query("rrf_fusion", _FUSE + """SELECT query_id, chunk_id, round(score, 9) AS score,
  CAST(rrf_rank AS INTEGER) AS rrf_rank, CAST(r1 AS INTEGER) AS bm25_original,
  CAST(r2 AS INTEGER) AS bm25_expanded FROM ranked""")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", "chunk_id", F.round("score", 9).alias("score"), "rrf_rank",
        F.col("sources")["bm25_original"].alias("bm25_original"),
        F.col("sources")["bm25_expanded"].alias("bm25_expanded"))


@query("build_queries", f"""WITH {_EXPANDED}, {slots_sql("bs", "documents", "doc_id")},
al AS (SELECT canonical, string_agg(alias, ' ' ORDER BY category_ord, alias_ord) AS a
  FROM kv WHERE alias <> canonical GROUP BY canonical)
SELECT d.doc_id, coalesce(string_agg(bs.canonical, ' ' ORDER BY pos), '') AS names,
  coalesce(string_agg(bs.canonical || coalesce(' ' || al.a, ''), ' ' ORDER BY pos), '')
  AS expansion
FROM documents d LEFT JOIN bs ON bs.id = d.doc_id LEFT JOIN al ON al.canonical = bs.canonical
GROUP BY d.doc_id""")
def build_queries_query(spark, sf_dir):
    words, aliases = _words(spark)
    df = T.detect_entities(table(spark, sf_dir, "documents"), words)
    q = T.build_queries(df, words, aliases, entities="entities")
    tail = F.substring("expanded", F.length("original") + 2, F.length("expanded"))
    return q.select("doc_id", F.concat_ws(" ", F.map_values("entities")).alias("names"),
                    tail.alias("expansion"))


@query("attach_records", _FUSE + """SELECT query_id, chunk_id, CAST(rrf_rank AS INTEGER)
  AS rrf_rank, source AS document_id, n_chars AS n_chars
FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rrf_rank <= 8""")
def attach_records(spark, sf_dir):
    rec = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "n_chars")
    return fusion.attach_records(_fused(spark, sf_dir, 8), rec).select(
        "query_id", "chunk_id", "rrf_rank", "document_id", "n_chars")


_RERANK = f"""WITH {_TOK}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 30),
pp AS (SELECT doc_id, substr(text, 1, 512) AS text FROM documents),
{tokens_sql("pt", "pp", "doc_id")},
qn AS (SELECT id, count(*) AS n FROM qt GROUP BY id),
sc AS (SELECT c.query_id, c.chunk_id, c.rank, count(pt.term) / any_value(qn.n) AS s
  FROM cand c JOIN qn ON qn.id = c.query_id JOIN qt ON qt.id = c.query_id
  LEFT JOIN pt ON pt.id = c.chunk_id AND pt.term = qt.term GROUP BY 1, 2, 3)
"""


@query("rerank_topk", _RERANK + """SELECT query_id, chunk_id, round(s, 6) AS rerank_score,
  CAST(rn AS INTEGER) AS rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY s DESC, rank) AS rn FROM sc WHERE s >= 0.3) WHERE rn <= 5""")
def rerank_topk(spark, sf_dir):
    docs, q = documents(spark, sf_dir), items(spark, sf_dir)
    hits = bm25_search(q, bm25_index(docs), 30)
    pairs = (hits.join(docs.select("chunk_id", fusion.passage("text").alias("p")), "chunk_id")
             .join(q.select("query_id", F.col("text").alias("q")), "query_id"))
    score = fusion.overlap_score(multilingual_tokens("q"), multilingual_tokens("p"))
    out = fusion.rerank(pairs, score, rank="rank")
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"),
                      "rerank_rank")


@query("evidence_block", f"""WITH {_TOK}, top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 3)
SELECT query_id, md5(string_agg('[' || chunk_id || '] (' || source || ') ' || text, chr(10)
  ORDER BY rank)) AS evidence_md5 FROM top JOIN documents ON doc_id = chunk_id
GROUP BY query_id""")
def evidence_block(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = bm25_search(items(spark, sf_dir), bm25_index(docs), 3)
    block = fusion.evidence_block(hits.join(docs, "chunk_id"), "rank")
    return block.select("query_id", F.md5("evidence").alias("evidence_md5"))


@query("cited_sources", f"""WITH {_TOK}, top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 3)
SELECT query_id, source AS document_id, chunk_id, source AS title, '' AS section
FROM top JOIN documents ON doc_id = chunk_id WHERE rank <> 2""")
def cited_sources(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = staged(bm25_search(items(spark, sf_dir), bm25_index(docs), 3), "hits")
    # An answer that cites its first and third source, the first one twice.
    answers = hits.filter("rank <> 2").groupBy("query_id").agg(F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list("chunk_id")),
        lambda x: F.concat(F.lit("see ["), x.cast("string"), F.lit("] and ["),
                           x.cast("string"), F.lit("]")))).alias("answer"))
    return fusion.cited_sources(hits.join(docs, "chunk_id"), answers)


# --- evidence ------------------------------------------------------------------------------------


def _facts(spark, sf_dir):
    """Queries with entities, symptoms and, for every third one, a numeric condition."""
    words, aliases = _words(spark)
    q = items(spark, sf_dir)
    dose = F.when(F.col("query_id") % 3 == 0, F.concat(
        F.lit(" "), (F.col("query_id") * 7 % 90 + 1).cast("string"), F.lit(" kg"))).otherwise("")
    q = T.detect_entities(q.withColumn("query", F.concat("text", dose)), words)
    from ..functions.tagging import symptoms
    pairs = [(a, c) for cat, _, _, a, c in TERMS if cat == "symptom"]
    q = once(q, "__v", normalize_text("text"))
    return q.withColumn("symptoms", symptoms("__v", pairs)).drop("__v"), aliases


@query("evidence_check", f"""WITH {_EXPANDED}, {slots_sql("bs", "benchmark", "item_id")}, {_TOK},
q AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 3 = 0 THEN ' '
    || CAST(item_id * 7 % 90 + 1 AS VARCHAR) || ' kg' ELSE '' END AS query, text FROM benchmark),
nq AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN TRY_CAST(list_extract(regexp_extract_all(
    query, '[0-9]+(?:[.][0-9]+)?'), 1) AS DOUBLE) END AS key FROM q),
top AS (SELECT query_id, chunk_id, lower(text) AS t, regexp_extract_all(text,
    '[0-9]+(?:[.][0-9]+)?')::DOUBLE[] AS nums FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)
  JOIN documents ON doc_id = chunk_id WHERE rank <= 8),
need AS (SELECT DISTINCT bs.id AS query_id, bs.slot, bs.canonical, lower(f) AS form FROM bs
  JOIN (SELECT canonical, canonical AS f FROM kv UNION SELECT canonical, alias FROM kv) s
    ON s.canonical = bs.canonical),
miss AS (SELECT n.query_id, n.slot, n.canonical FROM need n LEFT JOIN top t
    ON t.query_id = n.query_id AND contains(t.t, n.form) GROUP BY 1, 2, 3
  HAVING count(t.chunk_id) = 0),
sym AS (SELECT DISTINCT query_id, canonical FROM q JOIN kv ON contains(q.text, kv.alias)
  WHERE category = 'symptom'),
smiss AS (SELECT s.query_id, s.canonical FROM sym s LEFT JOIN top t ON t.query_id = s.query_id
    AND contains(t.t, lower(s.canonical)) GROUP BY 1, 2 HAVING count(t.chunk_id) = 0),
agg AS (SELECT q.query_id, any_value(key) AS key, count(t.chunk_id) AS n,
    count(*) FILTER (WHERE len(nums) > 0) AS n_num,
    coalesce(bool_or(len(list_filter(nums, lambda x: abs(x - key) <= greatest(0.5, abs(key)
      * 0.05))) > 0), false) AS near
  FROM q JOIN nq USING (query_id) LEFT JOIN top t USING (query_id) GROUP BY q.query_id)
SELECT query_id, n AS evidence_count, (n > 0 AND key IS NOT NULL AND n_num >= 2 AND NOT near)
    AS entity_conflict, missing_entities, missing_symptoms,
  (n > 0 AND key IS NOT NULL AND n_num = 0) AS no_number,
  (n > 0 AND n < 2 AND NOT (key IS NOT NULL AND n_num >= 2 AND NOT near)) AS single_point,
  (n > 0 AND missing_entities = 0 AND missing_symptoms = 0 AND NOT entity_conflict
    AND NOT no_number AND NOT single_point) AS sufficient
FROM (SELECT *, (SELECT count(*) FROM miss m WHERE m.query_id = agg.query_id) AS missing_entities,
  (SELECT count(*) FROM smiss m WHERE m.query_id = agg.query_id) AS missing_symptoms FROM agg)""")
def evidence_check(spark, sf_dir):
    facts, aliases = _facts(spark, sf_dir)
    docs = documents(spark, sf_dir)
    hits = bm25_search(items(spark, sf_dir), bm25_index(docs), V.EVIDENCE_TOP_N)
    v = check_evidence(facts, hits.join(docs, "chunk_id"), aliases)

    def n(prefix):
        return F.size(F.filter("reasons", lambda r: r.startswith(prefix))).cast("long")

    return v.select(
        "query_id", "evidence_count", "entity_conflict",
        n(V.REASON_ENTITY).alias("missing_entities"),
        n(V.REASON_SYMPTOM).alias("missing_symptoms"),
        F.array_contains("reasons", V.REASON_NO_NUMBER).alias("no_number"),
        (n(V.REASON_SINGLE[0]) > 0).alias("single_point"), "sufficient")


_ASKED = """asked AS (SELECT item_id AS query_id, text, text || CASE WHEN item_id % 3 = 0 THEN ' '
    || CAST(item_id * 7 % 90 + 1 AS VARCHAR) || ' kg' ELSE '' END AS query FROM benchmark)"""

_CORPUS_SQL = f"""{_EXPANDED}, {_ASKED}, {tokens_sql("dt", "documents", "doc_id")},
al AS (SELECT canonical, string_agg(alias, ' ' ORDER BY category_ord, alias_ord) AS a
  FROM kv WHERE alias <> canonical GROUP BY canonical),
pp AS (SELECT doc_id, substr(text, 1, 512) AS text FROM documents),
{tokens_sql("pt", "pp", "doc_id")}, {tokens_sql("aq", "asked", "query_id", "query")},
an AS (SELECT id, count(*) AS n FROM aq GROUP BY id)"""


def _vector_sql(out: str, tokens: str) -> str:
    """CTE ``out(id, slot, w)``: the hashed unit vectors of a token CTE."""
    return f"""{out}_c AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS slot,
    count(*) AS n FROM {tokens} GROUP BY 1, 2),
{out} AS (SELECT id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {out}_c)"""


def search_sql(p: str, source: str) -> str:
    """CTEs ending in ``{p}(query_id, chunk_id, rerank_score, rerank_rank)`` for the queries of
    ``source(query_id, text)``: four routes, fusion, rerank; after ``_CORPUS_SQL``."""
    return f"""{slots_sql(p + "_s", source, "query_id")},
{p}_x AS (SELECT q.query_id, q.text || coalesce(string_agg(' ' || s.canonical || coalesce(
      ' ' || al.a, ''), '' ORDER BY pos), '') AS expanded,
    q.text || coalesce(string_agg(CASE WHEN contains(q.text, s.canonical) THEN '' ELSE ' '
      || s.canonical END, '' ORDER BY pos), '') AS canonical
  FROM {source} q LEFT JOIN {p}_s s ON s.id = q.query_id LEFT JOIN al ON al.canonical = s.canonical
  GROUP BY q.query_id, q.text),
{tokens_sql(p + "_to", source, "query_id")}, {tokens_sql(p + "_te", p + "_x", "query_id", "expanded")},
{tokens_sql(p + "_tc", p + "_x", "query_id", "canonical")},
{bm25_sql(p + "_bo", "dt", p + "_to")}, {bm25_sql(p + "_be", "dt", p + "_te")},
{_vector_sql(p + "_vd", "dt")}, {_vector_sql(p + "_vo", p + "_to")}, {_vector_sql(p + "_vc", p + "_tc")},
{p}_do AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.w * d.w), 9) AS score
  FROM {p}_vo q JOIN {p}_vd d ON q.slot = d.slot GROUP BY 1, 2 HAVING round(sum(q.w * d.w), 9) >= 0.3),
{p}_dc AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.w * d.w), 9) AS score
  FROM {p}_vc q JOIN {p}_vd d ON q.slot = d.slot GROUP BY 1, 2 HAVING round(sum(q.w * d.w), 9) >= 0.3),
{p}_all AS (SELECT 0 AS o, 0.20 AS w, query_id, chunk_id, score FROM {p}_do
  UNION ALL SELECT 1, 0.30, query_id, chunk_id, score FROM {p}_dc
  UNION ALL SELECT 2, 0.15, query_id, chunk_id, score FROM {p}_bo
  UNION ALL SELECT 3, 0.35, query_id, chunk_id, score FROM {p}_be),
{p}_hits AS (SELECT *, row_number() OVER (PARTITION BY o, query_id ORDER BY score DESC, chunk_id)
  AS rank FROM {p}_all QUALIFY rank <= 10),
{p}_f AS (SELECT query_id, chunk_id, round(sum(w::DOUBLE / (60 + rank) ORDER BY o), 12) AS score,
    min(o) AS o, arg_min(rank, o) AS r FROM {p}_hits GROUP BY query_id, chunk_id),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, r, chunk_id)
  AS rrf_rank FROM {p}_f QUALIFY rrf_rank <= 8),
{p}_o AS (SELECT f.query_id, f.chunk_id, f.rrf_rank, count(pt.term) / any_value(an.n) AS s
  FROM {p}_r f JOIN an ON an.id = f.query_id JOIN aq ON aq.id = f.query_id
  LEFT JOIN pt ON pt.id = f.chunk_id AND pt.term = aq.term GROUP BY 1, 2, 3),
{p} AS (SELECT query_id, chunk_id, s AS rerank_score, row_number() OVER (PARTITION BY query_id
  ORDER BY s DESC, rrf_rank) AS rerank_rank FROM {p}_o WHERE s >= 0.3 QUALIFY rerank_rank <= 5)"""


def verdict_sql(p: str, source: str, hits: str) -> str:
    """CTE ``{p}(query_id, n, sufficient, n_reasons)`` for the queries of ``source`` and ``hits``."""
    return f"""{p}_t AS (SELECT query_id, chunk_id, lower(text) AS t, regexp_extract_all(text,
    '[0-9]+(?:[.][0-9]+)?')::DOUBLE[] AS nums FROM {hits} JOIN documents ON doc_id = chunk_id),
{p}_need AS (SELECT DISTINCT bs.id AS query_id, bs.slot, bs.canonical, lower(f) AS form FROM bs
  JOIN (SELECT canonical, canonical AS f FROM kv UNION SELECT canonical, alias FROM kv) s
    ON s.canonical = bs.canonical),
{p}_miss AS (SELECT n.query_id, n.slot FROM {p}_need n LEFT JOIN {p}_t t ON t.query_id = n.query_id
    AND contains(t.t, n.form) GROUP BY 1, 2 HAVING count(t.chunk_id) = 0),
{p}_sym AS (SELECT DISTINCT query_id, canonical FROM asked JOIN kv ON contains(asked.text, kv.alias)
  WHERE category = 'symptom'),
{p}_smiss AS (SELECT s.query_id, s.canonical FROM {p}_sym s LEFT JOIN {p}_t t
    ON t.query_id = s.query_id AND contains(t.t, lower(s.canonical))
  GROUP BY 1, 2 HAVING count(t.chunk_id) = 0),
{p}_key AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN TRY_CAST(list_extract(
    regexp_extract_all(query, '[0-9]+(?:[.][0-9]+)?'), 1) AS DOUBLE) END AS key FROM asked),
{p}_agg AS (SELECT q.query_id, any_value(key) AS key, count(t.chunk_id) AS n,
    count(*) FILTER (WHERE len(nums) > 0) AS n_num, coalesce(bool_or(len(list_filter(nums,
      lambda x: abs(x - key) <= greatest(0.5, abs(key) * 0.05))) > 0), false) AS near
  FROM {source} q JOIN {p}_key USING (query_id) LEFT JOIN {p}_t t USING (query_id)
  GROUP BY q.query_id),
{p}_w AS (SELECT *, key IS NOT NULL AND n_num >= 2 AND NOT near AS conflict,
    (SELECT count(*) FROM {p}_miss m WHERE m.query_id = a.query_id)
    + (SELECT count(*) FROM {p}_smiss m WHERE m.query_id = a.query_id) AS missing FROM {p}_agg a),
{p} AS (SELECT query_id, n, CASE WHEN n = 0 THEN 1 ELSE missing
    + CASE WHEN key IS NOT NULL AND n_num = 0 THEN 1 ELSE 0 END
    + CASE WHEN conflict THEN 1 ELSE 0 END
    + CASE WHEN n < 2 AND NOT conflict THEN 1 ELSE 0 END END AS n_reasons FROM {p}_w)"""


@query("search_documents", f"""WITH {_CORPUS_SQL}, {search_sql("s1", "asked")}
SELECT query_id, chunk_id, source AS document_id, CAST(rerank_rank AS INTEGER) AS rerank_rank,
  round(rerank_score, 6) AS rerank_score FROM s1 JOIN documents ON doc_id = chunk_id""")
def search_documents(spark, sf_dir):
    """Four-way search with hashed vectors, rerank and evidence check over all items."""
    facts, _ = _facts(spark, sf_dir)
    return search(facts, _search_setup(spark, sf_dir))[0].select(
        "query_id", "chunk_id", "document_id", "rerank_rank",
        F.round("rerank_score", 6).alias("rerank_score"))


_FOUR = f"WITH {_CORPUS_SQL}, {search_sql('s1', 'asked')}"


@query("four_way_recall", _FOUR + """SELECT query_id, ['dense_original', 'dense_canonical',
    'bm25_original', 'bm25_expanded'][o + 1] AS route, chunk_id, round(score, 6) AS score,
  CAST(rank AS INTEGER) AS rank FROM s1_hits""")
def four_way_recall_query(spark, sf_dir):
    """The ten best hits of each of the four routes."""
    hits = four_way_recall(items(spark, sf_dir), _search_setup(spark, sf_dir))
    return hits.select("query_id", "route", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("rewrite_queries", _FOUR + """SELECT query_id, len(regexp_extract_all(expanded, '[a-z]+'))
  AS n_words, contains(expanded, query) AND query <> text AS kept_dose FROM s1_x JOIN asked
USING (query_id)""")
def rewrite_queries_query(spark, sf_dir):
    """Rewrites by rule: words of the expanded query, and whether the dose came in."""
    facts, _ = _facts(spark, sf_dir)
    asked = facts.select("query_id", F.col("query").alias("asked"), F.col("text").alias("plain"))
    r = rewrite_queries(facts, _setup(spark, sf_dir)).join(asked, "query_id")
    return r.select("query_id", F.regexp_count("text", F.lit("[a-z]+")).cast("long").alias("n_words"),
                    (F.contains("text", "asked") & (F.col("asked") != F.col("plain")))
                    .alias("kept_dose"))


def _words_sql(text):
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\pL\\pN]+'), lambda w: w <> '')"


_QUOTES = f"""qw AS (SELECT item_id AS query_id, {_words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT query_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM qw, unnest(generate_series(1, greatest(len(w) - 12, 1))) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, ' ' || array_to_string({_words_sql('text')}, ' ') || ' ' AS t FROM documents),
quoted AS (SELECT query_id, doc_id AS chunk_id, count(*) AS windows FROM win JOIN dw
  ON contains(t, ' ' || win || ' ') GROUP BY ALL)"""


@query("quoted_pairs", f"WITH {_QUOTES} SELECT query_id, chunk_id, windows FROM quoted")
def quoted_pairs_query(spark, sf_dir):
    """Documents that quote benchmark items, with the number of shared windows."""
    return quoted_pairs(spread(documents(spark, sf_dir)), items(spark, sf_dir))


@query("evaluate_search", _FOUR + f""", {_QUOTES}, gold AS (SELECT query_id, chunk_id AS doc_id FROM quoted),
size AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
g AS (SELECT query_id, min(rerank_rank) AS best, count(*) AS found FROM s1 JOIN gold g USING (query_id)
  WHERE g.doc_id = chunk_id GROUP BY 1)
SELECT query_id, CASE WHEN best = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_at_1,
  coalesce(round((found / n)::DOUBLE, 6), 0.0) AS recall_at_k,
  coalesce(round((1.0 / best)::DOUBLE, 6), 0.0) AS mrr
FROM asked LEFT JOIN size USING (query_id) LEFT JOIN g USING (query_id)""")
def evaluate_search_query(spark, sf_dir):
    """The whole search measured on the documents that quote a window of an item."""
    facts, _ = _facts(spark, sf_dir)
    # Read twice, by the sizes and by the hits.
    gold = staged(quoted_pairs(spread(documents(spark, sf_dir)), items(spark, sf_dir))
                  .drop("windows"), "gold")
    setup = _search_setup(spark, sf_dir)

    def run(labels):
        return search(facts.join(labels.select("query_id"), "query_id"), setup)[0].select(
            "query_id", "chunk_id", F.col("rerank_rank").alias("rank"))

    m, _ = evaluate_search(gold, facts.withColumn("language", F.lit("en")), run)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "recall_at_k", "mrr")])


def _search_setup(spark, sf_dir):
    # One pass over the texts gives the token table and the hashed vectors.
    docs = with_tokens(spread(documents(spark, sf_dir)), "text", "tokens")
    docs = once(docs, "vec", hash_embed("tokens")).withColumn("doc_len", F.size("tokens"))
    rec = staged(docs, "corpus")
    words, aliases = _words(spark)
    return SearchSetup(rec, words, aliases, embed=embed_with_hash(), index=BM25Index(rec),
                       relevance=lambda q, p: fusion.overlap_score(multilingual_tokens(q),
                                                                   multilingual_tokens(p)))


@query("search_with_retry", f"""WITH {_CORPUS_SQL}, {slots_sql("bs", "benchmark", "item_id")},
{search_sql("s1", "asked")}, {verdict_sql("v1", "asked", "s1")},
again AS (SELECT query_id, expanded AS text FROM v1 JOIN s1_x USING (query_id) WHERE n_reasons > 0),
{search_sql("s2", "again")}, {verdict_sql("v2", "again", "s2")}
SELECT query_id, TRUE AS sufficient, n AS evidence_count, 1 AS rounds, NULL::VARCHAR AS error,
  0::BIGINT AS n_reasons FROM v1 WHERE n_reasons = 0
UNION ALL SELECT query_id, n_reasons = 0, n, 2, CASE WHEN n_reasons > 0 THEN 'RAG_NO_RESULT' END,
  n_reasons FROM v2""")
def search_with_retry_query(spark, sf_dir):
    facts, _ = _facts(spark, sf_dir)
    _, verdicts = search_with_retry(facts, _search_setup(spark, sf_dir))
    return verdicts.select("query_id", "sufficient", "evidence_count", "rounds", "error",
                           F.size("reasons").cast("long").alias("n_reasons"))


@query("new_number_guard", """WITH n AS (SELECT a.item_id, b.item_id AS other,
  regexp_extract_all(a.text || ' ' || a.item_id, '[0-9]+(?:[.][0-9]+)?') AS x,
  regexp_extract_all(b.text || ' ' || (b.item_id // 2), '[0-9]+(?:[.][0-9]+)?') AS y
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id // 2)
SELECT item_id, len(list_filter(y, lambda v: NOT list_contains(x, v))) > 0 AS introduces
FROM n""")
def new_number_guard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    other = b.select(F.col("item_id").alias("o"), F.concat_ws(
        " ", "text", F.floor(F.col("item_id") / 2).cast("string")).alias("rewritten"))
    own = b.select("item_id", F.concat_ws(" ", "text", F.col("item_id").cast("string"))
                   .alias("original"))
    j = own.join(other, F.floor(F.col("item_id") / 2) == F.col("o"))
    return j.select("item_id", introduces_numbers("original", "rewritten").alias("introduces"))


@query("hash_embed", f"""WITH {tokens_sql("dt", "documents", "doc_id")},
h AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS slot FROM dt),
c AS (SELECT id, slot, count(*) AS n FROM h GROUP BY id, slot),
z AS (SELECT id, sqrt(sum(n * n)) AS norm, sum(slot * n) AS weighted, max(n) AS top FROM c
  GROUP BY id)
SELECT doc_id, coalesce(round(top / norm, 6), 0.0) AS largest,
  coalesce(round(weighted / norm, 4), 0.0) AS weighted
FROM documents LEFT JOIN z ON id = doc_id""")
def hash_embed_query(spark, sf_dir):
    df = with_tokens(spread(table(spark, sf_dir, "documents")), "text", "t")
    df = once(df, "v", hash_embed("t"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return df.select("doc_id", F.round(F.array_max("v"), 6).alias("largest"),
                     F.round(weighted, 4).alias("weighted"))


# --- permissions ---------------------------------------------------------------------------------


@query("scope_filter", """WITH d AS (SELECT doc_id, source AS tenant_id,
  CASE doc_id % 3 WHEN 0 THEN ['worker', 'manager'] WHEN 1 THEN ['manager'] ELSE ['worker'] END
    AS role_scope,
  CASE doc_id % 4 WHEN 0 THEN ['ORCHARD_1'] WHEN 1 THEN ['', 'ORCHARD_2'] ELSE [] END::VARCHAR[]
    AS orchard_scope FROM documents),
u AS (SELECT n_nationkey AS user_id, 'src' || (n_nationkey % 20) AS tenant_id,
  CASE n_nationkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'worker' ELSE 'manager' END AS role,
  CASE n_nationkey % 2 WHEN 0 THEN [] ELSE ['ORCHARD_1'] END::VARCHAR[] AS orchard_scope
  FROM nation)
SELECT CAST(u.user_id AS BIGINT) AS user_id, d.doc_id FROM d JOIN u ON d.tenant_id = u.tenant_id
WHERE (u.role = 'admin' OR list_contains(d.role_scope, u.role))
  AND (len(u.orchard_scope) = 0 OR len(list_filter(d.orchard_scope, lambda x: x <> '')) = 0
       OR len(list_intersect(d.orchard_scope, u.orchard_scope)) > 0)""")
def scope_filter_query(spark, sf_dir):
    m = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("tenant_id"),
        F.when(m == 0, F.array(F.lit("worker"), F.lit("manager")))
        .when(m == 1, F.array(F.lit("manager"))).otherwise(F.array(F.lit("worker")))
        .alias("role_scope"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("ORCHARD_1")))
        .when(F.col("doc_id") % 4 == 1, F.array(F.lit(""), F.lit("ORCHARD_2")))
        .otherwise(F.array().cast("array<string>")).alias("orchard_scope"))
    n = F.col("n_nationkey")
    u = table(spark, sf_dir, "nation").select(
        n.cast("long").alias("user_id"),
        F.concat(F.lit("src"), (n % 20).cast("string")).alias("tenant_id"),
        F.when(n % 3 == 0, "admin").when(n % 3 == 1, "worker").otherwise("manager").alias("role"),
        F.when(n % 2 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("ORCHARD_1"))).alias("orchard_scope"))
    return scope_filter(d, u).select("user_id", "doc_id")


def _role(c):
    return (F.when(c % 4 == 0, "worker").when(c % 4 == 1, "manager").when(c % 4 == 2, "admin")
            .otherwise("guest"))


def _tool(c):
    return (F.when(c == "signup", "user_context").when(c == "error", "task_create")
            .when(c == "view", "asset_query").when(c == "click", "agriculture_rag")
            .otherwise("alarm_query"))


_CALLS = """c AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'worker' WHEN 1 THEN 'manager'
    WHEN 2 THEN 'admin' ELSE 'guest' END AS role, CASE event_type WHEN 'signup' THEN
    'user_context' WHEN 'error' THEN 'task_create' WHEN 'view' THEN 'asset_query' WHEN 'click'
    THEN 'agriculture_rag' ELSE 'alarm_query' END AS tool_name FROM events)"""


@query("tool_permission", f"""WITH {_CALLS}
SELECT event_id, role, tool_name FROM c WHERE role = 'admin' OR tool_name = 'user_context'
  OR (role = 'manager' AND tool_name IN ('agriculture_rag', 'asset_query', 'task_query',
      'task_create', 'task_update', 'weather', 'sensor'))
  OR (role <> 'manager' AND tool_name IN ('agriculture_rag', 'asset_query', 'task_query'))""")
def tool_permission(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        "event_id", _role(F.col("user_id")).alias("role"),
        _tool(F.col("event_type")).alias("tool_name"))
    rules = spark.createDataFrame([(r, t) for r, ts in V.ROLE_TOOLS.items() for t in ts],
                                  "role string, tool_name string")
    return allowed_tools(calls, rules)


@query("request_context", """WITH r AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN ' Worker '
    WHEN 1 THEN 'ADMIN' WHEN 2 THEN NULL WHEN 3 THEN 'root' ELSE 'manager' END AS role,
  CASE event_id % 3 WHEN 0 THEN 'TH' WHEN 1 THEN NULL ELSE 'xx' END AS language, user_id FROM events),
n AS (SELECT event_id, lower(trim(coalesce(role, 'worker'))) AS role,
  lower(coalesce(language, 'auto')) AS language, user_id FROM r)
SELECT event_id AS request_id, 'u' || user_id AS user_id, role, 't' || (event_id % 100)
  AS thread_id, 'default:u' || user_id || ':t' || (event_id % 100) AS checkpoint_thread_id,
  'default' AS tenant_id, language, CASE WHEN role NOT IN ('worker', 'manager', 'admin')
  THEN 'role' WHEN language NOT IN ('auto', 'zh', 'en', 'th', 'ms') THEN 'language' END AS reject
FROM n""")
def request_context_query(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        e.alias("request_id"), F.concat(F.lit(" u"), u.cast("string")).alias("user_id"),
        F.when(u % 5 == 0, " Worker ").when(u % 5 == 1, "ADMIN").when(u % 5 == 3, "root")
        .when(u % 5 == 4, "manager").alias("role"),
        F.when(e % 3 == 0, "TH").when(e % 3 == 2, "xx").alias("language"),
        F.concat(F.lit("t"), (e % 100).cast("string")).alias("thread_id"),
        F.lit(" ").alias("tenant_id"))
    return request_context(raw)


@query("rank_hits", f"""WITH {_TOK} SELECT * FROM (SELECT query_id, chunk_id, CAST(row_number()
  OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm)
WHERE rank <= 50""")
def rank_hits(spark, sf_dir):
    """The fifty best hits of every query, in their order."""
    hits = bm25_search(items(spark, sf_dir), bm25_index(documents(spark, sf_dir)), 50)
    return fusion.rank_hits(hits.drop("rank").withColumn("route", F.lit("bm25_original"))).select(
        "query_id", "chunk_id", "rank")


@query("cut_fused", _FUSE + """SELECT query_id, count(*) FILTER (WHERE rrf_rank <= 3) AS direct,
  count(*) FILTER (WHERE rrf_rank <= 8) AS tool, count(*) AS fused FROM ranked GROUP BY query_id""")
def cut_fused(spark, sf_dir):
    f = _fused(spark, sf_dir)
    return f.groupBy("query_id").agg(F.count_if(F.col("rrf_rank") <= 3).alias("direct"),
                                     F.count_if(F.col("rrf_rank") <= 8).alias("tool"),
                                     F.count("*").alias("fused"))

