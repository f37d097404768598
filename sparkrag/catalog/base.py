"""Registration, table loading and SQL fragments shared by the registered queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver documents as search records."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"),
        F.col("lang").alias("language"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver benchmark as the query table."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Made-up terms in the invented language of the driver texts, in the shape of a term table.
TERMS = [
    ("variety_thai", 0, 0, "thanedble", "erthat"), ("variety_thai", 0, 1, "nicht", "ersch"),
    ("variety_malaysia", 1, 0, "onbleea", "ingor"), ("variety_malaysia", 1, 1, "thble", "ingor"),
    ("disease", 2, 0, "attion", "erble"), ("disease", 2, 1, "thintion", "erble"),
    ("disease", 2, 2, "eriner", "oning"), ("pest", 3, 0, "reing", "heble"),
    ("pest", 3, 1, "enlich", "inging"), ("nutrient", 4, 0, "tionen", "ndble"),
    ("nutrient", 4, 1, "estion", "haing"), ("symptom", 5, 0, "onouor", "thanea"),
    ("symptom", 5, 1, "thndly", "thanea"), ("symptom", 5, 2, "onesnt", "ingha"),
    ("malay_common", 6, 0, "edtion", "onble"),
]
TERM_SCHEMA = "category string, category_ord int, alias_ord int, alias string, canonical string"


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, TERM_SCHEMA)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


TERMS_SQL = ("SELECT * FROM " + values(TERMS)
             + " t(category, category_ord, alias_ord, alias, canonical)")

STOP_SQL = ", ".join(map(quote, V.STOPWORDS))


def tokens_sql(out: str, source: str, key: str, text: str = "text") -> str:
    """CTEs that end in ``out(key, term)``: distinct Latin tokens, first 120 by position."""
    return f"""
{out}_p AS (SELECT {key} AS id, unnest(w) AS term, generate_subscripts(w, 1) AS p
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z][a-z0-9_.-]+') AS w
        FROM {source})),
{out} AS (SELECT id, term FROM (SELECT id, term, min(p) AS p FROM {out}_p
    WHERE term NOT IN ({STOP_SQL}) GROUP BY id, term)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) <= 120)"""


def bm25_sql(out: str, docs: str, queries: str) -> str:
    """CTE ``out(query_id, chunk_id, score)`` from token CTEs ``docs`` and ``queries``."""
    return f"""
{out}_len AS (SELECT id, count(*) AS n FROM {docs} GROUP BY id),
{out}_st AS (SELECT (SELECT count(*) FROM documents) AS n_docs,
  (SELECT sum(n) FROM {out}_len) / (SELECT count(*) FROM documents) AS avg_len),
{out}_df AS (SELECT term, count(*) AS df FROM {docs} GROUP BY term),
{out} AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(
    ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * 2.5
    / (1.0 + 1.5 * (0.25 + 0.75 * (n / avg_len)))), 9) AS score
  FROM {queries} q JOIN {docs} d ON q.term = d.term JOIN {out}_df f ON f.term = d.term
  JOIN {out}_len l ON l.id = d.id CROSS JOIN {out}_st GROUP BY q.id, d.id)"""
