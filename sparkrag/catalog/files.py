"""Scans and sinks: driver tables written as the files of a corpus and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import models as MO
from ..functions import cleaning as C
from ..functions.text import spread
from ..sources import readers as R
from ..sources import writers as W
from ..sources.stage import new_path
from .base import ORACLES, query, table
from .tagging import _PT, _part_terms

TERMS_PER_FILE = 20000


def _chunk_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("source_file"),
                    "text", (F.col("doc_id") % 50).cast("int").alias("page"))


@query("chunk_sink", """SELECT CAST(doc_id AS VARCHAR) AS doc, source AS source_file,
  md5(text) AS text_md5, CAST(doc_id % 50 AS INTEGER) AS page FROM documents""")
def chunk_sink(spark, sf_dir):
    """All documents written as a chunk corpus and scanned again."""
    path = new_path(spark, "chunks")
    W.write_chunks(_chunk_rows(spark, sf_dir), path)
    rows, _ = R.read_chunks(spark, path)
    return rows.select("doc", "source_file", F.md5("text").alias("text_md5"), "page")


@query("chunk_scan", """SELECT count(*) AS n, count(DISTINCT doc_id) AS docs,
  sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE doc_id % 7 = 0) AS bad_lines,
  TRUE AS in_order FROM documents""")
def chunk_scan(spark, sf_dir):
    """A corpus with a broken line for every seventh document and blank lines: rows and counts."""
    path = new_path(spark, "lines")
    lines = _chunk_rows(spark, sf_dir).select(F.explode(F.array_compact(F.array(
        F.to_json(F.struct("doc", "source_file", "text", "page")),
        F.when(F.col("doc").cast("long") % 7 == 0, F.concat(F.lit('{"doc": "'), "doc")),
        F.when(F.col("doc").cast("long") % 5 == 0, "  ")))).alias("value"))
    lines.write.text(path)
    rows, bad = R.read_chunks(spark, path)
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"),
                     F.sum(F.length("text")).alias("chars"),
                     (F.count_distinct("pos") == F.count("*")).alias("in_order"))
    return found.crossJoin(F.broadcast(bad))  # two single rows


@query("term_files", f"""WITH {_PT} SELECT category, alias || ' ' || alias_ord AS alias, canonical
  FROM pt""")
def term_files(spark, sf_dir):
    """A term table as JSON objects with notes and other values in them, one a file, read as rows."""
    pt = _part_terms(spark, sf_dir).withColumn("alias", F.concat_ws(" ", "alias", "alias_ord"))
    pt = pt.withColumn("file", F.floor(F.col("alias_ord") / TERMS_PER_FILE))
    entries = F.map_from_entries(F.array_append(F.array_sort(F.collect_list(
        F.struct("alias", "canonical"))), F.struct(F.lit("_note").alias("alias"),
                                                   F.lit("about").alias("canonical"))))
    cats = pt.groupBy("file", "category").agg(F.to_json(entries).alias("body"))
    body = F.concat_ws(", ", F.array_append(F.array_sort(F.collect_list(F.concat(
        F.lit('"'), "category", F.lit('": '), F.concat(F.lit('{"count": 5, '), F.substr(
            "body", F.lit(2)))))), F.lit('"note": "a text"')))
    path = new_path(spark, "terms")
    (cats.groupBy("file").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).select("value")
     .write.option("maxRecordsPerFile", 1).text(path))
    return R.read_terms(spark, path).select("category", "alias", "canonical")


@query("gold_files", """SELECT md5(trim(text)) AS query_md5, CASE WHEN item_id % 2 = 0 THEN 'zh'
    ELSE 'en' END AS language, CASE WHEN item_id % 3 = 0 THEN 'unknown' ELSE 'c' || item_id % 3 END
  AS intent, CAST(item_id AS VARCHAR) AS document, item_id % 4 AS n_chunks
FROM benchmark WHERE trim(text) <> ''""")
def gold_files(spark, sf_dir):
    """The benchmark as gold questions in JSON lines, with broken lines between them."""
    i = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(
        F.concat(F.lit(" "), "text", F.lit(" ")).alias("question"),
        F.when(i % 2 == 0, "zh").otherwise("en").alias("q_lang"),
        F.when(i % 3 != 0, F.concat(F.lit("c"), (i % 3).cast("string"))).alias("category"),
        i.cast("string").alias("ref_doc_id"),
        F.array_repeat(F.lit("a"), (i % 4).cast("int")).alias("anchors"))).alias("value"))
    path = new_path(spark, "gold")
    b.unionAll(b.selectExpr("substr(value, 1, 20)")).write.text(path)
    g = R.read_gold(spark, path, [])
    return g.select(F.md5("query").alias("query_md5"), "language", "intent",
                    F.get("gold_document_ids", F.lit(0)).alias("document"),
                    F.size("gold_chunk_ids").cast("long").alias("n_chunks"))


@query("intent_samples", """SELECT conv_id, turn, md5(text) AS query_md5, turn % 2 = 0
  AS rule_backstop FROM conversations""")
def intent_samples(spark, sf_dir):
    """All turns as samples, one file with one object per group of conversations."""
    sample = F.struct(
        F.to_json(F.struct("conv_id", "turn", "text")).alias("query"), F.lit("en").alias("language"),
        F.lit("harvest").alias("intent"),
        F.when(F.col("turn") % 2 == 0, True).alias("rule_backstop"))
    path = new_path(spark, "samples")
    (table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 20).alias("g"))
     .agg(F.collect_list(sample).alias("samples")).select("samples")
     .write.option("maxRecordsPerFile", 1).json(path))
    s = R.read_intent_samples(spark, path).withColumn(
        "q", F.from_json("query", "conv_id long, turn long, text string"))
    return s.select("q.conv_id", "q.turn", F.md5("q.text").alias("query_md5"), "rule_backstop")


@query("page_files", """SELECT source AS doc, CAST(doc_id AS INTEGER) AS page, md5(text) AS text_md5
FROM documents""")
def page_files(spark, sf_dir):
    """Documents as the pages of their source, as extracted text on disk."""
    path = new_path(spark, "pages")
    table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "text",
        F.lit("x").alias("other")).write.parquet(path)
    return R.read_pages(spark, path).select("doc", "page", F.md5("text").alias("text_md5"))


@query("ops_files", """SELECT c_name AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'default'
    ELSE 't' || c_nationkey END AS tenant_id, CASE WHEN c_custkey % 4 = 0 THEN 'worker' ELSE 'manager'
    END AS role, '' AS display_name, '' AS orchard_scope FROM customer""")
def ops_files(spark, sf_dir):
    """Customers as users with gaps: missing columns and values come back as defaults."""
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("user_id"),
        F.when(k % 3 != 0, F.concat(F.lit("t"), F.col("c_nationkey").cast("string")))
        .alias("tenant_id"), F.when(k % 4 != 0, "manager").alias("role"), F.lit(1).alias("other"))
    path = new_path(spark, "ops")
    W.write_ops(users, path, "users")
    return R.read_ops(spark, path, ("users",))["users"].drop("created_at")


@query("trace_files", """SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS route,
  CAST(user_id AS VARCHAR) AS user_id FROM events
ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1000""")
def trace_files(spark, sf_dir):
    """Events as traces in batches, one of them written twice; the newest thousand."""
    e = table(spark, sf_dir, "events").select(
        "ts", F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("route"),
        F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 3).alias("b"))
    path = new_path(spark, "trace")
    for batch in (0, 1, 1, 2):
        W.write_trace(e.where(F.col("b") == batch).drop("b"), path, batch)
    return R.read_trace(spark, path).select("trace_id", "route", "user_id")


@query("concept_files", ORACLES["concept_ids"])
def concept_files(spark, sf_dir):
    """The vocabulary rebuilt from terms, stored, and loaded."""
    path = new_path(spark, "concepts")
    W.write_concepts(R.read_concepts(spark, path, _part_terms(spark, sf_dir)), path)
    c = R.read_concepts(spark, path)
    sizes = [F.size("aliases." + g) for g in ("zh", "en", "th", "ms")]
    return c.select("canonical_name", "type", "canonical_id",
                    F.concat_ws(",", "source_categories").alias("source_categories"),
                    sum(sizes[1:], sizes[0]).cast("long").alias("n_aliases"),
                    F.size("aliases.th").cast("long").alias("n_th"),
                    F.size("aliases.zh").cast("long").alias("n_zh"))


_LATEX = (r" 50 \mathrm{mm} 40\% 20 \sim 25^{\circ} \mathrm{C} 30 ^{\circ} \mathrm{C} 3 \times 4 \pm 2 \mu m"
          r" \geqslant 5 a\_b")


@query("normalize_units", "SELECT doc_id, md5(text || ' 50 mm 40% 20–25℃ 30℃ 3 × 4 ± 2 μ m ≥ 5 a_b') AS text_md5 FROM documents")
def normalize_units(spark, sf_dir):
    """Whole texts with measures in LaTeX behind them."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.md5(C.normalize_units(F.concat("text", F.lit(_LATEX))))
                    .alias("text_md5"))


@query("caption_rescue", """WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text,
    '[^A-Za-z ]+'))) AS words FROM documents), c AS (SELECT doc_id,
    regexp_replace(words, ' +', ' ', 'g') AS words FROM l)
SELECT doc_id, CASE WHEN length(words) >= 8
  AND (length(replace(words, ' ', '')) + 5) / (length(words) + 8) >= 0.55 THEN 'Table ' || (doc_id % 9 + 1) || ' ' || words END
  AS caption, count(*) AS n FROM c WHERE length(words) BETWEEN 4 AND 55 GROUP BY ALL""")
def caption_rescue(spark, sf_dir):
    """Runs of words as captions of damaged tables, with cells and numbers around them.

    A caption has eight characters behind its label, and 0.55 of all its characters are letters.
    """
    # Between the runs: no letter, from the first sign that is no space either.  As ranges, in which
    # Java searches faster than in what [^...] leaves.  Spaces are folded before, in whole texts.
    other = r"\[-`{-\x{10ffff}]"
    between = r"[\x00-\x1f!-@" + other + r"[\x00-@" + other + "*+"
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.split(
        F.regexp_replace("text", " {2,}", " "), between)).alias("words"))
    d = d.withColumn("words", F.trim("words"))
    raw = F.concat(F.lit("<td>1</td> Table "), (F.col("doc_id") % 9 + 1).cast("string"),
                   F.lit(". "), "words", F.lit("</td> 12.5 33 <td>7</td>"))
    return d.where(F.length("words").between(4, 55)).groupBy(
        "doc_id", C.extract_caption(raw).alias("caption")).agg(F.count("*").alias("n"))


def _describe(blobs: list[bytes]) -> list[str]:
    """Stands in for a vision model; it fails on what begins with a mark."""
    if any(b.startswith(b"!") for b in blobs):
        raise RuntimeError("no model")
    return [json.dumps({"description": f"{len(b)} bytes"}) for b in blobs]


@query("enrich_images", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0
  THEN strlen(text) || ' bytes' ELSE source END AS text,
  CASE WHEN doc_id % 9 = 0 THEN 'no model' END AS enrich_error FROM documents""")
def enrich_images(spark, sf_dir):
    """Every third document as an image, of which every third fails and keeps its text."""
    i = F.col("doc_id")
    blocks = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 6 == 0, "scan_page").when(i % 3 == 0, "image").otherwise("text")
        .alias("block_type"), F.col("source").alias("text"),
        F.encode(F.concat(F.when(i % 9 == 0, "!").otherwise(""), "text"), "utf-8").alias("content"))
    return MO.enrich_images(blocks, _describe).select("doc_id", "text", "enrich_error")
