"""Cleaning, grading, splitting, deduplication, blocks and tables over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.splitting import split_text
from ..functions.text import fold_spaces, once, repair_thai, spread
from ..models import register_chunk_table, with_model
from ..operators import blocks as B
from ..operators import corpus as O
from ..plans.corpus_build import build_corpus, grade_raw, parse_pages, salvage, salvage_graded
from ..sources.stage import staged
from ..sources.writers import search_table
from .base import documents, query, table

_WS = "[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}" \
    "\\x{202f}\\x{205f}\\x{3000}]"


def fold_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '{_WS}+', ' ', 'g'))"


def residue_sql(out: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``out(id, raw, t)``: residue stripping without lookaround, RE2 only.

    Long texts are cut into characters once; the neighbours are read from that list.
    """
    q = "''"
    word = r"[\p{L}\p{N}_]"
    keys = "bbox|type|content|index|angle|lines|spans|blocks|html|score"
    return f"""
{out}_a AS (SELECT {key} AS id, {text} AS raw, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({text},
  '["{q}](?:{keys})["{q}]\\s*:\\s*', ' ', 'g'),
  '["{q}](?:text|title|list|table|image|header|footer|code|index)["{q}]', ' ', 'g'),
  '(?i)</?(?:table|tr|td|th|thead|tbody)\\b[^>]*>', ' ', 'g'),
  '</?[a-zA-Z][^>]{{0,60}}>', ' ', 'g'),
  '&(?:#x?[0-9a-fA-F]+|amp|quot|lt|gt|nbsp|apos);', ' ', 'g'),
  'https?://[^ \\t\\n\\r\\f\\x{{a0}}\\x{{2028}}]+', ' ', 'g'), '[\\[\\]{{}}]+', ' ', 'g') AS t
  FROM {source}),
{out}_b AS (SELECT id, raw, t, string_split(t, '') AS ch FROM {out}_a),
{out}_c AS (SELECT id, raw, array_to_string(list_transform(ch, lambda c, i: CASE WHEN c IN ('{q}',
  '"') AND NOT regexp_matches(coalesce(ch[i - 1], ''), '{word}')
  AND NOT regexp_matches(coalesce(ch[i + 1], ''), '{word}') THEN ' ' ELSE c END), '') AS t
  FROM {out}_b),
{out}_d AS (SELECT id, raw, trim(trim(regexp_replace(regexp_replace(t,
  '(?:\\s*,\\s*){{2,}}|(?:\\s*{q}\\s*){{2,}}', ' ', 'g'), '{_WS}+', ' ', 'g')), ' ,;{q}"') AS t
  FROM {out}_c),
{out}_e AS (SELECT id, raw, regexp_replace(regexp_replace(regexp_replace(t,
  '{q}\\s*([^{q}]{{1,40}}?)\\s*{q}', '\\1', 'g'), '{q}\\s*([^{q}]{{1,40}}?)\\s*{q}', '\\1', 'g'),
  '{q}\\s*([^{q}]{{1,40}}?)\\s*{q}', '\\1', 'g') AS t FROM {out}_d),
{out}_f AS (SELECT id, raw, t, string_split(t, '') AS ch FROM {out}_e),
{out}_g AS (SELECT id, raw, CASE WHEN contains(t, '{q}') THEN array_to_string(list_transform(ch,
  lambda c, i: CASE WHEN c = '{q}' AND NOT (regexp_matches(coalesce(ch[i - 1], ''), '[A-Za-z]')
  AND regexp_matches(coalesce(ch[i + 1], ''), '[A-Za-z]')) THEN ' ' ELSE c END), '') ELSE t END
  AS t FROM {out}_f),
{out} AS (SELECT id, raw, trim({fold_sql("t")}, ' ,;{q}"') AS t FROM {out}_g)"""


_LETTERS = "[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{e00}-\\x{e7f}A-Za-z]"


def count_sql(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, '{pattern}'))"


_RATIO = f"({count_sql('t', _LETTERS)} / greatest(length(t), 1))"
_GRADE = f"""CASE WHEN length(t) < 60 THEN 'junk'
  WHEN regexp_matches(raw, '(?i)</?t[dhr]\\b|</?table\\b') THEN 'table_fragment'
  WHEN {_RATIO} < 0.55 THEN 'junk'
  WHEN {count_sql('t', "[0-9²³¹⁰⁴-⁹₀-₉]")} / length(t) > 0.35 THEN 'junk' ELSE 'usable' END"""


@query("clean_text", f"""WITH {residue_sql("r", "pages", "page_id", "html")}
SELECT id AS page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM r""")
def clean_text(spark, sf_dir):
    p = once(spread(table(spark, sf_dir, "pages")), "t", C.strip_residue("html"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"),
                    F.md5("t").alias("text_md5"))


def _raw(spark, sf_dir):
    """Driver documents as raw chunks; a third plays clean question-answer pairs."""
    d = spread(table(spark, sf_dir, "documents"))
    faq = F.concat(F.lit("FAQ_en_"), (F.col("doc_id") % 7).cast("string"))
    doc = (F.when(F.col("doc_id") % 6 == 0, faq)
           .when(F.col("doc_id") % 6 == 1, F.concat("source", F.lit(".docx")))
           .otherwise(F.col("source")))
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("pos"), doc.alias("doc"), none.alias("source_file"),
                    "text", F.lit(None).cast("int").alias("page"), none.alias("category"),
                    none.alias("question"))


@query("quality_grade", f"""WITH {residue_sql("r", "documents", "doc_id", "text")}
SELECT id AS doc_id, {_GRADE} AS grade, length(t) AS n_chars, round({_RATIO}, 6) AS word_ratio
FROM r""")
def quality_grade(spark, sf_dir):
    d = once(spread(table(spark, sf_dir, "documents")), "t", C.strip_residue("text"))
    d = once(d, "ratio", C.word_ratio("t"))
    return d.select("doc_id", C.grade("text", "t", F.col("ratio")).alias("grade"),
                    F.length("t").cast("long").alias("n_chars"),
                    F.round("ratio", 6).alias("word_ratio"))


@query("grade_vs_labels", f"""WITH {residue_sql("r", "documents", "doc_id", "text")},
g AS (SELECT id, {_GRADE} AS grade FROM r)
SELECT grade, quality, count(*) AS n FROM g JOIN labels ON doc_id = id GROUP BY grade, quality""")
def grade_vs_labels(spark, sf_dir):
    return (quality_grade(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
            .groupBy("grade", "quality").agg(F.count("*").alias("n")))


def splits_sql(out: str, source: str, size: int, overlap: int) -> str:
    """CTEs ending in ``out(id, piece, text)`` from ``source(id, t)``; recursive windows."""
    return f"""{out}_w AS (
  SELECT id, t, 0 AS piece, 0 AS lo, {_stop_sql('t', '0', size)} AS hi FROM {source}
    WHERE length(t) > {size}
  UNION ALL
  SELECT id, t, piece + 1, greatest(hi - {overlap}, lo + 1),
    {_stop_sql('t', f'greatest(hi - {overlap}, lo + 1)', size)}
  FROM {out}_w WHERE hi < length(t)),
{out}_k AS (SELECT id, piece, {strip_sql('substr(t, lo + 1, hi - lo)')} AS text FROM {out}_w
  UNION ALL SELECT id, 0, t FROM {source} WHERE length(t) <= {size}),
{out} AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY piece) - 1 AS piece
  FROM {out}_k WHERE length(text) >= 60)"""


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def _stop_sql(t: str, lo: str, size: int) -> str:
    win = f"substr({t}, {lo} + 1, {size})"
    strong = f"(length(regexp_extract({win}, '(?s)^.*[。.；;\\n]')) - 1)"
    weak = f"(length(regexp_extract({win}, '(?s)^.*[，, ]')) - 1)"
    cut = f"(CASE WHEN {strong} < {size} * 0.5 THEN {weak} ELSE {strong} END)"
    return (f"(CASE WHEN {lo} + {size} >= length({t}) THEN length({t}) WHEN {cut} > {size} * 0.4 "
            f"THEN {lo} + {cut} + 1 ELSE {lo} + {size} END)")


@query("split_chunks", f"""WITH RECURSIVE src AS (SELECT doc_id AS id, {strip_sql('text')} AS t
  FROM documents), {splits_sql('s', 'src', 900, 150)}
SELECT id AS doc_id, CAST(piece AS INTEGER) AS piece, length(text) AS n_chars,
  md5(text) AS text_md5 FROM s""")
def split_chunks(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    p = d.select("doc_id", F.posexplode(split_text("text")).alias("piece", "t"))
    return p.select("doc_id", "piece", F.length("t").cast("long").alias("n_chars"),
                    F.md5("t").alias("text_md5"))


@query("chunk_ids", f"""WITH RECURSIVE src AS (SELECT doc_id AS id, {strip_sql('text')} AS t
  FROM documents), {splits_sql('s', 'src', 900, 150)},
n AS (SELECT s.*, d.source, row_number() OVER (PARTITION BY d.source ORDER BY id, piece) AS seq
  FROM s JOIN documents d ON d.doc_id = id)
SELECT id AS doc_id, CAST(piece AS INTEGER) AS piece, seq,
  sha1(source || ':None:' || seq || ':' || sha1(text)) AS chunk_id FROM n""")
def chunk_ids(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    p = d.select("doc_id", "source", F.posexplode(split_text("text")).alias("piece", "t"))
    p = O.with_seq(p, "source", ("doc_id", "piece"))
    return p.select("doc_id", "piece", "seq", C.chunk_id(
        F.col("source"), F.lit(None).cast("int"), F.col("seq"), F.col("t")).alias("chunk_id"))


_SALVAGE = f"""WITH RECURSIVE raw AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0
    THEN 'FAQ_en_' || (doc_id % 7) WHEN doc_id % 6 = 1 THEN source || '.docx' ELSE source END
    AS doc, CASE WHEN doc_id % 6 = 0 THEN 'faq' WHEN doc_id % 6 = 1 THEN 'thai_docx'
    ELSE 'literature' END AS grp FROM documents),
lit AS (SELECT doc_id, text FROM raw WHERE grp = 'literature'),
{residue_sql("r", "lit", "doc_id", "text")}, graded AS (SELECT id, t, {_GRADE} AS grade FROM r),
src AS (SELECT id, t FROM graded WHERE grade = 'usable'), {splits_sql('s', 'src', 900, 150)},
clean AS (SELECT doc_id AS id, {fold_sql('text')} AS text, grp FROM raw WHERE grp <> 'literature'),
made AS (SELECT id, piece, text, 'text' AS block_type, 'legacy_lit_salvage' AS provenance FROM s
  UNION ALL SELECT id, 0, text, CASE WHEN grp = 'faq' THEN 'qa_pair' ELSE 'text' END,
    CASE WHEN grp = 'faq' THEN 'legacy_faq' ELSE 'legacy_thai' END FROM clean
  WHERE length(text) >= 20)
"""


@query("salvage_chunks", _SALVAGE + """SELECT sha1(doc || ':None:' || row_number() OVER (
    PARTITION BY doc ORDER BY id, piece) || ':' || sha1(made.text)) AS id, block_type, provenance
FROM made JOIN raw ON raw.doc_id = made.id""")
def salvage_chunks(spark, sf_dir):
    return salvage(_raw(spark, sf_dir)).select("id", "block_type", "provenance")


@query("corpus_profile", _SALVAGE + """SELECT block_type, provenance, count(*) AS n FROM made
GROUP BY GROUPING SETS ((block_type), (provenance))""")
def corpus_profile(spark, sf_dir):
    return O.corpus_profile(salvage(_raw(spark, sf_dir)))


@query("corpus_stats", _SALVAGE + """, c AS (SELECT 'legacy_in_' || grp AS counter FROM raw
  UNION ALL SELECT 'lit_grade_' || grade FROM graded
  UNION ALL SELECT CASE provenance WHEN 'legacy_faq' THEN 'out_faq' WHEN 'legacy_thai'
    THEN 'out_thai' ELSE 'out_literature' END FROM made)
SELECT counter, count(*) AS n FROM c GROUP BY counter""")
def corpus_stats(spark, sf_dir):
    graded = staged(grade_raw(_raw(spark, sf_dir)), "graded")
    return O.corpus_stats(graded, salvage_graded(graded))


@query("exclude_docs", """SELECT doc_id FROM documents WHERE NOT contains(source, 'src1')
  AND length(text) >= 60""")
def exclude_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "doc")
    return O.min_len(O.exclude_docs(d, ["src1"]), 60).select("doc_id")


_KEY = "substr(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g'), 1, 400)"


@query("dedup_first_wins", f"""SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents
WHERE {_KEY} <> '' GROUP BY {_KEY}""")
def dedup_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("index_text"))
    kept = O.dedup_chunks(d, ["doc_id"])
    copies = d.groupBy(C.dedup_key("index_text").alias("k")).agg(F.count("*").alias("n"))
    return (kept.withColumn("k", C.dedup_key("index_text")).join(copies, "k")
            .select("doc_id", "n"))


@query("dedup_removed", f"""SELECT CAST(count(*) - count(DISTINCT nullif({_KEY}, '')) AS BIGINT)
AS dedup_removed FROM documents""")
def dedup_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("index_text"))
    return O.dedup_removed(d, ["doc_id"])


def _pages(spark, sf_dir):
    """Hosts as documents, their pages as page rows, and one mirrored copy of every host."""
    p = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("doc"),
        F.col("page_id").cast("int").alias("page"), F.col("html").alias("text"))
    return p.unionByName(p.withColumn("doc", F.concat(F.lit("mirror."), "doc")))


_PAGES = """h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS doc, page_id AS page,
  html AS text FROM pages), pg AS (SELECT * FROM h UNION ALL
  SELECT 'mirror.' || doc, page, text FROM h)"""


@query("dedup_pages", f"""WITH {_PAGES}, k AS (SELECT doc, sha1(string_agg(text, '' ORDER BY page))
  AS content_key FROM pg GROUP BY doc)
SELECT min(doc) AS doc, count(*) AS n_copies FROM k GROUP BY content_key""")
def dedup_pages(spark, sf_dir):
    return O.dedup_documents(_pages(spark, sf_dir)).select("doc", "n_copies")


@query("sparse_documents", f"""WITH {_PAGES}, s AS (SELECT doc, count(*) AS n_pages,
  length({strip_sql("string_agg(text, '' ORDER BY page)")}) AS n_chars FROM pg GROUP BY doc)
SELECT doc, n_pages, n_chars, n_chars < 200 * n_pages / 10 AS needs_ocr FROM s""")
def sparse_documents(spark, sf_dir):
    return O.flag_sparse_docs(_pages(spark, sf_dir))


@query("keep_body", f"""WITH {residue_sql("r", "pages", "page_id", "html")}
SELECT id AS page_id FROM r WHERE length(t) >= 60 AND {_RATIO} >= 0.5""")
def keep_body(spark, sf_dir):
    p = once(spread(table(spark, sf_dir, "pages")), "t", C.strip_residue("html"))
    return O.keep_body(p, "t").select("page_id")


def _overrides(spark):
    return spark.createDataFrame([("www.", 0, 300, 50), ("blog.t", 1, 600, 100),
                                  ("blog.", 2, 400, 60)],
                                 "prefix string, ord int, size int, overlap int")


@query("chunk_params", f"""WITH {_PAGES} SELECT DISTINCT doc, CAST(CASE WHEN doc LIKE 'www.%'
  THEN 300 WHEN doc LIKE 'blog.t%' THEN 600 WHEN doc LIKE 'blog.%' THEN 400 ELSE 900 END
  AS INTEGER) AS size, CAST(CASE WHEN doc LIKE 'www.%' THEN 50 WHEN doc LIKE 'blog.t%' THEN 100
  WHEN doc LIKE 'blog.%' THEN 60 ELSE 150 END AS INTEGER) AS overlap FROM pg""")
def chunk_params(spark, sf_dir):
    docs = _pages(spark, sf_dir).select("doc").distinct()
    return O.with_chunk_params(docs, _overrides(spark)).select("doc", "size", "overlap")


def _page_tables(spark, sf_dir):
    """The menu of every page as a table, with the box of the first block of the page."""
    p = _pages(spark, sf_dir)
    links = F.regexp_extract_all("text", F.lit('<li><a href="([^"]*)">([^<]*)'), F.lit(2))
    lines = F.transform(links, lambda x: F.concat(F.lit("|"), x, F.lit("|menu|")))
    md = F.concat_ws("\n", F.lit("|name|kind|"), F.lit("|---|---|"), F.concat_ws("\n", lines))
    box = [F.lit(v).alias(k) for k, v in (("x0", 2), ("y0", 2), ("x1", 98), ("y1", 48))]
    return p.select("doc", "page", F.lit(1).alias("table_no"), md.alias("markdown"), *box)


def _page_blocks(spark, sf_dir):
    """Pages cut at the end of their menu: one block in the table's box, one below it."""
    p = _pages(spark, sf_dir)
    at = F.locate("</nav>", "text")
    parts = F.array(F.struct(F.lit(0).alias("block_no"), F.substring("text", F.lit(1), at + 5)
                             .alias("text"), F.lit(0).alias("y0"), F.lit(50).alias("y1")),
                    F.struct(F.lit(1).alias("block_no"), F.substring(
                        "text", at + 6, F.length("text")).alias("text"), F.lit(50).alias("y0"),
                        F.lit(100).alias("y1")))
    return p.select("doc", "page", F.inline(parts), F.lit(0).alias("x0"), F.lit(100).alias("x1"))


_MENU = "regexp_extract_all(text, '<li><a href=\"([^\"]*)\">([^<]*)', 2)"

# Chunks of the kept pages: menus as tables where they are valid, bodies split with the sizes of
# their documents.
_PARSED = f"""{_PAGES}, key AS (SELECT doc, sha1(string_agg(text, '' ORDER BY page)) AS k,
    count(*) AS n, length({strip_sql("string_agg(text, '' ORDER BY page)")}) AS c
  FROM pg GROUP BY doc),
kept AS (SELECT min(doc) AS doc FROM key GROUP BY k),
pk AS (SELECT pg.* FROM pg JOIN kept USING (doc) JOIN key USING (doc) WHERE NOT c < 200 * n / 10),
menu AS (SELECT doc, page, text, {_MENU} AS cells FROM pk),
cell AS (SELECT doc, page, trim(unnest(cells)) AS c FROM menu),
good AS (SELECT doc, page, count(DISTINCT c) + 1 > 2 AND
    len(regexp_extract_all(string_agg(c || ' menu', ' '), '{_LETTERS}')) /
      length(string_agg(c || ' menu', ' ')) >= 0.25 AS valid
  FROM cell WHERE c <> '' GROUP BY doc, page),
md AS (SELECT m.doc, m.page, '|name|kind|' || chr(10) || '|---|---|' || chr(10) || array_to_string(
    list_transform(cells, lambda x: '|' || x || '|menu|'), chr(10)) AS md,
    coalesce(valid, FALSE) AND len(cells) > 0 AND len(list_filter(cells, lambda x:
      contains(x, chr(10)) OR contains(x, '|'))) = 0 AS valid
  FROM menu m LEFT JOIN good USING (doc, page)),
body AS (SELECT pk.doc, pk.page, doc || '#' || page AS k, CASE WHEN valid
    THEN substr(text, strpos(text, '</nav>') + 6) ELSE text END AS text
  FROM pk JOIN md USING (doc, page)),
{residue_sql("pr", "body", "k", "text")},
sized AS (SELECT k AS id, t, CAST(CASE WHEN doc LIKE 'www.%' THEN 300 WHEN doc LIKE 'blog.t%' THEN 600
    WHEN doc LIKE 'blog.%' THEN 400 ELSE 900 END AS INTEGER) AS size
  FROM body JOIN pr ON pr.id = k WHERE length(t) >= 60 AND {_RATIO} >= 0.5),
{", ".join(f"z{n} AS (SELECT id, t FROM sized WHERE size = {n}), "
           + splits_sql(f"q{n}", f"z{n}", n, o)
           for n, o in ((300, 50), (600, 100), (400, 60), (900, 150)))},
parts AS (SELECT doc, page, 1 AS kind, 0 AS piece, 'table' AS block_type, substr('【表格】' ||
    '|name|kind|' || chr(10) || md, 1, 2400) AS text FROM md WHERE valid
  UNION ALL SELECT doc, page, 9, piece, 'text', q.text FROM body JOIN (SELECT * FROM q300
    UNION ALL SELECT * FROM q600 UNION ALL SELECT * FROM q400 UNION ALL SELECT * FROM q900) q
    ON q.id = k),
parsed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, kind, piece) AS seq
  FROM parts)"""


@query("parse_pages", f"""WITH RECURSIVE {_PARSED}
SELECT sha1(doc || ':' || page || ':' || seq || ':' || sha1(text)) AS id, doc, page::INTEGER AS page,
  block_type, seq, length(text) AS n_chars FROM parsed""")
def parse_pages_query(spark, sf_dir):
    return parse_pages(_pages(spark, sf_dir), _overrides(spark), _page_tables(spark, sf_dir),
                       _page_blocks(spark, sf_dir)).select(
        "id", "doc", "page", "block_type", "seq", F.length("index_text").cast("long")
        .alias("n_chars"))


@query("build_corpus", _SALVAGE.replace("FROM documents)", "FROM documents WHERE NOT contains("
                                        "CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END, 'src19'))", 1)
       + f""", {_PARSED},
both_ AS (SELECT sha1(doc || ':None:' || s || ':' || sha1(text)) AS id, doc, block_type, provenance, text,
    0 AS o, id AS pos, s FROM (SELECT made.*, doc, row_number() OVER (PARTITION BY doc
    ORDER BY id, piece) AS s FROM made JOIN raw ON raw.doc_id = made.id)
  UNION ALL SELECT sha1(doc || ':' || page || ':' || seq || ':' || sha1(text)), doc, block_type,
    'pdf_parse', text, 1, page, seq FROM parsed),
f AS (SELECT *, {_KEY} AS k FROM both_)
SELECT id, doc, block_type, provenance FROM f WHERE k <> ''
QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, pos, doc, s) = 1""")
def build_corpus_query(spark, sf_dir):
    c = build_corpus(_raw(spark, sf_dir), _pages(spark, sf_dir), _overrides(spark), ["src19"],
                     _page_tables(spark, sf_dir), _page_blocks(spark, sf_dir))
    return c.select("id", "doc", "block_type", "provenance")


@query("drop_counters", _SALVAGE.replace("FROM documents)", "FROM documents WHERE NOT contains("
                                         "CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END, 'src19'))", 1)
       + f""", {_PARSED}, texts AS (SELECT {_KEY} AS k FROM (SELECT text FROM made UNION ALL
    SELECT text FROM parsed)),
c AS (SELECT 'salvage_excluded' AS counter, (SELECT count(*) FROM documents) - count(*) AS n FROM raw
  UNION ALL SELECT 'faq_dropped', count(*) - (SELECT count(*) FROM made WHERE
    provenance = 'legacy_faq') FROM raw WHERE grp = 'faq'
  UNION ALL SELECT 'thai_dropped', count(*) - (SELECT count(*) FROM made WHERE
    provenance = 'legacy_thai') FROM raw WHERE grp = 'thai_docx'
  UNION ALL SELECT 'table_frag_no_caption_dropped', count(*) FROM graded
    WHERE grade = 'table_fragment'
  UNION ALL SELECT 'pdf_duplicate', count(*) - count(DISTINCT k) FROM key
  UNION ALL SELECT 'pdf_needs_ocr', count(*) FROM kept JOIN key USING (doc) WHERE c < 200 * n / 10
  UNION ALL SELECT 'dedup_removed', count(*) - count(DISTINCT nullif(k, '')) FROM texts)
SELECT counter, n::BIGINT AS n FROM c WHERE n > 0""")
def drop_counters(spark, sf_dir):
    """Counts of what the corpus build leaves out, step by step."""
    raw, pages = _raw(spark, sf_dir), _pages(spark, sf_dir)
    graded = staged(grade_raw(raw, ["src19"]), "graded")
    salvaged = staged(salvage_graded(graded), "salvaged")
    sizes = staged(O.page_sizes(pages), "sizes")
    parsed = parse_pages(pages, _overrides(spark), _page_tables(spark, sf_dir),
                         _page_blocks(spark, sf_dir), sizes)
    merged = salvaged.select("index_text").unionByName(parsed.select("index_text"))
    return O.drop_counters(raw, graded, salvaged, pages, merged, [], sizes)


@query("repair_thai", "SELECT doc_id, md5(text || ' เชื้อรา น้ำ รากเนำโคน 25˚C') AS text_md5 FROM documents")
def repair_thai_query(spark, sf_dir):
    """Documents with damaged Thai words behind them; the rest of a text stays as it is."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat(
        "text", F.lit(" เช้ือรา น้้า รากเน\u0e4d\u0e32โคน 25˚C")))
    return d.select("doc_id", F.md5(repair_thai("t")).alias("text_md5"))


# --- blocks --------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """Document lines as blocks: short lines are titles, every seventh a table, some images."""
    d = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    none = F.lit(None).cast("string")
    kind = (F.when(F.length("text") < 40, "Title").when(F.col("p") % 7 == 3, "tbl")
            .when(F.col("p") % 11 == 5, "img").when(F.col("p") % 13 == 6, "unknown"))
    return d.select("doc_id", F.col("p").cast("long").alias("pos"), kind.alias("type"), "text",
                    none.alias("content"), none.alias("image_path"),
                    F.when(F.col("p") % 2 == 0, F.col("p")).alias("page_idx"),
                    (F.col("p") % 3 == 2).alias("page_scan"))


_LINES = f"""ln AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)),
bt AS (SELECT doc_id, pos, {strip_sql('text')} AS text, CASE WHEN length(text) < 40 THEN 'title'
  WHEN pos % 7 = 3 THEN 'table' WHEN pos % 11 = 5 THEN CASE WHEN pos % 2 = 0 AND pos % 3 = 2
  THEN 'scan_page' ELSE 'image' END WHEN {strip_sql('text')} = '' THEN 'text'
  WHEN regexp_matches({strip_sql('text')}, '(?i)[.](?:jpg|jpeg|png|webp|tif|tiff|bmp)\\b') THEN 'image'
  WHEN length({strip_sql('text')}) BETWEEN 2 AND 60 AND NOT regexp_matches({strip_sql('text')},
    '[。.！!？?；;：:]$') AND regexp_matches({strip_sql('text')}, '^(?:[0-9]+[.、 ]|[IVX]+[.])')
  THEN 'title' ELSE 'text' END AS block_type FROM ln)"""


@query("block_types", f"""WITH {_LINES} SELECT block_type, count(*) AS n, sum(pos)::BIGINT AS pos
FROM bt GROUP BY block_type""")
def block_types(spark, sf_dir):
    b = B.type_blocks(_lines(spark, sf_dir))
    return b.groupBy("block_type").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


_SECTION = f"""{_LINES}, sec AS (SELECT *, coalesce(last_value(CASE WHEN block_type = 'title'
    THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS section,
  sum(CASE WHEN block_type = 'text' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos)
    AS run FROM bt)"""


@query("with_section", f"""WITH {_SECTION} SELECT doc_id, pos, section FROM sec""")
def with_section(spark, sf_dir):
    b = B.with_section(B.type_blocks(_lines(spark, sf_dir)))
    return b.select("doc_id", "pos", "section")


# Section chunks ``fin(id, piece, text)`` of ``src(id, t)``: a short tail joins the piece before it.
_PIECES = f"""{splits_sql('s', 'src', 800, 120)},
cnt AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s),
tails AS (SELECT id, text AS tail FROM cnt WHERE n >= 2 AND piece = n - 1 AND length(text) < 150),
fin AS (SELECT c.id, c.piece, CASE WHEN c.piece = c.n - 2 AND tail IS NOT NULL
    THEN {strip_sql('c.text || tail')} ELSE c.text END AS text FROM cnt c LEFT JOIN tails USING (id)
  WHERE NOT (c.piece = c.n - 1 AND tail IS NOT NULL))"""


@query("section_chunks", f"""WITH RECURSIVE {_SECTION},
runs AS (SELECT doc_id, run, block_type = 'text' AS is_text, min(pos) AS source_index,
  any_value(section) AS section, any_value(block_type) AS block_type,
  string_agg(text, chr(10) ORDER BY pos) AS t FROM sec
  WHERE block_type <> 'title' AND text <> '' GROUP BY 1, 2, 3),
src AS (SELECT doc_id * 1000000 + source_index AS id, {strip_sql('t')} AS t FROM runs
  WHERE is_text), {_PIECES}
SELECT doc_id, source_index, section, block_type, CAST(piece AS INTEGER) AS piece,
  md5(text) AS text_md5 FROM fin JOIN runs ON id = doc_id * 1000000 + source_index WHERE is_text
UNION ALL SELECT doc_id, source_index, section, block_type, 0, md5(t) FROM runs
WHERE NOT is_text""")
def section_chunks(spark, sf_dir):
    c = B.chunk_document(B.type_blocks(_lines(spark, sf_dir)))
    return c.select("doc_id", "source_index", "section", "block_type", "piece",
                    F.md5("text").alias("text_md5"))


@query("markdown_tables", """WITH t AS (SELECT p_partkey // 20 AS table_id, p_partkey AS row_no,
  '|' || p_name || '|' || replace(p_brand, '#', '\\|') || '|' || p_size || '|' || p_type || '|'
  AS line FROM part)
SELECT table_id, '|name|brand|size (mm)|type|' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg(line, chr(10) ORDER BY row_no) || chr(10) || 'parts ' || table_id AS markdown
FROM t GROUP BY table_id""")
def markdown_tables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tid = F.floor(F.col("p_partkey") / 20).alias("table_id")
    cols = ["p_name", F.replace("p_brand", F.lit("#"), F.lit("|")).alias("p_brand"), "p_size",
            "p_type"]
    wide = p.select(tid, F.col("p_partkey").alias("row"), *cols)
    cells = wide.select("table_id", "row", F.posexplode(F.array(
        *[F.col(c).cast("string") for c in ("p_name", "p_brand", "p_size", "p_type")]))
        .alias("col", "value"))
    heads = wide.select("table_id").distinct().select(
        "table_id", F.concat(F.lit("parts "), F.col("table_id").cast("string")).alias("caption"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("header"),
                                    F.lit(u).cast("string").alias("unit"))
                           for i, (h, u) in enumerate([("name", None), ("brand", ""),
                                                       ("size", "mm"), ("type", None)])])))
    return B.table_to_markdown(cells, heads)


@query("valid_tables", f"""WITH c AS (SELECT p_partkey // 20 AS table_id, unnest([p_name, p_brand,
    p_size::VARCHAR, p_type]) AS t FROM part)
SELECT table_id, count(DISTINCT t) > 2 AND len(regexp_extract_all(string_agg(t, ' '), '{_LETTERS}'))
  / length(string_agg(t, ' ')) >= 0.25 AS valid FROM c WHERE trim(t) <> '' GROUP BY 1""")
def valid_tables(spark, sf_dir):
    """Tables of all columns of the parts, twenty to a table."""
    p = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 20).alias("table_id"), "p_partkey",
        F.concat(F.lit("|"), F.concat_ws("|", "p_name", "p_brand", "p_size", "p_type"),
                 F.lit("|")).alias("line"))
    md = p.groupBy("table_id").agg(F.concat_ws(
        "\n", F.lit("|name|brand|size|type|"), F.lit("|---|---|---|---|"), F.array_sort(
            F.collect_list(F.struct("p_partkey", "line")))["line"]).alias("md"))
    return md.select("table_id", C.valid_md_table("md").alias("valid"))


@query("words_to_lines", """WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)
  - 1 AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
SELECT doc_id AS page_id, n // 10 AS line, string_agg(word, ' ' ORDER BY n) AS text,
  min(n) // 10 * 20 AS top, min(n) % 10 * 50 AS "left", sum(length(word) * 10)::BIGINT AS width
FROM w WHERE regexp_replace(word, '\\s', '', 'g') <> '' GROUP BY doc_id, n // 10""")
def words_to_lines(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", " ")).alias("n", "text"))
    words = w.select(
        "page_id", F.lit(0).alias("block"), F.lit(0).alias("par"),
        F.floor(F.col("n") / 10).alias("line"), F.col("n").alias("word_no"), "text",
        (F.floor(F.col("n") / 10) * 20).alias("top"), (F.col("n").cast("long") % 10 * 50)
        .alias("left"), (F.length("text") * 10).alias("width"), F.lit(20).alias("height"))
    return B.words_to_lines(words).select("page_id", "line", "text", "top", "left", "width")


_TEXTLINES = f"""tl AS (SELECT doc_id AS page_id, {strip_sql('t')} AS text, (p - 1) * 20 AS top
  FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT doc_id,
    string_split(text, chr(10)) AS w FROM documents)) WHERE {strip_sql('t')} <> '')"""


@query("text_to_lines", f"""WITH {_TEXTLINES} SELECT page_id, text, CAST(top AS INTEGER) AS top
FROM tl""")
def text_to_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_id")
    return B.text_to_lines(d).select("page_id", "text", "top")


_PARAGRAPHS = f"""{_TEXTLINES}, m AS (SELECT *, top + top // 100 * 45 AS y
  FROM tl), g AS (SELECT *, y - (lag(y) OVER (PARTITION BY page_id ORDER BY y) + 20) > 30 AS new
  FROM m), r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page_id
    ORDER BY y) AS par_idx FROM g),
par AS (SELECT page_id, CAST(par_idx AS BIGINT) AS par_idx, string_agg(text, ' ' ORDER BY y) AS text
  FROM r GROUP BY ALL)"""


def _page_lines(spark, sf_dir):
    """Document lines on a grid, with a gap after every fifth."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_id")
    lines = B.text_to_lines(d)
    return lines.withColumn("top", (F.col("top") + F.floor(F.col("top") / 100) * 45).cast("int"))


@query("layout_paragraphs", f"WITH {_PARAGRAPHS} SELECT page_id, par_idx, md5(text) AS text_md5 "
                            "FROM par")
def layout_paragraphs(spark, sf_dir):
    p = B.restore_layout(_page_lines(spark, sf_dir))
    return p.select("page_id", F.col("par_idx").cast("long").alias("par_idx"),
                    F.md5("text").alias("text_md5"))


@query("chunk_table", f"""WITH RECURSIVE src AS (SELECT doc_id AS id, {strip_sql('text')} AS t
  FROM documents), {_PIECES}
SELECT doc_id, source, CAST(piece AS INTEGER) AS piece, md5(f.text) AS text_md5
FROM fin f JOIN documents ON id = doc_id""")
def chunk_table(spark, sf_dir):
    """Whole texts through the SQL table function, other columns passed on."""
    register_chunk_table(spark)
    name = f"documents_{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", "source", "text").createOrReplaceTempView(name)
    return spark.sql(f"SELECT doc_id, source, piece, md5(chunk) AS text_md5 "
                     f"FROM chunk_table(TABLE({name}), 'text')")


@query("pages_to_chunks", f"""WITH RECURSIVE {_PARAGRAPHS}, src AS (SELECT page_id // 5 AS id,
    string_agg(text, chr(10) ORDER BY page_id % 5, par_idx) AS t FROM par GROUP BY 1), {_PIECES}
SELECT id AS doc_id, CAST(piece AS INTEGER) AS piece, md5(text) AS text_md5 FROM fin""")
def pages_to_chunks(spark, sf_dir):
    """Five documents as the scanned pages of one: layout, paragraphs, section chunks."""
    page = F.col("page_id")
    lines = _page_lines(spark, sf_dir).withColumns({
        "doc_id": F.floor(page / 5), "page_idx": (page % 5).cast("int")})
    return B.pages_to_chunks(lines).select("doc_id", "piece", F.md5("text").alias("text_md5"))


@query("blocks_outside_tables", """WITH b AS (SELECT event_id, user_id AS doc, event_id % 3 AS page,
  value AS x0, value * 2 AS y0, value + 10 AS x1, value * 2 + 5 AS y1, event_type FROM events)
SELECT event_id FROM b WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM b t
  WHERE t.event_type = 'error' AND t.doc = b.doc AND t.page = b.page AND b.x0 >= t.x0 - 4
  AND b.y0 >= t.y0 - 4 AND b.x1 <= t.x1 + 4 AND b.y1 <= t.y1 + 4)""")
def blocks_outside_tables(spark, sf_dir):
    v = F.col("value")
    b = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("user_id").alias("doc"),
        (F.col("event_id") % 3).alias("page"), v.alias("x0"), (v * 2).alias("y0"),
        (v + 10).alias("x1"), (v * 2 + 5).alias("y1"))
    return O.blocks_outside_tables(b.filter("event_type <> 'error'"),
                                   b.filter("event_type = 'error'")).select("event_id")


@query("search_table", """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'default' AS tenant_id,
  md5(substr(text, 1, 4095)) AS text_md5, source AS document_id, lang AS language,
  'general' AS domain, 'document' AS source_type FROM documents""")
def search_table_query(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("orchard_scope", F.array().cast("array<string>"))
    d = d.withColumn("role_scope", F.array(F.lit("worker")))
    return search_table(d).select("chunk_id", "tenant_id", F.md5("text").alias("text_md5"),
                                  "document_id", "language", "domain", "source_type")


@query("source_groups", """SELECT CASE WHEN doc_id % 6 = 0 THEN 'faq' WHEN doc_id % 6 = 1
  THEN 'thai_docx' ELSE 'literature' END AS source_group, count(*) AS n FROM documents
GROUP BY 1""")
def source_groups(spark, sf_dir):
    g = _raw(spark, sf_dir).select(C.source_group("doc").alias("source_group"))
    return g.groupBy("source_group").agg(F.count("*").alias("n"))


@query("fold_spaces", f"""SELECT doc_id, md5({fold_sql('text')}) AS text_md5 FROM documents""")
def fold_spaces_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(fold_spaces(F.col("text"))).alias("text_md5"))


@query("model_hook", """SELECT doc_id, length(text) AS n_chars, CASE WHEN doc_id % 10 = 0
  THEN 'bad row' END AS failure FROM documents""")
def model_hook(spark, sf_dir):
    """A batched hook whose stand-in model fails on some rows; they keep their data."""
    def size(ids, texts):
        if any(i % 10 == 0 for i in ids):
            raise ValueError("bad row")
        return [len(t) for t in texts]

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_model(d, size, ["doc_id", "text"], "n", "long", error="failure")
    return out.select("doc_id", F.coalesce("n", F.length("text").cast("long")).alias("n_chars"),
                      "failure")
