"""Corpus build: salvage of old chunks, parsing of page text, union and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import cleaning as C
from ..functions.splitting import split_text
from ..functions.text import fold_spaces, once, strip
from ..operators import corpus as O
from ..sources.stage import staged


def grade_raw(raw: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Add ``source_group``, ``cleaned`` and ``grade`` to raw chunk rows.

    ``raw``: pos, doc, source_file, text, page, category, question.
    """
    name = F.coalesce(F.nullif("doc", F.lit("")), F.nullif("source_file", F.lit("")),
                      F.lit("unknown"))
    df = raw.withColumn("doc", name).withColumn("text", F.coalesce("text", F.lit("")))
    df = O.exclude_docs(df, list(exclude))
    df = df.withColumn("source_group", C.source_group("doc"))
    lit = F.col("source_group") == "literature"
    df = once(df, "cleaned", F.when(lit, C.strip_residue("text"))
              .otherwise(fold_spaces(F.col("text"))))
    return df.withColumn("grade", F.when(lit, C.grade("text", "cleaned")))


def _chunk_columns(df: DataFrame) -> DataFrame:
    return df.select(
        C.chunk_id(F.col("doc"), F.col("page"), F.col("seq"), F.col("index_text")).alias("id"),
        "doc", F.col("doc").alias("source_file"), "page", "block_type", "provenance",
        "index_text", "display_text", F.col("index_text").alias("text"),
        F.map_filter(F.map_concat(F.create_map(F.lit("text_sha1"), F.sha1("index_text")),
                                  "extra"), lambda k, v: v.isNotNull()).alias("metadata"),
        "pos", "piece", "seq")


def _map(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])


def salvage(raw: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Old chunks to clean chunk rows: clean sources pass, literature is graded and rescued."""
    return salvage_graded(grade_raw(raw, exclude))


def salvage_graded(g: DataFrame) -> DataFrame:
    """The same of rows that ``grade_raw`` gave, for jobs that read the grades as well."""
    group, none = F.col("source_group"), F.lit(None).cast("string")
    long_enough = F.length("cleaned") >= V.MIN_CLEAN_CHARS
    usable = F.col("grade") == "usable"
    caption = C.caption_of(F.when(F.col("grade") == "table_fragment", F.col("cleaned")))
    pieces = (
        F.when(group != "literature", F.filter(F.array("cleaned"), lambda x: long_enough))
        .when(usable, split_text(F.when(usable, F.col("cleaned"))))
        .when(F.col("grade") == "table_fragment",
              F.filter(F.array(caption), lambda x: x.isNotNull())))
    p = g.select("*", F.posexplode(pieces).alias("piece", "index_text"))
    broken = F.col("grade") == "table_fragment"
    lang = F.when(F.col("doc").startswith("FAQ_zh"), "zh").otherwise(
        F.get(F.split("doc", "_"), F.lit(1)))
    extra = (
        F.when(group == "faq", _map(("category", F.col("category")),
                                    ("question", F.col("question")), ("src_lang", lang)))
        .when(group == "thai_docx", _map(("src_lang", F.lit("th")),
                                         ("needs_translation", F.lit(True)),
                                         ("original_text", F.col("cleaned"))))
        .when(broken, _map(("caption", F.col("index_text")), ("damaged", F.lit(True)),
                           ("raw_fragment", F.substring("text", 1, V.RAW_FRAGMENT_CHARS))))
        .otherwise(_map(("salvaged", F.lit(True)))))
    p = p.withColumns({
        "extra": extra,
        "page": F.when(group == "literature", F.col("page")),
        "block_type": F.when(group == "faq", "qa_pair").when(broken, "table_broken")
        .otherwise("text"),
        "provenance": F.when(group == "faq", "legacy_faq")
        .when(group == "thai_docx", "legacy_thai").otherwise("legacy_lit_salvage"),
        "display_text": F.when(broken, F.concat_ws(
            "\n", "index_text", F.lit(V.DAMAGED_TABLE_NOTE))).otherwise(F.col("index_text")),
    })
    # Numbering reads its input twice; cleaning and splitting run once.
    return _chunk_columns(O.with_seq(staged(p.drop("cleaned", "text"), "salvage")))


def text_outside_tables(pages: DataFrame, tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with a table: their text is that of the blocks outside its box, in order."""
    outside = O.blocks_outside_tables(blocks, tables)
    rest = outside.groupBy("doc", "page").agg(F.array_sort(F.collect_list(
        F.struct("block_no", "text"))).alias("b")).select(
        "doc", "page", F.concat_ws("\n", F.col("b.text")).alias("__rest"))
    tabled = tables.select("doc", "page", F.lit(True).alias("__tabled")).distinct()
    return (pages.join(tabled, ["doc", "page"], "left").join(rest, ["doc", "page"], "left")
            .withColumn("text", F.when(F.col("__tabled"), F.coalesce("__rest", F.lit("")))
                        .otherwise(F.col("text"))).select(*pages.columns))


def parse_pages(pages: DataFrame, overrides: DataFrame, tables: DataFrame | None = None,
                blocks: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Page text to chunks: one chunk per valid table, the body text split by sentence.

    ``pages``: doc, page, text.  ``tables``: doc, page, table_no, markdown.  ``blocks``: doc, page,
    block_no, text and a box x0, y0, x1, y1, which ``tables`` then has too: text inside the box of
    a valid table stays out of the body.  Copies of whole documents and documents that still need
    OCR are left out, judged by their full text.  ``sizes`` is ``page_sizes(pages)``, where it was
    made before.
    """
    sizes = staged(O.page_sizes(pages), "sizes") if sizes is None else sizes
    kept = O.dedup_documents(pages, sizes).select("doc")
    sparse = O.flag_sparse_docs(pages, sizes).filter("needs_ocr").select("doc")
    wanted = staged(kept.join(sparse, "doc", "left_anti"), "kept")
    src = pages.join(wanted, "doc", "left_semi")
    if tables is not None:
        tables = tables.filter(C.valid_md_table("markdown"))
        if blocks is not None:
            src = text_outside_tables(src, tables, blocks)
    body = O.keep_body(once(src, "body", C.strip_residue("text")), "body")
    body = O.with_chunk_params(body, overrides)
    text = body.select(
        "doc", "page", F.lit(1 << 20).alias("kind"),
        F.posexplode(split_text("body", F.col("size"), F.col("overlap")))
        .alias("piece", "index_text"))
    text = text.select("*", F.col("index_text").alias("display_text"),
                       F.lit("text").alias("block_type"),
                       F.create_map().cast("map<string,string>").alias("extra"))
    if tables is not None:
        md = strip(F.col("markdown"))
        head = F.substring(F.get(F.split(md, "\n"), F.lit(0)), 1, V.TABLE_HEAD_CHARS)
        t = (tables.join(wanted, "doc", "left_semi")
             .select("doc", "page", F.col("table_no").cast("int").alias("kind"),
                     F.lit(0).alias("piece"),
                     F.substring(F.concat(F.lit(V.TABLE_PREFIX), head, F.lit("\n"), md), 1,
                                 V.TABLE_TEXT_CHARS).alias("index_text"),
                     md.alias("display_text"), F.lit("table").alias("block_type"),
                     _map(("table_markdown", md)).alias("extra")))
        text = text.unionByName(t)
    numbered = O.with_seq(staged(text.withColumn("pos", F.col("page")), "pages"),
                          order=("pos", "kind", "piece"), width=256)
    return _chunk_columns(numbered.withColumn("provenance", F.lit("pdf_parse")))


def build_corpus(raw: DataFrame, pages: DataFrame, overrides: DataFrame,
                 exclude: list[str] = (), tables: DataFrame | None = None,
                 blocks: DataFrame | None = None) -> DataFrame:
    """Salvaged and parsed chunks in one corpus, near-exact copies removed (salvaged win)."""
    both = (salvage(raw, exclude).withColumn("source_ord", F.lit(0))
            .unionByName(parse_pages(pages, overrides, tables, blocks)
                         .withColumn("source_ord", F.lit(1))))
    return O.dedup_chunks(both, ["source_ord", "pos", "doc", "seq"])
