"""Corpus cleaning, numbering, deduplication and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import cleaning as C
from ..functions.tagging import first_case
from ..functions.text import WS_CHARS
from ..sources.stage import staged
from .prefix import first_wins_wide, int_bucket, prefix
from .tagging import bounded_rows

# Characters of a document that are hashed as one piece, wherever its pages break.
PIECE_CHARS = 1 << 16
# Chunk size rules are parameters and become one CASE.
MAX_RULES = 1000


def exclude_docs(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop documents whose name contains one of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("doc").contains(p)
    return df.filter(~hit)


def min_len(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    return df.filter(F.length(col) >= n)


def with_seq(df: DataFrame, key: str = "doc", order: tuple[str, ...] = ("pos", "piece"),
             out: str = "seq", width: int = 1 << 16) -> DataFrame:
    """Running number per document, exact and parallel for very large documents."""
    return prefix(df, [key], list(order), int_bucket(order[0], width), sums={out: F.lit(1)})


def with_chunk_params(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-document ``size`` and ``overlap`` from a table of name prefixes (first match wins)."""
    rules = sorted(bounded_rows(overrides, MAX_RULES, "chunk size rules"), key=lambda r: r["ord"])

    def pick(name: str, default: int):
        return first_case([(F.col("doc").startswith(r["prefix"]), F.lit(r[name])) for r in rules],
                          F.lit(default)).cast("int")

    return df.withColumns({"size": pick("size", V.CORPUS_CHUNK_SIZE),
                           "overlap": pick("overlap", V.CORPUS_CHUNK_OVERLAP)})


def dedup_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first chunk of every near-exact key; rows with an empty key are dropped."""
    keyed = df.withColumn("__key", C.dedup_key("index_text")).filter("__key <> ''")
    return first_wins_wide(keyed, F.col("__key"), order).drop("__key")


def dedup_removed(df: DataFrame, order: list[str]) -> DataFrame:
    """Number of rows that ``dedup_chunks`` removes."""
    key = C.dedup_key("index_text")
    keys = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return keys.agg(F.sum(F.when(F.col("k") == "", F.col("n")).otherwise(F.col("n") - 1))
                    .alias("dedup_removed"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """``doc, page, size, lead, trail``: characters, and white space at both ends of every page."""
    size, blank = F.length("text"), F.lit(WS_CHARS)
    return pages.select(
        "doc", "page", size.alias("size"),
        (size - F.length(F.ltrim("text", blank))).alias("lead"),
        (size - F.length(F.rtrim("text", blank))).alias("trail"))


def page_fingerprints(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Content key of whole documents; it doesn't depend on where their pages break.

    The characters of a document are cut into pieces of ``PIECE_CHARS`` counted from its start, each
    piece is hashed, and the hashes are added up with their numbers.  No row holds more than a piece
    or a page.  ``sizes`` is ``page_sizes(pages)``, where it was made before.
    """
    sizes = page_sizes(pages) if sizes is None else sizes
    placed = prefix(sizes.select("doc", "page", F.col("size").cast("long").alias("size")), ["doc"],
                    ["page"], int_bucket("page", 4096), sums={"stop": F.col("size")})
    placed = placed.select("doc", "page", (F.col("stop") - F.col("size")).alias("at"), "stop")
    first, last = F.floor(F.col("at") / PIECE_CHARS), F.floor((F.col("stop") - 1) / PIECE_CHARS)
    cut = (pages.select("doc", "page", "text").join(placed, ["doc", "page"])
           .where("stop > at").withColumn("piece", F.explode(F.sequence(first, last))))
    begin = F.greatest(F.col("piece") * PIECE_CHARS - F.col("at"), F.lit(0))
    end = F.least((F.col("piece") + 1) * PIECE_CHARS, F.col("stop")) - F.col("at")
    part = F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int"))
    whole = F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), part.alias("t"))))
    pieces = cut.groupBy("doc", "piece").agg(whole.alias("w")).select(
        "doc", F.sha2(F.concat(F.col("piece").cast("string"), F.lit(":"),
                               F.concat_ws("", F.col("w.t"))), 256).alias("digest"))
    sums = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
            for i in range(4)]
    keys = pieces.groupBy("doc").agg(
        F.sha1(F.concat_ws("-", *[x.cast("string") for x in sums])).alias("content_key"))
    totals = sizes.groupBy("doc").agg(F.sum("size").alias("n_chars"), F.count("*").alias("n_pages"))
    return totals.join(keys, "doc", "left").withColumn(
        "content_key", F.coalesce("content_key", F.sha1(F.lit(""))))


def dedup_documents(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Names of the documents to keep: the first name of every distinct content."""
    return (page_fingerprints(pages, sizes).groupBy("content_key")
            .agg(F.min("doc").alias("doc"), F.count("*").alias("n_copies")))


def flag_sparse_docs(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Documents with so little text that they must be scans waiting for OCR.

    Counts the characters of the whole document without the whitespace at its two ends.  Only the
    table of sizes is read more than once.
    """
    sizes = staged(page_sizes(pages), "sizes") if sizes is None else sizes
    filled = F.col("lead") < F.col("size")
    docs = sizes.groupBy("doc").agg(
        F.count("*").alias("n_pages"), F.sum("size").alias("total"),
        F.min(F.when(filled, F.struct("page", F.col("lead").alias("n")))).alias("first"),
        F.max(F.when(filled, F.struct("page", F.col("trail").alias("n")))).alias("last"))
    outside = ((F.col("page") < F.col("first.page")) | (F.col("page") > F.col("last.page"))
               | F.col("first").isNull())
    blank = (sizes.filter(~filled & (F.col("size") > 0))
             .select("doc", "page", F.col("size").alias("n"))
             .join(docs.select("doc", "first", "last"), "doc").filter(outside)
             .groupBy("doc").agg(F.sum("n").alias("blank")))
    n = (F.col("total") - F.coalesce("blank", F.lit(0)) - F.coalesce("first.n", F.lit(0))
         - F.coalesce("last.n", F.lit(0)))
    return docs.join(blank, "doc", "left").select(
        "doc", "n_pages", n.alias("n_chars"),
        (n < V.SPARSE_CHARS_PER_TEN_PAGES * F.col("n_pages") / 10).alias("needs_ocr"))


def keep_body(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter((F.length(col) >= V.MIN_CHUNK_CHARS)
                     & (C.word_ratio(col) >= V.BODY_MIN_WORD_RATIO))


def blocks_outside_tables(blocks: DataFrame, tables: DataFrame, slack: int = 4) -> DataFrame:
    """Text blocks that do not lie inside a table box of the same page."""
    t = tables.select(F.col("doc").alias("__d"), F.col("page").alias("__p"),
                      *[F.col(c).alias("__" + c) for c in ("x0", "y0", "x1", "y1")])
    inside = ((F.col("doc") == F.col("__d")) & (F.col("page") == F.col("__p"))
              & (F.col("x0") >= F.col("__x0") - slack) & (F.col("y0") >= F.col("__y0") - slack)
              & (F.col("x1") <= F.col("__x1") + slack) & (F.col("y1") <= F.col("__y1") + slack))
    return blocks.join(t, inside, "left_anti")


def corpus_stats(raw: DataFrame, salvaged: DataFrame) -> DataFrame:
    """Pipeline counters as rows ``(counter, n)``."""
    lit = F.col("source_group") == "literature"
    names = F.array(F.concat(F.lit("legacy_in_"), "source_group"),
                    F.when(lit, F.concat(F.lit("lit_grade_"), "grade")))
    seen = raw.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("counter"))
    made = salvaged.select(
        F.when(F.col("provenance") == "legacy_faq", "out_faq")
        .when(F.col("provenance") == "legacy_thai", "out_thai")
        .when(F.col("block_type") == "table_broken", "out_table_broken")
        .when(F.col("block_type") == "table", "out_table")
        .when(F.col("provenance") == "pdf_parse", "out_pdf_text")
        .otherwise("out_literature").alias("counter"))
    return seen.unionByName(made).groupBy("counter").agg(F.count("*").alias("n"))


def drop_counters(raw: DataFrame, graded: DataFrame, salvaged: DataFrame, pages: DataFrame,
                  merged: DataFrame, order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """What the corpus build left out, as rows ``(counter, n)``; counters at zero have no row.

    ``graded`` is what is left of ``raw`` after exclusion, ``salvaged`` the chunks made of it,
    ``merged`` all chunks before deduplication.  ``sizes`` is ``page_sizes(pages)``, where it was
    made before.
    """
    def total(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")

    def less(more, some, name):
        both = total(more, name).unionByName(some.agg((-F.count("*")).alias("n"))
                                             .select(F.lit(name).alias("counter"), "n"))
        return both

    sizes = staged(page_sizes(pages), "sizes") if sizes is None else sizes
    kept = dedup_documents(pages, sizes)
    group = F.col("source_group")
    parts = [
        less(raw, graded, "salvage_excluded"),
        less(graded.filter(group == "faq"), salvaged.filter("provenance = 'legacy_faq'"),
             "faq_dropped"),
        less(graded.filter(group == "thai_docx"), salvaged.filter("provenance = 'legacy_thai'"),
             "thai_dropped"),
        less(graded.filter("grade = 'table_fragment'"),
             salvaged.filter("block_type = 'table_broken'"), "table_frag_no_caption_dropped"),
        kept.select(F.lit("pdf_duplicate").alias("counter"), (F.col("n_copies") - 1).alias("n")),
        total(flag_sparse_docs(pages, sizes).filter("needs_ocr").join(kept, "doc", "left_semi"),
              "pdf_needs_ocr"),
        dedup_removed(merged, order).select(F.lit("dedup_removed").alias("counter"),
                                            F.col("dedup_removed").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 0")


def corpus_profile(df: DataFrame) -> DataFrame:
    """Row counts by block type and by provenance."""
    return (df.groupingSets([["block_type"], ["provenance"]], "block_type", "provenance")
            .agg(F.count("*").alias("n")))
