"""Document blocks: typing, sections, section chunks, tables and page layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import fixed_values as V
from ..functions.text import let, once, strip
from ..sources.stage import staged
from .prefix import int_bucket, prefix
from .segments import split_runs


def _text() -> Column:
    """Block text: ``text`` when it is filled, else ``content``, stripped."""
    first = F.when(F.col("text") != "", F.col("text"))
    return strip(F.coalesce(first, F.col("content"), F.lit("")))


def classify_block() -> Column:
    """Block type from the declared type, else from the look of the text.

    Needs the columns ``type, text, content, image_path, page_idx, page_scan``.
    """
    names = F.create_map(*[F.lit(x) for kv in V.BLOCK_TYPE_NAMES.items() for x in kv])
    declared = names[F.lower(strip(F.coalesce("type", F.lit(""))))]
    scanned = F.col("page_idx").isNotNull() & F.coalesce("page_scan", F.lit(False))
    return let(_text(), lambda text: _by_look(text, declared, scanned))


def _by_look(text: Column, declared: Column, scanned: Column) -> Column:
    title = (F.length(text).between(2, 60) & text.rlike(V.NUMBERED_TITLE)
             & ~F.instr(F.lit(V.SENTENCE_ENDINGS), F.right(text, F.lit(1))).cast("boolean"))
    return (
        F.when((declared == "image") & scanned, "scan_page")
        .when(declared.isNotNull(), declared)
        .when(text == "", F.when(F.col("image_path").rlike(V.IMAGE_PATH), "image")
              .otherwise("text"))
        .when(text.rlike(V.IMAGE_PATH), "image")
        .when(text.rlike(V.MD_TABLE_LINE), "table")
        .when(title, "title")
        .otherwise("text")
    )


def type_blocks(df: DataFrame) -> DataFrame:
    """Add ``block_type``; rows that are no blocks (NULL position) are dropped."""
    return df.filter(F.col("pos").isNotNull()).withColumn("block_type", classify_block())


def with_section(df: DataFrame) -> DataFrame:
    """Latest title at or above each block (empty before the first title)."""
    title = F.when(F.col("block_type") == "title", _text())
    out = prefix(df, ["doc_id"], ["pos"], int_bucket("pos"), lasts={"section": title})
    return out.withColumn("section", F.coalesce("section", F.lit("")))


def chunk_document(df: DataFrame, size: int = V.SECTION_CHUNK_SIZE,
                   ratio: float = V.SECTION_OVERLAP_RATIO) -> DataFrame:
    """Section-aware chunks of typed blocks; only text is split, tables, images and scans stay whole.

    Neighbouring text blocks of a section make a run.  Empty text blocks are skipped without ending
    it; an empty table or image ends the run and disappears.  ``source_index`` is the position of the
    first block of the run.  One pass of running values gives sections, runs and the place of
    every text among the characters of its document; no run has to fit one row or task.
    """
    return _chunks(df, ["pos"], int_bucket("pos"), size, ratio)


def _chunks(df: DataFrame, order: list[str], bucket: Column, size: int, ratio: float) -> DataFrame:
    """The same for blocks in any order; without a position, that is their running number.  Such a
    table is a staged one, read twice."""
    number = {} if "pos" in order else {"pos": F.lit(1)}
    # Types and texts are long expressions, read by every running value.
    src = once(df, "__block", F.struct(F.col("block_type").alias("kind"), _text().alias("body")))
    kind = F.col("__block.kind")
    src = src.select("doc_id", *order, "image_path", kind.alias("block_type"), "__block.body",
                     (~kind.isin("title", "table", "image", "scan_page")).alias("is_text"))
    src = src.where(~F.col("is_text") | (F.col("body") != ""))
    rows = prefix(
        src, ["doc_id"], order, bucket, stage=not number,
        sums={**number, "run": F.when(F.col("is_text"), 0).otherwise(1),
              "end": F.when(F.col("is_text"), F.length("body") + 1).otherwise(0)},
        lasts={"section": F.when(F.col("block_type") == "title", F.col("body"))},
        prevs={"after_text": F.col("is_text")})
    rows = rows.withColumn("section", F.coalesce("section", F.lit("")))
    if number:
        rows = rows.withColumn("pos", F.col("pos") - 1)
    whole = rows.where((F.col("body") != "") | (F.coalesce("image_path", F.lit("")) != "")).where(
        ~F.col("is_text") & (F.col("block_type") != "title"))
    texts = rows.where("is_text").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "run", "section",
        (~F.coalesce("after_text", F.lit(False))).alias("first"),
        (F.col("end") - F.length("body") - 1).alias("at"), "body")
    pieces = split_runs(texts, size, max(1, int(size * ratio)), V.SECTION_MIN_TAIL)
    return whole.select(
        "doc_id", F.col("pos").cast("long").alias("source_index"), "section", "block_type",
        "image_path", F.lit(0).alias("piece"), F.col("body").alias("text")).unionByName(
        pieces.withColumns({"block_type": F.lit("text"), "image_path": F.lit(None).cast("string")}))


def _cell(c: Column) -> Column:
    c = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def table_to_markdown(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Markdown text of each table.

    ``cells``: table_id, row, col, value.  ``headers``: table_id, col, header, unit, caption.
    Units join the header cell, rows are padded or cut to the header width.
    """
    h, u = _cell(F.col("header")), F.col("unit")
    head = F.when((F.coalesce(u, F.lit("")) != "")
                  & ~F.contains(h, F.concat(F.lit("("), u, F.lit(")"))),
                  F.concat(h, F.lit(" ("), _cell(u), F.lit(")"))).otherwise(h)
    heads = headers.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("col", head.alias("h")))).alias("h"),
        F.max("caption").alias("caption"))
    rows = cells.groupBy("table_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", _cell(F.col("value"))))).alias("m"))
    width = F.size("h")
    line = F.concat(F.lit("|"), F.concat_ws("|", F.transform(
        F.col("h.col"), lambda c: F.coalesce(F.col("m")[c], F.lit("")))), F.lit("|"))
    body = (rows.join(heads, "table_id").select("table_id", "row", line.alias("line"))
            .groupBy("table_id")
            .agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("rows")))
    caption = F.when(F.coalesce("caption", F.lit("")) != "", _cell(F.col("caption")))
    return heads.join(body, "table_id", "left").select("table_id", F.concat_ws(
        "\n", F.concat(F.lit("|"), F.concat_ws("|", F.col("h.h")), F.lit("|")),
        F.concat(F.lit("|"), F.concat_ws("|", F.array_repeat(F.lit("---"), width)), F.lit("|")),
        F.col("rows.line"), caption).alias("markdown"))


_LINE = ("page_id", "block", "par", "line")
_BOX = ("top", "left", "height")


def _line_parts(total: pa.DataType):
    """Words that follow each other, with neighbouring numbers, as one row: the number of the first,
    their count and their texts with blanks between, which can be told apart again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                same = pc.equal(pc.subtract(b["word_no"][1:], b["word_no"][:-1]), 1)
                for c in _LINE:
                    same = pc.and_(same, pc.equal(b[c][1:], b[c][:-1]))
                own = pc.match_substring(b["text"], " ").to_numpy(False)
                new[1:] = ~pc.fill_null(same, False).to_numpy(False) | own[1:] | own[:-1]
            at = np.flatnonzero(new)
            ends = np.append(at, b.num_rows)
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b["text"])
            width = pa.table({"part": np.cumsum(new), "width": b["width"]}).group_by(
                "part", use_threads=False).aggregate([("width", "sum")])["width_sum"]
            first = b.take(pa.array(at)).select([*_LINE, "word_no", *_BOX])
            yield pa.RecordBatch.from_arrays(
                [*first.columns, pa.array(np.diff(ends), pa.int32()), pc.binary_join(words, " "),
                 width.combine_chunks().cast(total)],
                names=[*first.schema.names, "n", "text", "width"])
    return run


def words_to_lines(words: DataFrame) -> DataFrame:
    """OCR words to lines per (page_id, block, par, line); blank words are dropped.

    Words come line by line, so lines are put together where they are read, without sorting, and only
    parts of lines are shuffled.  Words in any other order give the same lines from more parts.
    """
    # Most words show by their first letter that they are not blank.
    filled = F.ascii("text").between(33, 126) | (strip(F.col("text")) != "")
    w = words.filter(filled).select(*_LINE, "word_no", *_BOX, "text", "width")
    total = w.select(F.sum("width").alias("width")).schema["width"]
    part = T.StructType([*w.schema.fields[:-2], T.StructField("n", T.IntegerType()),
                         w.schema["text"], total])
    # Dealt out before they are collected: a task that reads would sort all of its parts, and spill.
    parts = w.mapInArrow(_line_parts(to_arrow_type(total.dataType)), part).repartition(*_LINE)
    lines = parts.groupBy(*_LINE).agg(
        F.collect_list(F.struct("word_no", "n", "text")).alias("parts"),
        F.min(F.struct("word_no", *_BOX)).alias("f"),
        F.sum("width").cast(total.dataType).alias("width"))
    single = lambda p: F.transform(
        F.when(p["n"] == 1, F.array(p["text"])).otherwise(F.split(p["text"], " ")),
        lambda x, i: F.struct((p["word_no"] + i).alias("word_no"), x.alias("text")))
    text = F.when(F.size("parts") == 1, F.col("parts")[0]["text"]).otherwise(F.concat_ws(
        " ", F.array_sort(F.flatten(F.transform("parts", single)))["text"]))
    return lines.select(*_LINE, text.alias("text"), "f.top", "f.left", "width", "f.height")


def text_to_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Plain OCR text to line rows on a fixed 20-unit grid; blank lines leave gaps."""
    rows = df.select("page_id", F.posexplode(F.split(text, "\r\n|[\n\r\x0b\x0c]"))
                     .alias("line_no", "t"))
    return rows.filter(strip(F.col("t")) != "").select(
        "page_id", strip(F.col("t")).alias("text"),
        (F.col("line_no") * V.OCR_LINE_HEIGHT).alias("top"), F.lit(0).alias("left"),
        F.lit(0).alias("width"), F.lit(V.OCR_LINE_HEIGHT).alias("height"))


def _join_parts(parts: Column) -> Column:
    """Join words: a space only where neither neighbour is a CJK ideograph."""
    cjk_end, cjk_start = "[" + V.CJK + r"]\z", "^[" + V.CJK + "]"

    def add(acc, x):
        x = strip(x)
        glue = F.when((acc == "") | acc.rlike(cjk_end) | x.rlike(cjk_start), "").otherwise(" ")
        return F.when(x == "", acc).otherwise(F.concat(acc, glue, x))

    return F.aggregate(parts, F.lit(""), add)


def restore_layout(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with boxes to paragraphs: a gap above 1.5 median line heights starts a new one.

    ``keep`` names columns that all lines of a page share; paragraphs carry them.  Texts are dealt out
    once, by page and bucket of lines, and joined there.  Only pages of several buckets need more:
    where a bucket goes on with the paragraph of the one before, their texts are joined.
    """
    src = lines.select("page_id", *keep, "top", "left", "text", int_bucket("top").alias("bucket"),
                       F.greatest(F.coalesce("height", F.lit(0)), F.lit(1)).alias("__h"))
    heights = staged(src.groupBy("page_id", "bucket", "__h").agg(F.count("*").alias("n")), "heights")
    pages = heights.groupBy("page_id").agg(
        F.percentile("__h", F.lit(0.5), F.col("n")).alias("median_h"),
        (F.min("bucket") < F.max("bucket")).alias("many"))
    buckets = heights.select("page_id", "bucket").distinct().join(pages, "page_id")
    order = ["top", "left", "text"]
    local = Window.partitionBy("page_id", "bucket").orderBy(*order)
    rows = src.join(buckets, ["page_id", "bucket"]).withColumns({
        "end": F.col("top") + F.col("__h"), "bottom": F.lag(F.col("top") + F.col("__h")).over(local)})
    gap = F.col("top") - F.col("bottom") > F.col("median_h") * V.PARAGRAPH_GAP_FACTOR
    new = F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("par", F.sum("new").over(
        local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct(*order)
    # Read by the pages that are done, by those of several buckets and by the sums over buckets.
    found = staged(rows.groupBy("page_id", "bucket", "par").agg(
        *[F.min(c).alias(c) for c in keep], F.first("many").alias("many"),
        F.first("median_h").alias("median_h"), F.min("top").alias("top"),
        F.max_by("end", at).alias("end"), F.array_sort(F.collect_list(at)).alias("parts"))
        .withColumn("text", _join_parts(F.col("parts.text"))).drop("parts"), "layout")
    names = ["page_id", *keep, "par_idx", "text"]
    done = found.where("NOT many").withColumnRenamed("par", "par_idx").select(*names)

    several = found.where("many")
    across = Window.partitionBy("page_id").orderBy("bucket")
    sums = several.groupBy("page_id", "bucket").agg(
        F.max("par").alias("inside"), F.min("top").alias("top"), F.max_by("end", "par").alias("end"),
        F.first("median_h").alias("median_h")).withColumn("bottom", F.lag("end").over(across))
    sums = sums.withColumn("new", new).select("page_id", "bucket", (
        F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        + F.coalesce(F.sum("inside").over(across.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0))).alias("before"))
    joined = several.join(sums, ["page_id", "bucket"]).groupBy(
        "page_id", (F.col("before") + F.col("par")).alias("par_idx")).agg(
        *[F.min(c).alias(c) for c in keep],
        F.array_sort(F.collect_list(F.struct("bucket", "text"))).alias("parts")).withColumn(
        "text", _join_parts(F.col("parts.text")))
    out = done.unionByName(staged(joined.select(*names), "spanning"))
    return out.filter(F.col("text") != "")


def pages_to_chunks(lines: DataFrame, size: int = V.SECTION_CHUNK_SIZE,
                    ratio: float = V.SECTION_OVERLAP_RATIO) -> DataFrame:
    """Scanned pages ``(doc_id, page_idx, page_id, lines...)`` to section chunks."""
    none = F.lit(None).cast("string")
    blocks = restore_layout(lines, ("doc_id", "page_idx")).select(
        "doc_id", "page_idx", "par_idx", "text", F.lit("text").alias("block_type"),
        none.alias("content"), none.alias("image_path"))
    return _chunks(blocks, ["page_idx", "par_idx"], int_bucket("page_idx", 256), size, ratio)
