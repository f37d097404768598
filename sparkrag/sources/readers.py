"""Readers: JSON-lines corpora, terminology, gold sets, page text, operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .. import schemas as S
from ..functions.text import strip
from ..operators.metrics import derive_difficulty, pick_language
from ..operators.tagging import build_concepts


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    bad = T.StructField("_bad", T.StringType())
    return (spark.read.schema(T.StructType([*schema.fields, bad])).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(path))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: lines numbered by file name and place.

    Spark numbers lines within a split; one row per split adds up what stands before it.
    """
    split = ["_file", "_start"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_n"), "value")
    ahead = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy(*split).agg(F.count("*").alias("_size"), F.min("_n").alias("_first"))
    sizes = sizes.select(*split, "_first", F.coalesce(F.sum("_size").over(ahead), F.lit(0))
                         .alias("_before"))
    return lines.join(sizes, split).select(
        (F.col("_n") - F.col("_first") + F.col("_before")).alias("pos"), "value")


def read_chunks(spark: SparkSession, path: str, schema: T.StructType = S.RAW_CHUNK
                ) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row count of bad lines).  Blank lines are skipped, bad lines counted.

    Rows carry ``pos``, the number of their line over all files in the order of their names; it is
    the same however the files are split.
    """
    lines = _numbered_lines(spark, path)
    parsed = (lines.filter(strip(F.col("value")) != "")
              .select("pos", F.from_json("value", T.StructType(
                  [*schema.fields, T.StructField("_bad", T.StringType())]),
                  {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")))
    rows = parsed.filter("r._bad IS NULL").select("pos", *[f"r.{n}" for n in schema.fieldNames()])
    return rows, parsed.agg(F.count_if(F.col("r._bad").isNotNull()).alias("bad_lines"))


def ingest_corpus(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Corpus rows to record inputs: ids, text and language resolved, empty text dropped."""
    def first(*cols):
        return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols],
                          F.lit(""))
    out = df.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("chunk_id"),
        first("source_file", "doc").alias("document_id"),
        first("index_text", "text").alias("text"),
        F.coalesce(F.nullif(F.col("metadata")["src_lang"], F.lit("")), F.lit("zh"))
        .alias("language"),
        F.coalesce("provenance", F.lit("")).alias("provenance"),
        F.coalesce(F.nullif("block_type", F.lit("")), F.lit("text")).alias("block_type"))
    out = out.filter("text <> ''")
    return out if limit is None else out.limit(limit)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Category -> alias -> canonical JSON to rows, notes and non-text values dropped.

    Each file under ``path`` is one JSON object, read whole on purpose; every category is parsed once.
    """
    top = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,string>").alias("m"))
    cats = top.select(F.posexplode(F.map_entries("m")).alias("category_ord", "c"))
    inner = F.from_json("c.value", "map<string,variant>")
    terms = (cats.filter(F.col("c.value").startswith("{"))
             .select("category_ord", F.col("c.key").alias("category"),
                     F.posexplode(F.map_entries(inner)).alias("alias_ord", "t")))
    return (terms.filter(~F.col("t.key").isin(*V.TERM_META_KEYS)
                         & (F.schema_of_variant("t.value") == "STRING")
                         & ~F.col("category").isin(*V.TERM_META_KEYS))
            .select("category", "category_ord", "alias_ord", F.col("t.key").alias("alias"),
                    F.col("t.value").cast("string").alias("canonical")))


def read_gold(spark: SparkSession, path: str, aliases: list[str], limit: int | None = None
              ) -> DataFrame:
    """Gold questions with language, intent, difficulty and gold ids."""
    return normalize_gold(_json_lines(spark, path, S.GOLD_RAW).filter("_bad IS NULL"), aliases,
                          limit)


def normalize_gold(raw: DataFrame, aliases: list[str], limit: int | None = None) -> DataFrame:
    df = raw.withColumn("query", strip(F.coalesce("question", F.lit("")))).filter("query <> ''")
    df = df.withColumn("lang", pick_language("q_lang", "language"))
    none = F.array().cast("array<string>")
    out = df.select(
        "query", F.col("lang").alias("language"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("intent"),
        derive_difficulty("query", "lang", "cross_lingual", "difficulty", aliases)
        .alias("difficulty"),
        F.when(F.coalesce("ref_doc_id", F.lit("")) != "", F.array("ref_doc_id")).otherwise(none)
        .alias("gold_document_ids"), F.coalesce("anchors", none).alias("gold_chunk_ids"),
        F.coalesce("gold_answer", F.lit("")).alias("gold_answer"))
    return out if limit is None else out.limit(limit)


def read_intent_samples(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("samples", T.ArrayType(S.INTENT_SAMPLE))])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.inline("samples")).withColumn(
        "rule_backstop", F.coalesce("rule_backstop", F.lit(False)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted page text ``(doc, page, text)``."""
    return spark.read.schema(S.PAGE_TEXT).parquet(path)


def list_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a document folder with size and content hash."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime", F.sha1("content").alias("sha1")))


def read_ops(spark: SparkSession, directory: str, tables=tuple(S.OPS)) -> dict[str, DataFrame]:
    """Operational tables with their defaults filled in."""
    return {t: spark.read.schema(S.OPS[t]).parquet(f"{directory}/{t}").fillna(S.OPS_DEFAULTS[t])
            for t in tables}


def read_concepts(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """Stored vocabulary when there is one, else rebuilt from the terms."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        return spark.read.schema(S.CONCEPT).json(path)
    if terms is None:
        raise FileNotFoundError(path)
    return build_concepts(terms)


def read_trace(spark: SparkSession, path: str, keep: int = V.TRACE_KEEP) -> DataFrame:
    """The newest ``keep`` trace records; ``ts`` is the time of writing."""
    schema = T.StructType([T.StructField("ts", T.TimestampType()), *S.TRACE.fields])
    return (spark.read.schema(schema).json(path)
            .orderBy(F.desc("ts"), F.desc("trace_id")).limit(keep))
