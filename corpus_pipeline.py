"""From documents to training pieces: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.llm import decontaminate, lines, pieces, simhash, toxicity
from sparkrag.llm.common import quoted
from sparkrag.session import ship_package
from sparkrag.sources.stage import staged


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Exactly the columns of ``like``."""
    return df.select(*quoted(like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model fitted on the labelled ones."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = toxicity.score(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD)
    return _columns(clean, docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated passages of two and more lines."""
    ship_package(spark)
    cut = lines.remove_repeated_passages(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return _columns(cut, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    return _columns(simhash.keep_one(docs), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't make up a twentieth of."""
    ship_package(spark)
    marked = decontaminate.mark_contamination(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(marked.where(~decontaminate.contaminated()), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their byte spans in the text of each document, with digests."""
    ship_package(spark)
    made = pieces.encode(docs.select("doc_id", "text"),
                         public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.col(f"{pieces.COLUMN}.ids")
    return made.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(f"{pieces.COLUMN}.decoded", 256).alias("decoded_sha256"),
        ids.alias("ids"), F.col(f"{pieces.COLUMN}.starts").alias("starts"),
        F.col(f"{pieces.COLUMN}.ends").alias("ends"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None  # a fitted model, XXH64 and the tokenizer have no SQL; tests/llm has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
