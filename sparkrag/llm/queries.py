"""Registered queries of the operators, each next to the SQL that states its result if SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.stage import new_path
from . import ann, decontaminate, fim, html_text, lines, pieces, quality, ranked, simhash
from . import substrings, suffix_tree, token_files, toxicity
from .labelled import held_out

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


@query("op1_neighbours")
def op1(spark, sf_dir):
    """The 20 nearest found of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op2_decontaminate")
def op2(spark, sf_dir):
    """Benchmark words inside every document."""
    marked = decontaminate.mark_contamination(table(spark, sf_dir, "documents"),
                                              table(spark, sf_dir, "benchmark"))
    m = decontaminate.COLUMN
    return marked.select(
        "doc_id", f"{m}.n_words", f"{m}.n_hit", F.size(f"{m}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{m}.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    """Documents without the passages of an earlier document."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_sentencepiece")
def op4(spark, sf_dir):
    """Pieces of all documents and their decoding."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.col(f"{pieces.COLUMN}.ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(f"{pieces.COLUMN}.decoded", 256).alias("decoded_sha256"))


@query("op5_token_files")
def op5(spark, sf_dir):
    """Ids of all documents written to grammar-compressed files and read back."""
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path,
                      public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path, with_ids=False)


@query("op6_line_dedup", lines.SQL)
def op6(spark, sf_dir):
    """Documents without the repeated multi-line chunks."""
    cut = lines.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    """Toxicity of all documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_simhash")
def op8(spark, sf_dir):
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.mark_text(F.col("mark")).alias("fingerprint"),
                        "component_id")


@query("op9_html_text")
def op9(spark, sf_dir):
    """Main text of all pages."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(html_text.COLUMN).alias("text"),
                        F.length(html_text.COLUMN).cast("long").alias("n_chars"))


@query("op10_quality")
def op10(spark, sf_dir):
    """Quality of all documents, learned from trusted positives and unlabelled texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op11_ranked_search", ranked.SQL)
def op11(spark, sf_dir):
    """The 20 best documents for every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_lm_score")
def op12(spark, sf_dir):
    """Language-model scores of all documents, learned outside a held-out seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.score(docs, ~held_out(F.col("doc_id"), 7))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


@query("op13_fim", fim.SQL)
def op13(spark, sf_dir):
    """All documents in fill-in-middle form, and the texts rebuilt from it."""
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col(f"{fim.COLUMN}.output"), F.col(f"{fim.COLUMN}.form")
    return made.select(
        "doc_id", f"{fim.COLUMN}.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fim.restore(output, form), 256).alias("restored_sha256"))
