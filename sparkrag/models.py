"""Model hooks: batched functions over columns, and deterministic stand-ins.

A hook is a plain function on lists; Spark partitions the rows and Arrow moves the batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import fixed_values as V
from .functions.splitting import chunks_of
from .functions.text import let, once, with_tokens


def with_model(df: DataFrame, fn: Callable, inputs: list[str], output: str,
               out_type: T.DataType | str, batch: int = 256, error: str | None = None
               ) -> DataFrame:
    """Add ``output = fn(*input_lists)`` in batches.

    With ``error`` a failing batch is retried row by row; a failing row keeps its data, gets a
    NULL output and the message (first 200 characters) in that column.
    """
    kind = T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    fields = [*df.schema.fields, T.StructField(output, kind)]
    if error:
        fields.append(T.StructField(error, T.StringType()))

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        out, bad = pdf.copy(), [None] * len(pdf)
        args = [pdf[c].tolist() for c in inputs]
        try:
            got = list(fn(*args))
        except Exception:
            if not error:
                raise
            got = []
            for i, row in enumerate(zip(*args)):
                try:
                    got.append(list(fn(*[[x] for x in row]))[0])
                except Exception as exc:
                    got.append(None)
                    bad[i] = str(exc)[:200]
        out[output] = pd.Series(got, index=pdf.index, dtype=object)
        if error:
            out[error] = pd.Series(bad, index=pdf.index, dtype=object)
        return out

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                yield call(pdf.iloc[at:at + batch])

    return df.mapInPandas(run, T.StructType(fields))


def hash_embed(tokens, dim: int = 64) -> Column:
    """Stand-in embedding: token counts in hashed buckets, unit length.  Runs in the JVM."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    # The first eight digits modulo a divisor of 256 are the last two of them modulo that.
    begin, digits = (7, 2) if 256 % dim == 0 else (1, 8)

    def slot(x: Column) -> Column:
        return F.conv(F.substring(F.md5(x), begin, digits), 16, 10).cast("long") % dim

    if dim <= 64:  # a letter per token; a slot counts what is missing without its letter
        marks = F.array_join(F.transform(t, lambda x: F.char(48 + slot(x))), "")
        letters = F.array(*[F.lit(chr(48 + i)) for i in range(dim)])
        count = let(marks, lambda m: F.transform(letters, lambda c: (
            F.octet_length(m) - F.octet_length(F.replace(m, c, F.lit("")))).cast("double")))
    else:
        count = let(F.transform(t, slot), lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n)))

    return let(count, unit)


def embed_with_hash(dim: int = 64, terms=()) -> Callable[[DataFrame, str, str], DataFrame]:
    """An embedding step ``(df, text column, output column) -> df`` for the search plans."""
    def step(df: DataFrame, text: str, out: str) -> DataFrame:
        df = with_tokens(df, text, "__tokens", terms)
        return once(df, out, hash_embed("__tokens", dim)).drop("__tokens")
    return step


def embed_with(fn: Callable[[list[str]], list[list[float]]], batch: int = 256):
    """An embedding step from a function on texts."""
    def step(df: DataFrame, text: str, out: str) -> DataFrame:
        return with_model(df, fn, [text], out, "array<float>", batch)
    return step


def enrich_images(blocks: DataFrame, describe: Callable[[list[bytes]], list[str]]) -> DataFrame:
    """Describe image and scan blocks ``(block_type, text, content bytes)``.

    A row whose description fails keeps its text and gets ``enrich_error``.
    """
    from .functions.json_text import describe_to_text, parse_description

    image = F.col("block_type").isin("image", "scan_page") & F.col("content").isNotNull()
    other = blocks.filter(~F.coalesce(image, F.lit(False)))
    done = with_model(blocks.filter(image), describe, ["content"], "__raw", "string", 16,
                      "enrich_error")
    text = F.nullif(describe_to_text(parse_description("__raw")), F.lit(""))
    done = done.withColumn("text", F.when(F.col("enrich_error").isNull(),
                                          F.coalesce(text, "text")).otherwise(F.col("text")))
    return done.drop("__raw").unionByName(other.withColumn("enrich_error",
                                                           F.lit(None).cast("string")))


class ChunkTable:
    """Table function: rows of a table with a text column become rows of its section chunks.

    All other columns are passed through, then come ``piece`` and ``chunk``.  Names of the text column,
    and other sizes and overlaps, are arguments.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument,
                size: AnalyzeArgument | None = None, ratio: AnalyzeArgument | None = None
                ) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        if text.value not in rows.dataType.names:
            raise ValueError(f"no column {text.value}")
        kept = [f for f in rows.dataType.fields if f.name != text.value]
        return AnalyzeResult(T.StructType([
            *kept, T.StructField("piece", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    def eval(self, rows: Row, text: str, size: int = V.SECTION_CHUNK_SIZE,
             ratio: float = V.SECTION_OVERLAP_RATIO):
        kept = [v for n, v in zip(rows.__fields__, rows) if n != text]
        for piece, chunk in enumerate(chunks_of(rows[text], int(size), float(ratio))):
            yield (*kept, piece, chunk)


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """``SELECT * FROM chunk_table(TABLE(docs), 'text')`` over a table of any columns."""
    spark.udtf.register(name, F.udtf(ChunkTable))


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """Register the section splitter as a SQL table function: ``LATERAL chunk_text(text)``."""
    @F.udtf(returnType="piece: int, chunk: string")
    class Chunks:
        def eval(self, text: str):
            yield from enumerate(chunks_of(text))

    spark.udtf.register(name, Chunks)
