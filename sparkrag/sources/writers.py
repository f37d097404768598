"""Writers: chunk corpora, search tables, traces, vocabularies, operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas as S
from ..functions.tagging import normalize_scope


def write_chunks(df: DataFrame, path: str, format: str = "json") -> None:
    """Chunk corpus as JSON lines or Parquet."""
    df.write.mode("overwrite").format(format).save(path)


def search_table(df: DataFrame) -> DataFrame:
    """Typed, truncated rows of the search table."""
    defaults = {"tenant_id": "default", "document_id": "", "language": "zh", "domain": "general",
                "source_type": "document"}

    def cut(name):
        c = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        if name in defaults:
            c = F.coalesce(c, F.lit(defaults[name]))
        return F.substring(c, 1, V.SEARCH_TABLE_WIDTHS[name]).alias(name)

    roles = F.slice(F.coalesce("role_scope", F.array().cast("array<string>")), 1,
                    V.SEARCH_TABLE_SLICES["role_scope"])
    orchards = F.slice(normalize_scope("orchard_scope"), 1, V.SEARCH_TABLE_SLICES["orchard_scope"])
    vec = ["vec"] if "vec" in df.columns else []
    return df.select(*[cut(c) for c in V.SEARCH_TABLE_WIDTHS], roles.alias("role_scope"),
                     orchards.alias("orchard_scope"), *vec)


def build_search_table(df: DataFrame, path: str) -> None:
    """Full overwrite, partitioned by tenant so that a tenant filter prunes files."""
    search_table(df).write.mode("overwrite").partitionBy("tenant_id").parquet(path)


def write_trace(df: DataFrame, path: str, batch: int | str) -> None:
    """One folder per batch: a batch that is written again replaces itself."""
    df.write.mode("overwrite").json(f"{path}/batch_no={batch}")


def write_concepts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_ops(df: DataFrame, directory: str, table: str) -> None:
    """One operational table, typed, missing columns filled with their defaults."""
    cols = []
    for f in S.OPS[table].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    (df.select(*cols).fillna(S.OPS_DEFAULTS[table])
     .write.mode("overwrite").parquet(f"{directory}/{table}"))
