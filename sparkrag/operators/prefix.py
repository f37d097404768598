"""Ordered per-key computations that stay parallel when one key holds most of the rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task.  ``prefix`` cuts every key
into buckets of its order column, runs the window inside each (key, bucket), summarises each bucket
in one row, runs a tiny window over the summaries and joins the carried value back.  Results are
exactly those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

_B = "__bucket"


def prefix(df: DataFrame, key: list[str], order: list[str], bucket: Column,
           sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
           prevs: dict[str, Column] | None = None, stage: bool = True) -> DataFrame:
    """Add running sums, last non-null values and previous-row values per key.

    ``bucket`` must be monotone in ``order``: equal buckets are contiguous in the ordering.
    ``lasts`` include the current row; ``prevs`` are the value of the row before, NULL on the first.
    ``stage=False`` is for a table that is cheap to read twice.
    """
    sums, lasts, prevs = sums or {}, lasts or {}, prevs or {}
    src = df.withColumn(_B, bucket)
    src = src.withColumns({"__in_" + n: c for n, c in {**sums, **lasts, **prevs}.items()})
    # Two branches read the input: it is computed once, and columns that one needs are all it reads.
    # Levels that build on each other would otherwise double the work at every step.
    src = staged(src, "prefix") if stage else src
    by, at = [*key, _B], F.struct(*order)
    local = Window.partitionBy(*by).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    summary = src.groupBy(*by).agg(
        F.lit(1).alias("__one"),
        *[F.sum("__in_" + n).alias("__s_" + n) for n in sums],
        *[F.max_by("__in_" + n, F.when(F.col("__in_" + n).isNotNull(), at)).alias("__l_" + n)
          for n in lasts],
        *[F.max_by("__in_" + n, at).alias("__p_" + n) for n in prevs])
    across = Window.partitionBy(*key).orderBy(_B)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *by,
        *[F.coalesce(F.sum("__s_" + n).over(before), F.lit(0)).alias("__cs_" + n) for n in sums],
        *[F.last("__l_" + n, ignorenulls=True).over(before).alias("__cl_" + n) for n in lasts],
        *[F.lag("__p_" + n).over(across).alias("__cp_" + n) for n in prevs])

    inner = src.withColumns({
        **{"__ls_" + n: F.sum("__in_" + n).over(upto) for n in sums},
        **{"__ll_" + n: F.last("__in_" + n, ignorenulls=True).over(upto) for n in lasts},
        **{"__lp_" + n: F.lag("__in_" + n).over(local) for n in prevs},
        "__rn": F.row_number().over(local),
    }).join(carry, by, "left")
    out = inner.withColumns({
        **{n: F.col("__ls_" + n) + F.col("__cs_" + n) for n in sums},
        **{n: F.coalesce("__ll_" + n, "__cl_" + n) for n in lasts},
        **{n: F.when(F.col("__rn") == 1, F.col("__cp_" + n)).otherwise(F.col("__lp_" + n))
           for n in prevs},
    })
    names = [*df.columns, *[n for n in (*sums, *lasts, *prevs) if n not in df.columns]]
    return out.select(*names)


def int_bucket(pos: str, width: int = 1 << 16) -> Column:
    return F.floor(F.col(pos) / F.lit(width))


def time_bucket(ts: str, seconds: int = 86400) -> Column:
    return F.floor(F.col(ts).cast("timestamp").cast("double") / F.lit(seconds))


def top_n(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank"
          ) -> DataFrame:
    """First ``n`` rows per key.  Spark cuts each map partition to ``n`` before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """Running number, from 1, of each row of a key in ``order``, over ranges of the order.

    Rows are split into ranges of (key, order), numbered inside each, and moved on by the rows that the
    key has in the ranges before: one row per key and range is all that meets.
    """
    by = [*[F.col(k).asc() for k in key], *order]
    split = staged(staged(df, "rows").repartitionByRange(*by)
                   .withColumn("__part", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("__part", *key).orderBy(*order)
    ahead = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("__part", *key).agg(F.count("*").alias("__size")).select(
        "__part", *key, F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__before"))
    return split.withColumn("__at", F.row_number().over(local)).join(sizes, ["__part", *key]).select(
        *df.columns, (F.col("__at") + F.col("__before")).cast("int").alias(name))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order.  Aggregates before the shuffle, so copies collapse
    where they are read and a key that holds a third of all rows is no hot spot."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, "__row.*").select(*df.columns)


def first_wins_wide(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The same for wide rows: only a 128-bit hash of the key and the order columns are aggregated,
    the winning rows are joined back.  Rows with equal order columns are told apart by content."""
    src = df.withColumns({"__k1": F.xxhash64(key), "__k2": F.xxhash64(F.lit(1), key),
                          "__content": F.xxhash64(*_hashable(df))})
    at = F.struct(*order, "__content")
    best = src.groupBy("__k1", "__k2").agg(F.min(at).alias("__first"))
    won = src.join(best, ["__k1", "__k2"]).where(at.eqNullSafe(F.col("__first")))
    same = Window.partitionBy("__k1", "__k2").orderBy(F.lit(0))  # repeated rows
    return (won.withColumn("__n", F.row_number().over(same)).where("__n = 1")
            .select(*df.columns))


def _hashable(df: DataFrame) -> list[Column]:
    return [F.to_json(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
            for f in df.schema]
