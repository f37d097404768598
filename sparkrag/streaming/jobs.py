"""Streaming jobs without custom state: window counts, idempotent creates, upserts.

Creates and upserts write one folder per micro-batch.  A batch that is repeated after a failure
overwrites its own folder, so the result is exactly once and no stored file is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..operators.ops import idempotency_key, idempotent_create, newest_wins

_BATCH = "batch_no"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_BUCKET = "key_bucket"
KEY_BUCKETS = 64


def read_stream(spark: SparkSession, directory: str, glob: str, schema: T.StructType,
                files_per_batch: int | None = None) -> DataFrame:
    """The files that ``glob`` names in ``directory``; a name can be a folder of files as well.

    A stream takes a plain path as the base of partition folders, which a file cannot be.  As a
    pattern of one name it stays a path, and the base is the folder around it.
    """
    directory = directory.rstrip("/") or "/"
    r = spark.readStream.schema(schema).option("basePath", directory)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{directory.rstrip('/')}/{{{glob}}}")


def run(spark: SparkSession, query_writer, checkpoint: str, empty_batches: bool = True) -> None:
    """Process everything that is available and stop.

    State with a processing-time limit asks for another batch without data for ever, so such
    batches are off while the query runs.
    """
    conf, before = spark.conf, spark.conf.get(_EMPTY_BATCHES, "true")
    conf.set(_EMPTY_BATCHES, str(empty_batches).lower())
    try:
        q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_EMPTY_BATCHES, before)
    q.awaitTermination()


def window_counts(events: DataFrame, watermark: str = "1 hour", width: str = "1 hour",
                  ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Append-mode counts per tumbling window; rows later than the watermark are dropped."""
    return (events.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"), kind)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), kind, "n"))


def dedup_requests(requests: DataFrame, watermark: str, ts: str = "ts") -> DataFrame:
    """One request per idempotency key within the watermark.  State stays bounded; a replay later
    than the watermark passes, so the write still checks the stored keys (``create_tasks``)."""
    return (requests.withColumn("idempotency_key", idempotency_key()).withWatermark(ts, watermark)
            .dropDuplicatesWithinWatermark(["idempotency_key"]))


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
    try:
        return spark.read.schema(full).parquet(path).filter(F.col(_BATCH) < before)
    except Exception as exc:  # the table does not exist before the first batch
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], full)


def create_tasks(requests: DataFrame, path: str, order: list[str], checkpoint: str) -> None:
    """Append the first request of every key that no earlier batch has stored.

    Rows are stored in folders by a hash of their key; a batch reads the keys of its own folders
    only.
    """
    def write(batch: DataFrame, n: int) -> None:
        known = T.StructType([T.StructField("idempotency_key", T.StringType()),
                              T.StructField(_BUCKET, T.IntegerType())])
        placed = batch.withColumn(_BUCKET, _key_bucket(idempotency_key()))
        mine = [r[0] for r in placed.select(_BUCKET).distinct().collect()]  # KEY_BUCKETS at most
        old = _stored(batch.sparkSession, path, known, n).where(F.col(_BUCKET).isin(mine))
        new = idempotent_create(batch, order, old.select("idempotency_key"))
        (new.withColumn(_BUCKET, _key_bucket(F.col("idempotency_key"))).write.mode("overwrite")
         .partitionBy(_BUCKET).parquet(f"{path}/{_BATCH}={n}"))

    run(requests.sparkSession, requests.writeStream.foreachBatch(write), checkpoint)


def _key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def compact(log: DataFrame, path: str, key: list[str], order: list[str]) -> DataFrame:
    """One row per key of a log of many batches, written to a new ``path`` and read back.

    Readers move to the new path when it is complete; the log stays as it is until then.
    """
    newest_wins(log.drop(_BATCH, _BUCKET), key, order).write.mode("errorifexists").parquet(path)
    return log.sparkSession.read.parquet(path)


def log_patches(patches: DataFrame, path: str, order: list[str], checkpoint: str,
                fields: tuple[str, ...] = V.PATCH_FIELDS) -> None:
    """Append each batch's last non-null value per task and field, with its order key.

    The log holds one row per task and batch; ``current_tasks`` merges it on read.
    """
    def write(batch: DataFrame, n: int) -> None:
        at = F.struct(*order)
        last = batch.groupBy("task_id").agg(*[
            F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v"))))
            .alias(f) for f in fields])
        last.write.mode("overwrite").parquet(f"{path}/{_BATCH}={n}")

    run(patches.sparkSession, patches.writeStream.foreachBatch(write), checkpoint)


def current_tasks(tasks: DataFrame, log: DataFrame, fields: tuple[str, ...] = V.PATCH_FIELDS
                  ) -> DataFrame:
    """Stored tasks with the logged patches applied."""
    last = log.groupBy("task_id").agg(*[F.max(f).alias("__" + f) for f in fields])
    out = tasks.join(last, "task_id", "left")
    return out.withColumns({f: F.coalesce(F.col("__" + f)["v"], F.col(f)) for f in fields}
                           ).select(*tasks.columns)


def log_newest(rows: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str
               ) -> None:
    """Append each batch's newest row per key; ``newest_wins`` over the log gives current rows."""
    def write(batch: DataFrame, n: int) -> None:
        newest_wins(batch, key, order).write.mode("overwrite").parquet(f"{path}/{_BATCH}={n}")

    run(rows.sparkSession, rows.writeStream.foreachBatch(write), checkpoint)


def append(rows: DataFrame, path: str, checkpoint: str, empty_batches: bool = True) -> None:
    """Append-only feed (trace, audit, results) as Parquet."""
    run(rows.sparkSession, rows.writeStream.format("parquet").option("path", path)
        .outputMode("append"), checkpoint, empty_batches)
