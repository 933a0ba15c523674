"""Incremental labour feed with Structured Streaming.

New scheduler exports land as JSON files in a folder. A booking that is
already in the labour table (all key columns equal, nulls included) is
dropped wherever and whenever it is sent again; a booking that differs in
hours survives, and a booking that arrives late is kept however old it is.

Two steps. Keyed state drops what was sent in the last ``keep`` (30 days by default): the
watermark runs on the time of arrival, so no row is ever late, and the state
holds recent keys only. What passes is new or was last sent longer
ago; it meets the table in an anti-join. Equal bookings start on the same day, and
the table is partitioned by the month of the start, so the anti-join reads only
the months that the batch names: its cost follows the batch, not the table.

Every micro-batch overwrites its own partitions (month, ``batch_id``: the number
and a mark of the checkpoint) and never compares itself with them, so a batch
that is replayed after a failure leaves the table as one run would, and a feed
that starts over with another checkpoint neither overwrites nor repeats rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.functions.text import inclusive_days, total_hours
from tradeflow.session import CLEAN_UP, removed, settings, written

BOOKING_SCHEMA = ("task_id string, name string, employee string, start_date date, end_date date, "
                  "daily_hours double, exported_at timestamp")
DEDUP_KEYS = ["task_id", "name", "employee", "start_date", "end_date", "daily_hours"]
MONTH = "start_month"


#: The keys of the state lie on disk, in memory only as far as they are in use: the default store holds each in a map.
#: Where the session names a store, that one is used; a checkpoint goes on with the store that it began with.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def sent_key() -> list[Column]:
    """128 bits for a booking: the state holds them in place of its columns. Nulls have their place, as a hash skips them."""
    nulls = F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in DEDUP_KEYS])
    return [F.xxhash64(F.lit(salt), nulls, *DEDUP_KEYS).alias(name) for salt, name in ((1, "_sent_a"), (2, "_sent_b"))]


def labour_stream(spark: SparkSession, folder: str, keep: str = "30 days") -> DataFrame:
    """The bookings of the files in ``folder``, without those that came before within ``keep``."""
    s = spark.readStream.schema(BOOKING_SCHEMA).json(folder)
    s = (s.select("*", *sent_key()).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
         .dropDuplicatesWithinWatermark(["_sent_a", "_sent_b"]).drop("_arrived", "_sent_a", "_sent_b"))
    return s.withColumn("num_days", inclusive_days("start_date", "end_date")) \
        .withColumn("total_hours", total_hours("num_days", "daily_hours")) \
        .withColumn(MONTH, F.coalesce(F.date_format("start_date", "yyyy-MM"), F.lit("none")))


def new_bookings(batch: DataFrame, known: DataFrame, once: bool = False) -> DataFrame:
    """The batch's bookings, each once, that ``known`` does not hold; ``once``: the batch has each booking once already, as what
    passes the state has."""
    same = F.lit(True)
    for k in DEDUP_KEYS:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}"))
    return (batch if once else batch.dropDuplicates(DEDUP_KEYS)).alias("b").join(known.select(*DEDUP_KEYS).alias("k"), same, "left_anti")


def table(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """The labour table; the schema is given, so that a table without rows reads as none."""
    return spark.read.schema(schema).parquet(out_path)


def start_feed(spark: SparkSession, folder: str, out_path: str, checkpoint: str, trigger_once: bool = True,
               keep: str = "30 days"):
    """Adds each batch's new bookings to the table at ``out_path``."""
    stream = labour_stream(spark, folder, keep)
    schema = stream.schema.add("batch_id", "string")
    mark = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    spark.createDataFrame([], schema).write.mode("append").partitionBy(MONTH, "batch_id").parquet(out_path)  # the table exists

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        own = f"{mark}-{batch_id}"
        rows = written(batch, "batch")  # the state's result, read for its months and for its rows
        try:
            months = [r[0] for r in rows.select(MONTH).distinct().collect()]  # calendar months
            known = table(rows.sparkSession, out_path, schema).filter(F.col(MONTH).isin(months) & (F.col("batch_id") != own))
            # dealt by month, so that a batch writes few files; AQE splits a month that holds most rows
            with settings(rows.sparkSession, CLEAN_UP):
                (new_bookings(rows, known, once=True).withColumn("batch_id", F.lit(own)).hint("rebalance", MONTH).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(MONTH, "batch_id").parquet(out_path))
        finally:
            removed(rows)

    q = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if trigger_once else q.trigger(processingTime="1 minute")
    with settings(spark, {} if any(spark.conf.get(k, None) for k in STATE_STORE) else STATE_STORE):
        return q.start()
