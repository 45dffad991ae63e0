"""New laps as a stream: each round's features once its files have landed, and a running state of every driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stintline.operators import pace, quantiles
from stintline.operators.point_in_time import as_date
from stintline.sources.artifacts import replace_rounds, shared_folder


def lap_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feature_sink(laps: DataFrame, all_laps: str, features: str, checkpoint: str) -> StreamingQuery:
    """Recompute and replace the features of every round that a batch has laps of; ends when all files are done.

    A round's laps may come in several batches, so a batch names the rounds and their features
    come from all laps stored so far. Replacing whole partitions makes a repeated batch harmless.
    """

    def replace(batch: DataFrame, _: int) -> None:
        rounds = batch.select("season", "round").distinct()
        stored = batch.sparkSession.read.parquet(all_laps)
        touched = stored.join(rounds, ["season", "round"], "left_semi")
        replace_rounds(batch.sparkSession, features, pace.pace_features(pace.accurate_laps(touched), touched.where("not is_accurate")))

    return laps.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_sink(laps: DataFrame, counts: str, checkpoint: str, ticks: int = quantiles.TICKS) -> StreamingQuery:
    """Add each batch's laps to the tick counts of their stints; ends when all files are done.

    A batch overwrites a partition of its own, so a repeated one counts once, and no batch reads laps of another. ``stored_counts`` adds the partitions up.
    """

    def store(batch: DataFrame, number: int) -> None:
        quantiles.stint_counts(batch, ticks=ticks).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    return laps.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, counts: str) -> DataFrame:
    return quantiles.merged_stints(spark.read.parquet(counts))


def windowed_pace(laps: DataFrame, delay: str = "2 hours", width: str = "10 minutes") -> DataFrame:
    """Mean and best time of each driver by window of the lap's end (``ts``); later laps than ``delay`` are left out by the watermark."""
    return (
        laps.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "driver")
        .agg(F.count(F.lit(1)).alias("laps"), F.avg("lap_s").alias("mean_lap_s"), F.min("lap_s").alias("best_lap_s"))
    )


def running_best(laps: DataFrame) -> DataFrame:
    """Each driver's best valid lap and lap count so far (update or complete mode)."""
    return pace.valid_laps(laps).groupBy("driver").agg(F.min("lap_s").alias("best_lap_s"), F.count(F.lit(1)).alias("laps"))


def guarded(rows: DataFrame, cutoffs: DataFrame, date: str = "date") -> DataFrame:
    """Rows from before their round's cutoff, joined with a static table; late data is the caller's to report, a watermark would hide it."""
    return rows.join(F.broadcast(cutoffs) if cutoffs.count() <= 10_000 else cutoffs, "round").where(as_date(F.col(date)) < F.col("cutoff")).drop("cutoff")


def drained(totals: DataFrame, folder: str) -> DataFrame:
    """A streaming aggregate's table once all its files are read; each batch overwrites ``folder``'s result with what is known so far."""
    query = (
        totals.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/result"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return totals.sparkSession.read.parquet(f"{folder}/result")


def event_windows(spark: SparkSession, sf_dir: str, width: str = "6 hours") -> DataFrame:
    """(window_start, event_type, n, total) of the events table read as a stream of files, until none is left; the state is the windows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")
    return drained(rows, f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}")
