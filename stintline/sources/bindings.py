"""The racing relations as projections of the order, supplier and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import lookup, points
from stintline.operators.records import place_by
from stintline.rules import RACE_POINTS

# What the event types and order priorities stand for.
STATUS_OF = {"error": "Engine", "signup": "Collision damage", "click": "+1 Lap", "purchase": "Retired", "view": "Finished"}
COMPONENT_OF = {"1-URGENT": "ICE", "2-HIGH": "TC", "3-MEDIUM": "EX", "4-NOT SPECIFIED": "MGU_K", "5-LOW": "ES"}
#: A total order of laps.
LAP_ORDER = ["lap_number", "order_key", "part_key", "lap_s"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine_of_team(team: Column) -> Column:
    return team % 5


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    team = F.floor(F.col("l_suppkey") / 2)
    return items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.year("l_shipdate").alias("season"),
        (F.year("l_shipdate") - 1994).alias("round"),
        F.col("l_suppkey").alias("driver"),
        team.alias("team"),
        engine_of_team(team).alias("engine"),
        F.col("s_nationkey").alias("nation_team"),
        F.concat("l_returnflag", "l_linestatus").alias("stint"),
        F.col("l_linenumber").alias("lap_number"),
        (60 + F.col("l_extendedprice") / 10000).alias("lap_s"),
        F.col("l_linenumber").alias("tyre_life"),
        F.when(F.col("l_returnflag") == "R", "4").otherwise("1").alias("track_status"),
        (F.col("l_linestatus") == "F").alias("is_accurate"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    round_ = F.floor((F.dayofmonth("ts") - 1) / 3) + 1
    rows = events.groupBy(round_.alias("round"), F.col("user_id").alias("driver")).agg(
        F.round(F.sum("value"), 6).alias("v"), F.max_by("event_type", "event_id").alias("event_type")
    )
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("v"), "driver")))
    shuffled = Window.partitionBy("round").orderBy((F.col("driver") * 7919) % 1009, "driver")
    return rows.select(
        F.lit(2024).alias("season"),
        "round",
        "driver",
        (F.col("driver") % 11).alias("team"),
        (F.col("driver") % 11 % 4).alias("engine"),
        "v",
        lookup(STATUS_OF, F.col("event_type"), "string").alias("status"),
        "position",
        points(F.col("position"), RACE_POINTS).alias("points"),
        F.row_number().over(shuffled).alias("grid"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("round") - 1) * 3).cast("int")).alias("date"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.col("o_custkey").alias("driver"), "o_orderpriority").agg(F.count(F.lit(1)).alias("units_used"))
    return rows.select(
        "driver", F.lit(2026).alias("season"), lookup(COMPONENT_OF, F.col("o_orderpriority"), "string").alias("component"), "units_used", F.lit(2).alias("units_allowed"), F.lit(1).alias("seq")
    )


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    scored = supplier.select(F.col("s_suppkey").alias("driver"), F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0)) / 100).cast("double").alias("points"))
    return place_by(scored, "points", ["driver"])


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = laps(spark, sf_dir).groupBy("season", "round").agg(F.min("date").alias("first_practice"), F.max("date").alias("date"))
    return days.withColumn("has_sprint", F.col("round") % 2 == 0)


def race_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrants with strength, spread, retirement rate and grid penalty, from the standings."""
    return standings(spark, sf_dir).select(
        "driver",
        (F.col("points") / 20).alias("mean"),
        (0.3 + (F.col("driver") % 5) / F.lit(10.0)).alias("sd"),
        (0.05 + (F.col("driver") % 4) * F.lit(0.05)).alias("dnf"),
        F.when(F.col("driver") % 6 == 0, 10).when(F.col("driver") % 10 == 1, 20).otherwise(0).alias("penalty_positions"),
        (F.col("driver") % 10 == 1).alias("pit_lane"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, driver, score): the form a driver brings from the round before."""
    return results(spark, sf_dir).select((F.col("round") + 1).alias("round"), "driver", (F.col("v") / 100).alias("score"))
