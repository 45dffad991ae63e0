"""Exact quantiles that merge: counts by tick (a fixed part of a second) instead of the laps themselves.

Times come in whole ticks, so counts hold all that a median or quartile needs, however many laps there are; counts of new laps are added to
those stored. The fuel correction fits in: a lap's time less the fuel of the laps still to come in the stint is (time + age x cost) less
the greatest age x cost, so (time + age x cost) is what is counted, and only the greatest age changes as laps come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.operators.pace import LAP_ORDER, SESSION, green_laps, valid_laps
from stintline.rules import PACE

#: Ticks a second: timing comes in milliseconds.
TICKS = 1000


def tick_counts(df: DataFrame, keys: list[str], value: Column, ticks: int = TICKS) -> DataFrame:
    """(keys, tick, n): how many values lie on each tick; values between ticks go to the nearest. A null value has a null tick."""
    return df.select(*keys, F.round(value * ticks).cast("bigint").alias("tick")).groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(keys: list[str], *counts: DataFrame) -> DataFrame:
    """Counts of all the frames' values together."""
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*keys, "tick").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], at: dict[str, float], ticks: int = TICKS) -> DataFrame:
    """(keys, n, a column for each of ``at``): exact quantiles, interpolated between neighbours as ``percentile`` does.

    A window holds a key's different ticks, not its values; null ticks are left out.
    """
    known = counts.where(F.col("tick").isNotNull())
    along = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    summed = known.withColumns({"__upto": F.sum("n").over(along), "__all": F.sum("n").over(Window.partitionBy(*keys))})
    found = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("__all") - 1)
        low, high = (F.min(F.when(F.col("__upto") > f(place), F.col("tick"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        found.append(((low + (high - low) * part) / ticks).alias(name))
    return summed.groupBy(*keys).agg(F.max("__all").alias("n"), *found)


def stint_counts(laps: DataFrame, session: list[str] = SESSION, ticks: int = TICKS, kg: float = PACE.fuel_kg_per_lap, s_per_kg: float = PACE.seconds_per_kg) -> DataFrame:
    """(session, driver, stint, aged, tick, n, age, first): green valid laps by (time + age x fuel cost), with the greatest age and the first lap's team.

    A lap whose tyre has no age carries no fuel and is counted by its time, as not ``aged``.
    """
    green = valid_laps(green_laps(laps))
    cost = F.col("lap_s") + F.coalesce(F.col("tyre_life"), F.lit(0)) * F.lit(kg) * F.lit(s_per_kg)
    tick, aged = F.round(cost * ticks).cast("bigint").alias("tick"), F.col("tyre_life").isNotNull().alias("aged")
    keyed = green.select(*session, "driver", "stint", aged, tick, "tyre_life", F.struct(*LAP_ORDER, "team").alias("first"))
    return keyed.groupBy(*session, "driver", "stint", "aged", "tick").agg(F.count(F.lit(1)).alias("n"), F.max("tyre_life").alias("age"), F.min("first").alias("first"))


def merged_stints(counts: DataFrame, session: list[str] = SESSION) -> DataFrame:
    return counts.groupBy(*session, "driver", "stint", "aged", "tick").agg(F.sum("n").alias("n"), F.max("age").alias("age"), F.min("first").alias("first"))


def long_run_from_counts(
    counts: DataFrame, session: list[str] = SESSION, min_laps: int = PACE.min_long_run_laps, ticks: int = TICKS, kg: float = PACE.fuel_kg_per_lap, s_per_kg: float = PACE.seconds_per_kg, factor: float = PACE.iqr_factor
) -> DataFrame:
    """(session, driver, team, long_run_pace_s, long_run_n) as ``pace.long_run_pace`` finds them on all laps, from merged counts alone."""
    stint, driver = [*session, "driver", "stint"], [*session, "driver"]
    whole = Window.partitionBy(*stint)
    long = counts.withColumns({"__laps": F.sum("n").over(whole), "__age": F.max("age").over(whole)}).where(F.col("__laps") >= min_laps)
    fuel = F.when(F.col("aged"), F.round(F.col("__age") * F.lit(kg * s_per_kg * ticks)).cast("bigint")).otherwise(0)
    corrected = long.withColumn("tick", F.col("tick") - fuel).groupBy(*stint, "tick").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    bounds = quantiles(corrected, stint, {"q1": 0.25, "q3": 0.75}, ticks=1).select(*stint, (F.col("q3") * (1 + factor) - F.col("q1") * factor).alias("bound"))
    kept = corrected.join(bounds, stint).where(F.col("tick") <= F.col("bound"))
    by_driver = kept.groupBy(*driver, "tick").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    median = quantiles(by_driver, driver, {"long_run_pace_s": 0.5}, ticks)
    team = by_driver.groupBy(*driver).agg(F.min("first")["team"].alias("team"))
    return median.join(team, driver).select(*driver, "team", "long_run_pace_s", F.col("n").alias("long_run_n"))
