"""Grid penalties for power-unit elements beyond the allocation, and the risk of more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.scalars import component_life, from_pit_lane, penalty_positions, poisson_cdf, require
from stintline.rules import COMPONENTS, PENALTY


def component_state(usage: DataFrame, order: str = "seq") -> DataFrame:
    """(driver, component, used, allowed): most units used and the last allowance by ``order``."""
    require(usage, "driver", "component", "units_used", "units_allowed", order)
    return usage.groupBy("driver", "component").agg(F.max("units_used").alias("used"), F.max_by("units_allowed", order).alias("allowed"))


def driver_penalties(usage: DataFrame, order: str = "seq") -> DataFrame:
    """One row a driver: units used and left of each element, grid places lost, start from the pit lane."""
    state = component_state(usage, order)
    state = state.withColumns({"left": F.greatest(F.col("allowed") - F.col("used"), F.lit(0)), "lost": penalty_positions(F.col("used") - F.col("allowed"))})
    own = lambda c, x: F.coalesce(F.max(F.when(F.col("component") == c, F.col(x))), F.lit(0)).cast("int")
    wide = state.groupBy("driver").agg(
        *[e for c in COMPONENTS for e in (own(c, "used").alias(f"{c}_used"), own(c, "left").alias(f"{c}_remaining"))],
        F.sum("lost").cast("int").alias("penalty_positions_total"),
    )
    return wide.withColumn("starts_from_pit_lane", from_pit_lane(F.col("penalty_positions_total")))


def penalty_risk(usage: DataFrame, races_left: int, laps_per_race: float = PENALTY.laps_per_race, order: str = "seq", lives: DataFrame | None = None) -> DataFrame:
    """(driver, penalty_risk_season, penalty_risk_next_race, expected_penalty_pos).

    Failures of an element over the races left are Poisson; a penalty follows when they exceed the
    units left; with no race left nobody is at risk and the result is empty. ``lives`` may override the mean lives (component, life).
    """
    if races_left < 0:
        raise ValueError("races_left must not be negative")
    state = component_state(usage.where(F.lit(races_left > 0)), order)
    if lives is not None:
        state = state.join(lives.withColumnRenamed("life", "own_life"), "component", "left")
    life = component_life(F.col("component"), F.col("own_life") if lives is not None else None)
    rate = F.lit(float(races_left) * laps_per_race) / life
    left = F.greatest(F.col("allowed") - F.col("used"), F.lit(0))
    risk = state.withColumns({"rate": rate, "left": left}).withColumn("p", 1 - poisson_cdf(F.col("left"), F.col("rate")))
    wide = risk.groupBy("driver").agg(
        *[F.coalesce(F.max(F.when(F.col("component") == c, F.col("p"))), F.lit(0.0)).alias(c) for c in COMPONENTS],
        F.sum(F.greatest(F.col("rate") - F.col("left"), F.lit(0.0)) * F.col("p")).alias("extra"),
    )
    safe = reduce(lambda a, b: a * b, [1 - F.col(c) for c in COMPONENTS])
    return wide.select(
        "driver",
        (1 - safe).alias("penalty_risk_season"),
        (F.least((1 - safe) / F.lit(float(max(races_left, 1))), F.lit(1.0))).alias("penalty_risk_next_race"),
        (PENALTY.first + F.greatest(F.rint("extra") - 1, F.lit(0.0)) * PENALTY.further).alias("expected_penalty_pos"),
    )
