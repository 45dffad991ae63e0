"""Retirement counts and rates of drivers, teams and engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.functions.scalars import beta_rate, require, status_class


def reliability(results: DataFrame, key: str, incidents: bool = False) -> DataFrame:
    """(key, starts, counts and smoothed rates of retirements); rows without a key do not count."""
    require(results, key, "status")
    rows = results.where(F.col(key).isNotNull()).withColumn("kind", status_class(F.col("status")))
    kinds = {"mechanical": "mechanical", **({"incident": "incident", "other": "other"} if incidents else {})}
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("starts"),
        *[F.count_if(F.col("kind") == k).alias(f"{n}_dnfs") for n, k in kinds.items()],
        F.count_if(F.col("kind") != "finished").alias("total_dnfs"),
    )
    rates = ["mechanical", *(["incident"] if incidents else []), "total"]
    return counted.withColumns({f"{r}_dnf_rate": beta_rate(F.col(f"{r}_dnfs"), F.col("starts"), r) for r in rates})


def driver_reliability(results: DataFrame) -> DataFrame:
    return reliability(results, "driver", incidents=True)


def team_reliability(results: DataFrame) -> DataFrame:
    return reliability(results, "team")


def engine_reliability(results: DataFrame, engine_of: DataFrame) -> DataFrame:
    """``engine_of`` has (team, engine); teams it lacks are left out."""
    return reliability(results.drop("engine").join(engine_of, "team"), "engine")


def reliability_features(results: DataFrame, engine_of: DataFrame | None = None) -> dict[str, DataFrame | None]:
    return {
        "driver": driver_reliability(results),
        "team": team_reliability(results),
        "engine": None if engine_of is None else engine_reliability(results, engine_of),
    }
