"""Strength of drivers within their team, of teams within a round and of engines over their teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import grid_modifier, require
from stintline.rules import STRENGTH

SIGNALS = {
    "quali": ("quali_pace_s", "quali_suspect", STRENGTH.quali_outlier_s),
    "race": ("long_run_pace_s", "long_run_suspect", STRENGTH.long_run_outlier_s),
}


def drop_field_outliers(pace: DataFrame, column: str, limit: float, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """A value more than ``limit`` above the best of its round becomes null."""
    best = pace.where(F.col("round").isNotNull()).groupBy(*by).agg((F.min(column) + F.lit(limit)).alias("__most"))
    joined = pace.join(F.broadcast(best), list(by), "left")  # one row a round; a window would bring a round's rows into one task
    return joined.withColumn(column, F.when(F.col(column) <= F.col("__most"), F.col(column))).select(*pace.columns)


def drop_suspects(pace: DataFrame, column: str, flag: str) -> DataFrame:
    if flag not in pace.columns:
        return pace
    return pace.withColumn(column, F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(column)))


def named_team(team: Column) -> Column:
    return team.isNotNull() & (F.trim(team.cast("string")) != "")


def clean_signal(pace: DataFrame, signal: str, by_season: bool = False, outlier_s: float | None = None) -> DataFrame:
    column, flag, limit = SIGNALS[signal]
    require(pace, "round", "team", "driver", column)
    cleaned = drop_field_outliers(pace, column, limit if outlier_s is None else outlier_s, ("season", "round") if by_season else ("round",))
    return drop_suspects(cleaned, column, flag).where(F.col(column).isNotNull() & named_team(F.col("team")))


def standard_error(std: Column, n: Column) -> Column:
    return F.when(n >= 2, F.greatest(std / F.sqrt(n), F.lit(STRENGTH.min_sd))).otherwise(STRENGTH.wide_sd)


def driver_strengths(pace: DataFrame, signal: str = "quali", min_rounds: int = 1, by_season: bool = False, outlier_s: float | None = None) -> DataFrame:
    """(driver, mean, sd, n_obs): how much faster than the team's mean, over rounds with two drivers or more, centred on zero."""
    column = SIGNALS[signal][0]
    team = Window.partitionBy("season", "round", "team")
    rows = clean_signal(pace, signal, by_season, outlier_s).where(F.col("driver").isNotNull())
    rows = rows.withColumns({"mates": F.count("driver").over(team), "speed": F.avg(column).over(team) - F.col(column)}).where("mates >= 2")
    per = rows.groupBy("driver").agg(F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("std"), F.count(F.lit(1)).alias("n_obs"))
    per = per.where(F.col("n_obs") >= min_rounds)
    centre = per.agg(F.avg("mean").alias("centre"))
    return per.crossJoin(F.broadcast(centre)).select(  # one row
        "driver", (F.col("mean") - F.col("centre")).alias("mean"), standard_error(F.col("std"), F.col("n_obs")).alias("sd"), "n_obs"
    )


def team_strengths(pace: DataFrame, signal: str = "quali", by_season: bool = False, outlier_s: float | None = None, engine_of: DataFrame | None = None) -> DataFrame:
    """(team, mean, sd, n_obs, engine): the negated mean pace of each round, centred in its round, over rounds."""
    column = SIGNALS[signal][0]
    rows = clean_signal(pace, signal, by_season, outlier_s)
    rounds = rows.groupBy("season", "round", "team").agg(F.avg(column).alias("pace"))
    field = ["season", "round"] if by_season else ["round"]
    centre = rounds.groupBy(*field).agg(F.avg("pace").alias("centre"))
    rounds = rounds.join(F.broadcast(centre), field).withColumn("speed", F.col("centre") - F.col("pace"))  # one row a round
    per = rounds.groupBy("team").agg(F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("std"), F.count(F.lit(1)).alias("n_obs"))
    per = per.select("team", "mean", standard_error(F.col("std"), F.col("n_obs")).alias("sd"), "n_obs")
    return per.withColumn("engine", F.lit(None).cast("string")) if engine_of is None else per.join(engine_of, "team", "left")


def engine_strengths(teams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, engine, mean, sd, n_teams): means weighted by observations; teams without an engine are left out."""
    rows, keys = teams.where(F.col("engine").isNotNull()), [*by, "engine"]
    weight = F.col("n_obs").cast("double")
    means = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(weight * F.col("mean")), F.sum(weight)).alias("centre"), F.sum(weight).alias("w"), F.max(weight).alias("most"), F.count(F.lit(1)).alias("n_teams")
    )
    spread = rows.join(means.select(*keys, "centre"), keys).groupBy(*keys).agg(F.sum(weight * F.pow(F.col("mean") - F.col("centre"), 2)).alias("ss"))
    wide = F.sqrt(F.col("ss") / F.col("w")) / F.sqrt(F.col("w") / F.col("most"))
    sd = F.when((F.col("w") > 0) & (F.col("n_teams") >= 2), F.greatest(wide, F.lit(STRENGTH.min_sd))).otherwise(STRENGTH.wide_sd)
    return means.join(spread, keys).select(*keys, F.coalesce("centre", F.lit(0.0)).alias("mean"), sd.alias("sd"), "n_teams")


def strength_long(drivers: DataFrame, teams: DataFrame, engines: DataFrame, as_of_round: int) -> DataFrame:
    """(as_of_round, entity_type, entity_id, mean, sd) of all three kinds."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(as_of_round).alias("as_of_round"), F.lit(kind).alias("entity_type"), F.col(kind).cast("string").alias("entity_id"), "mean", "sd")

    return rows(drivers, "driver").unionByName(rows(teams, "team")).unionByName(rows(engines, "engine"))


def fit_all(pace: DataFrame, signal: str = "quali", min_rounds: int = 1, engine_of: DataFrame | None = None, as_of_round: int | None = None, **options) -> dict[str, DataFrame]:
    """Drivers, teams and engines from rounds up to ``as_of_round``."""
    seen = pace if as_of_round is None else pace.where(F.col("round") <= as_of_round)
    teams = team_strengths(seen, signal, engine_of=engine_of, **options)
    return {"driver": driver_strengths(seen, signal, min_rounds, **options), "team": teams, "engine": engine_strengths(teams)}


def latest_team(pace: DataFrame) -> DataFrame:
    """(driver, team): the last named team by season and round."""
    return pace.where(named_team(F.col("team"))).groupBy("driver").agg(F.max_by("team", F.struct("season", "round", "team")).alias("team"))


def total_strength(drivers: DataFrame, teams: DataFrame, latest: DataFrame) -> DataFrame:
    """(driver, team, mean, sd): driver plus current team; an unknown team adds nothing."""
    effect = teams.select("team", F.col("mean").alias("team_mean"))
    joined = drivers.join(latest, "driver", "left").join(effect, "team", "left")
    return joined.select("driver", "team", (F.col("mean") + F.coalesce("team_mean", F.lit(0.0))).alias("mean"), "sd")


def with_grid(strengths: DataFrame, grid: DataFrame, scale: float = STRENGTH.grid_scale) -> DataFrame:
    """Move each driver's mean by starting place; ``grid`` has (driver, grid)."""
    n = grid.agg(F.count(F.lit(1)).alias("entrants"))
    placed = strengths.join(grid.select("driver", "grid"), "driver", "left").crossJoin(F.broadcast(n))  # one row
    move = F.coalesce(grid_modifier(F.col("grid"), F.col("entrants"), scale), F.lit(0.0))
    return placed.withColumn("mean", F.col("mean") + move).drop("entrants")
