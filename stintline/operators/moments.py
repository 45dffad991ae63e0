"""Mergeable moments of strength signals: one table of (n, sum, M2) by entity and round, from which the strengths as of every round are read.

A round's contribution does not change when later rounds come, so strengths as of all rounds are prefix sums of one table; a
stream or a weekly job adds the new rounds' rows instead of fitting the history again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintline.operators.strength import SIGNALS, clean_signal, engine_strengths, standard_error

KEYS = ["season", "round", "entity_type", "entity_id"]


def round_moments(pace: DataFrame, signal: str = "quali", by_season: bool = False, outlier_s: float | None = None) -> DataFrame:
    """(season, round, entity_type, entity_id, n, sum, m2): each driver's speed within the team, and each team's mean pace, of each round.

    Rows are dealt by (season, round, team) once; a team's drivers are all that a window holds (the best time of each round is a small sum beside). A driver counts in rounds with a team mate.
    """
    column = SIGNALS[signal][0]
    rows = clean_signal(pace, signal, by_season, outlier_s)
    team = Window.partitionBy("season", "round", "team")
    named = F.when(F.col("driver").isNotNull(), F.col(column))
    seen = rows.select(
        "season", "round", "driver", "team", F.col(column).alias("x"),
        F.count("driver").over(team).alias("mates"), F.avg(named).over(team).alias("own"), F.avg(column).over(team).alias("pace"),
        F.row_number().over(team.orderBy("driver", column)).alias("rn"),
    )
    entity = lambda kind, key, x, counts: F.struct(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), x.alias("x"), counts.alias("counts"))
    both = F.array(
        entity("driver", "driver", F.col("own") - F.col("x"), F.col("driver").isNotNull() & (F.col("mates") >= 2)),
        entity("team", "team", F.col("pace"), F.col("rn") == 1),
    )
    values = seen.select("season", "round", F.explode(both).alias("e")).select("season", "round", "e.*").where("counts")
    return values.groupBy(*KEYS).agg(F.count("x").alias("n"), F.sum("x").alias("sum"), (F.coalesce(F.var_pop("x"), F.lit(0.0)) * F.count("x")).alias("m2"))


def merged(moments: DataFrame, *by: str) -> DataFrame:
    """Moments of the union: counts and sums add up, M2 by way of the sum of squares (values lie around zero, so little is lost)."""
    squares = F.sum(F.col("m2") + F.col("sum") * F.col("sum") / F.col("n"))
    total, n = F.sum("sum"), F.sum("n")
    return moments.where("n > 0").groupBy(*by).agg(n.alias("n"), total.alias("sum"), F.greatest(squares - total * total / n, F.lit(0.0)).alias("m2"))


def centred_teams(moments: DataFrame, by_season: bool = False) -> DataFrame:
    """The moments with each team's pace turned into speed against the mean team of its round."""
    field = ["season", "round"] if by_season else ["round"]
    centre = moments.where("entity_type = 'team'").groupBy(*field).agg((F.sum("sum") / F.sum("n")).alias("centre"))
    is_team = F.col("entity_type") == "team"
    joined = moments.join(F.broadcast(centre), field, "left")  # one row a round
    return joined.withColumn("sum", F.when(is_team, F.col("n") * F.col("centre") - F.col("sum")).otherwise(F.col("sum"))).select(*KEYS, "n", "sum", "m2")


def _spread(squares: Column, total: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1))


def strengths_by_round(moments: DataFrame, rounds: DataFrame | None = None, min_rounds: int = 1, by_season: bool = False, engine_of: DataFrame | None = None) -> DataFrame:
    """(as_of_round, entity_type, entity_id, mean, sd, n_obs) of drivers, teams and, with ``engine_of`` (team, engine), engines, as of each round.

    The moments are read several times: store them (``artifacts.materialised``), and features are read once, whatever the rounds.
    ``rounds`` (round) are the rounds asked for, those of the moments by default. Each entity's rounds are summed along one window, at most a calendar
    long; an entity keeps its strength in rounds without it, and has none before its first.
    """
    rows = centred_teams(moments, by_season)
    asked = (moments.select("round") if rounds is None else rounds.select("round")).where("round is not null").distinct()
    calendar = asked.agg(F.collect_set("round").alias("rounds"))  # one row, a calendar long
    squares = F.col("m2") + F.col("sum") * F.col("sum") / F.col("n")
    facts = rows.where("n > 0").select("entity_type", "entity_id", "round", "n", "sum", squares.alias("squares"), F.lit(False).alias("asked"))
    entities = facts.select("entity_type", "entity_id").distinct().crossJoin(F.broadcast(calendar))
    blank = entities.select("entity_type", "entity_id", F.explode("rounds").alias("round"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"), F.lit(True).alias("asked"))
    dense = facts.unionByName(blank).groupBy("entity_type", "entity_id", "round").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"), F.max("asked").alias("asked"))
    along = Window.partitionBy("entity_type", "entity_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    so_far = dense.select("entity_type", "entity_id", F.col("round").alias("as_of_round"), "asked", *[F.sum(c).over(along).alias(c) for c in ("n", "sum", "squares")])
    n, total = F.col("n"), F.col("sum")
    fits = so_far.where("asked and n > 0").select(
        "as_of_round", "entity_type", "entity_id", (total / n).alias("mean"), standard_error(_spread(F.col("squares"), total, n), n).alias("sd"), n.alias("n_obs")
    )
    fits = fits.where((F.col("entity_type") != "driver") | (F.col("n_obs") >= min_rounds))
    centre = fits.where("entity_type = 'driver'").groupBy("as_of_round").agg(F.avg("mean").alias("centre"))
    shifted = fits.join(F.broadcast(centre), "as_of_round", "left")  # one row a round
    out = shifted.withColumn("mean", F.when(F.col("entity_type") == "driver", F.col("mean") - F.col("centre")).otherwise(F.col("mean"))).drop("centre")
    if engine_of is None:
        return out
    teams = out.where("entity_type = 'team'").join(engine_of.select(F.col("team").cast("string").alias("entity_id"), "engine"), "entity_id")
    engines = engine_strengths(teams.select("as_of_round", "engine", "mean", "sd", "n_obs"), by=("as_of_round",))
    return out.unionByName(engines.select("as_of_round", F.lit("engine").alias("entity_type"), F.col("engine").cast("string").alias("entity_id"), "mean", "sd", F.col("n_teams").alias("n_obs")))
