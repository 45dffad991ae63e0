"""Dashboard documents: nested structs turned into JSON by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.functions.scalars import points, round_even
from stintline.rules import RACE_POINTS

# Which of a round's forecasts a page shows first.
CUTOFF_PRIORITY = {"post-q": 1, "post-sprint": 2, "pre-fp1": 3}


def _shown(value: Column, digits: int) -> Column:
    """Half-even rounding of what the value is but for the noise of summing."""
    scale = float(10**digits)
    return round_even(F.round(value * scale, 6), 0) / F.lit(scale)


def driver_rows(forecast: DataFrame, results: DataFrame) -> DataFrame:
    """(round, driver, win_prob, podium_prob, points_prob, expected_points, actual_position), rounded as shown; by cutoff where the forecast has several."""
    keys = ["round", *[c for c in ("cutoff", "cutoff_date") if c in forecast.columns], "driver"]
    p, pos = F.col("probability"), F.col("finish_pos")
    rows = forecast.groupBy(*keys).agg(
        *[_shown(F.sum(F.when(pos <= k, p).otherwise(0.0)), 4).alias(n) for n, k in (("win_prob", 1), ("podium_prob", 3), ("points_prob", 10))],
        _shown(F.sum(p * points(pos, RACE_POINTS)), 2).alias("expected_points"),
    )
    return rows.join(results.select("round", "driver", F.col("position").alias("actual_position")), ["round", "driver"], "left")


def with_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Add display name and team; unknown drivers show their id and the team ``unknown``."""
    return rows.join(meta, "driver", "left").withColumns(
        {"display_name": F.coalesce("display_name", F.col("driver").cast("string")), "team": F.coalesce(F.col("team").cast("string"), F.lit("unknown"))}
    )


#: Days before a race from which its forecast is shown (a fixed value).
WEEKEND_DAYS = 4


def results_lookup(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """All rows of the first source, and those of the fallback for rounds that the first lacks."""
    return first.unionByName(fallback.join(first.select("round").distinct(), "round", "left_anti"))


def default_cutoffs(available: DataFrame) -> DataFrame:
    """(round, cutoff): the forecast of each round that a page shows first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in CUTOFF_PRIORITY.items() for x in kv]), F.col("cutoff"))
    return available.groupBy("round").agg(F.min_by("cutoff", rank).alias("cutoff"))


def default_round(available: DataFrame, schedule: DataFrame, as_of: str) -> DataFrame:
    """(round): the one a page opens with; null if there is none.

    It is the first round whose race is at most WEEKEND_DAYS ahead or one day past, with a forecast or not; else the last completed round (its race on ``as_of`` or
    before) that has a forecast; else the next one that has.
    """
    day = F.lit(as_of).cast("date")
    rounds = schedule.select("round", "date").join(available.select("round", F.lit(True).alias("known")).distinct(), "round", "left")
    ahead, order = F.datediff("date", day), F.struct("date", "round")
    first = lambda test: F.min_by("round", F.when(test, order))
    weekend = first(ahead.between(-1, WEEKEND_DAYS))
    past = F.max_by("round", F.when(F.col("known") & (ahead <= 0), order))
    return rounds.agg(F.coalesce(weekend, past, first(F.col("known") & (ahead > 0))).alias("round"))


def predictions_document(rows: DataFrame) -> DataFrame:
    """(round, document): JSON of a round's forecasts by cutoff, drivers from the most likely winner down.

    ``rows`` has (round, cutoff, cutoff_date) and the columns of ``driver_rows``.
    """
    fields = [c for c in rows.columns if c not in ("round", "cutoff", "cutoff_date")]
    drivers = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("win_prob")).alias("__o"), *fields))), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    per = rows.groupBy("round", "cutoff", "cutoff_date").agg(drivers.alias("drivers"))
    cutoffs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("cutoff", F.struct("cutoff_date", F.col("cutoff_date").alias("generated_at"), "drivers")))))
    return per.groupBy("round").agg(F.to_json(F.struct(F.col("round"), cutoffs.alias("cutoffs"))).alias("document"))


def championship_document(drivers: DataFrame, constructors: DataFrame, as_of_round: int) -> DataFrame:
    """One row: a season's title chances and expected points, each from the highest down.

    ``drivers`` has (entity_id, title_prob, expected_points, display_name, team), ``constructors`` (entity_id, title_prob).
    """

    def ordered(df: DataFrame, value: str, name: str, *more: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("o"), "entity_id", F.col(value).alias("value"), *more)))
        return df.agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in ("entity_id", "value", *more)])).alias(name))

    lists = [
        ordered(drivers, "title_prob", "driver_title_probs", "display_name", "team"),
        ordered(constructors, "title_prob", "constructor_title_probs"),
        ordered(drivers, "expected_points", "driver_expected_points"),
    ]
    whole = lists[0].crossJoin(F.broadcast(lists[1])).crossJoin(F.broadcast(lists[2]))  # one row each
    return whole.select(F.to_json(F.struct(F.lit(as_of_round).alias("as_of_round"), *[f.columns[0] for f in lists])).alias("document"))


def schedule_document(schedule: DataFrame, as_of: str) -> DataFrame:
    done = F.col("date") <= F.lit(as_of).cast("date")
    names = [c for c in ("race_name", "circuit_id", "circuit_name") if c in schedule.columns]
    rows = F.sort_array(F.collect_list(F.struct("round", *names, F.col("date").cast("string").alias("date"), "has_sprint", done.alias("completed"))))
    return schedule.agg(F.to_json(F.struct(F.max("season").alias("season"), F.count(F.lit(1)).alias("n_rounds"), rows.alias("rounds"))).alias("document"))


def evaluation_document(summary: DataFrame, per_round: DataFrame) -> DataFrame:
    rounds = per_round.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("per_round"))
    return summary.select(F.struct("*").alias("summary")).crossJoin(F.broadcast(rounds)).select(F.to_json(F.struct("summary", "per_round")).alias("document"))  # one row each
