"""Gaps between team mates, suspect times, team names carried over rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import require
from stintline.operators.strength import named_team
from stintline.rules import PACE


def teammate_gaps(pace: DataFrame, by: tuple[str, ...] = ("season", "round")) -> DataFrame:
    """(by, team, driver, gap_race, gap_quali): own value less the team mate's; null without one.

    Of a team's drivers the first two by name count; both are in one window partition of at most a
    team's rows a round.
    """
    require(pace, *by, "team", "driver", "long_run_pace_s", "quali_pace_s")
    team = Window.partitionBy(*by, "team").orderBy("driver")
    firsts = pace.where(F.col("team").isNotNull()).withColumn("rn", F.row_number().over(team)).where("rn <= 2")

    def gap(column: str) -> F.Column:
        other = F.coalesce(F.lead(column).over(team), F.lag(column).over(team))
        own = F.col(column)
        return own - F.when(F.count(F.lit(1)).over(Window.partitionBy(*by, "team")) == 2, other)

    return firsts.select(*by, "team", "driver", gap("long_run_pace_s").alias("gap_race"), gap("quali_pace_s").alias("gap_quali"))


def flag_suspects(
    pace: DataFrame, by: tuple[str, ...] = ("season", "round"), long_run_s: float = PACE.suspect_long_run_s, quali_s: float = PACE.suspect_quali_s
) -> DataFrame:
    """Add ``long_run_suspect`` and ``quali_suspect``: the slower of exactly two values that lie too far apart."""
    team = Window.partitionBy(*by, "team")

    def slower(column: str, limit: float) -> F.Column:
        low, high = F.min(column).over(team), F.max(column).over(team)
        flag = (F.count(column).over(team) == 2) & (high - low > limit) & (F.col(column) == high) & F.col("team").isNotNull()
        return F.coalesce(flag, F.lit(False))

    return pace.withColumns({"long_run_suspect": slower("long_run_pace_s", long_run_s), "quali_suspect": slower("quali_pace_s", quali_s)})


def fill_teams(features: DataFrame, key: str = "driver", order: tuple[str, ...] = ("season", "round"), column: str = "team") -> DataFrame:
    """A missing or blank team is the driver's last known one in calendar order, else the next known one. A frame of one season needs no season."""
    along = Window.partitionBy(key).orderBy(*[c for c in order if c in features.columns])
    known = F.when(named_team(F.col(column)), F.col(column))
    before = F.last(known, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    return features.withColumn(column, F.coalesce(before, after))


def full_features(pace: DataFrame, by: tuple[str, ...] = ("season", "round"), long_run_s: float = PACE.suspect_long_run_s, quali_s: float = PACE.suspect_quali_s) -> DataFrame:
    """Pace features as they are stored: missing teams filled over rounds, gaps to the team mate (null without one), suspect flags."""
    filled = fill_teams(pace)
    flagged = flag_suspects(filled, by, long_run_s, quali_s)
    both = teammate_gaps(filled, by).select(*by, "driver", F.col("gap_race").alias("gap_to_teammate_race"), F.col("gap_quali").alias("gap_to_teammate_quali"))
    return flagged.join(both, [*by, "driver"], "left")
