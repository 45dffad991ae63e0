"""Who drove in which session: the session map, and what it says of a driver's identity and team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.operators.records import bridge_names

#: Session that the rookie rule looks at, and the format of the weekends it applies to.
ROOKIE_SESSION, ROOKIE_FORMAT = "FP1", "conventional"


def event_formats(schedule: DataFrame) -> DataFrame:
    """(season, round, event_format) from a schedule with ``has_sprint``."""
    return schedule.select("season", "round", F.when(F.col("has_sprint"), "sprint_qualifying").otherwise("conventional").alias("event_format"))


def session_map(drivers: DataFrame, formats: DataFrame) -> DataFrame:
    """(season, round, session_type, event_format, car_number, driver, full_name, team, is_regular) of all sessions at once.

    ``drivers`` has a row for each driver of a session, with ``car_number``. In first practice of a conventional weekend a driver is regular
    if the car had the same driver in the race before (in the first round: in its own race); a car that race does not know counts as
    regular, and so does everybody in all other sessions. A newcomer with a new number is therefore not noticed: see ``records.absent_regulars``.
    """
    car = F.ltrim(F.trim(F.col("car_number").cast("string")), F.lit("0"))
    rows = drivers.select("season", "round", "session_type", car.alias("car_number"), F.upper("driver").alias("driver"), "full_name", "team").join(formats, ["season", "round"])
    races = rows.where("session_type = 'R'").groupBy("season", "round", "car_number").agg(F.max("driver").alias("expected"))
    judged = (F.col("session_type") == ROOKIE_SESSION) & (F.col("event_format") == ROOKIE_FORMAT)
    rows = rows.withColumn("race_before", F.when(judged, F.greatest(F.col("round") - 1, F.lit(1))))
    joined = rows.join(races.withColumnRenamed("round", "race_before"), ["season", "race_before", "car_number"], "left")
    return joined.select(
        "season", "round", "session_type", "event_format", "car_number", "driver", "full_name", "team", F.coalesce(F.col("driver") == F.col("expected"), F.lit(True)).alias("is_regular")
    )


def identities(mapped: DataFrame, ids: DataFrame) -> DataFrame:
    """(driver, full_name, team, id): each abbreviation's latest name and team, and the id that its name leads to (null if none does)."""
    order = F.struct("season", "round", "session_type")
    latest = mapped.groupBy("driver").agg(F.max_by("full_name", order).alias("full_name"), F.max_by("team", order).alias("team"))
    return bridge_names(latest.withColumn("full_name", F.coalesce("full_name", F.col("driver"))), ids).drop("rule")
