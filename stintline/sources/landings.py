"""Raw landings to typed relations: results API documents (JSON) and timing tables (Parquet).

Fetching is not a query: documents are landed in a folder first (one a request), and read here with
explicit schemas, all seasons and rounds in one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import fill_columns, null_nan
from stintline.rules import PACE_SESSION

# Names of a weekend's sessions in the schedule document.
SESSION_KEYS = ["FirstPractice", "SecondPractice", "ThirdPractice", "SprintQualifying", "Sprint", "Qualifying"]
_DAY = "struct<date:string,time:string>"
_RACE = "season:string,round:string,raceName:string,date:string,Circuit:struct<circuitId:string,circuitName:string>," + ",".join(f"{k}:{_DAY}" for k in SESSION_KEYS)
_DRIVER, _TEAM = "Driver:struct<driverId:string,code:string>", "Constructor:struct<constructorId:string,name:string>"
_RESULT = f"position:string,positionText:string,grid:string,status:string,points:string,laps:string,{_DRIVER},{_TEAM}"
_STANDING = f"position:string,points:string,wins:string,{_DRIVER},{_TEAM}"
SCHEMAS = {
    "schedule": f"MRData struct<RaceTable:struct<Races:array<struct<{_RACE}>>>>",
    "results": f"MRData struct<RaceTable:struct<Races:array<struct<season:string,round:string,date:string,Results:array<struct<{_RESULT}>>>>>>",
    "drivers": f"MRData struct<StandingsTable:struct<StandingsLists:array<struct<season:string,round:string,DriverStandings:array<struct<{_STANDING}>>>>>>",
    "constructors": f"MRData struct<StandingsTable:struct<StandingsLists:array<struct<season:string,round:string,ConstructorStandings:array<struct<{_STANDING}>>>>>>",
}
LAP_TYPES = {
    "Driver": "string", "DriverNumber": "string", "Team": "string", "LapNumber": "int", "LapTime": "bigint", "Stint": "int", "Sector1Time": "bigint", "Sector2Time": "bigint",
    "Sector3Time": "bigint", "SpeedI1": "double", "SpeedI2": "double", "SpeedFL": "double", "SpeedST": "double", "Compound": "string", "TyreLife": "int", "PitInTime": "bigint",
    "PitOutTime": "bigint", "TrackStatus": "string", "IsAccurate": "boolean", "Position": "int", "season": "int", "round": "int", "session_type": "string",
    "test_number": "int", "day": "int",
}
RESULT_TYPES = {
    "season": "int", "round": "int", "session_type": "string", "DriverNumber": "string", "Abbreviation": "string", "FullName": "string", "TeamName": "string",
    "Position": "double", "GridPosition": "double", "Status": "string", "Points": "double", "Q1": "double", "Q2": "double", "Q3": "double",
}
_SESSION = {"season": "int", "round": "int", "session_type": "string"}
WEATHER_TYPES = _SESSION | {"Time": "timestamp", "AirTemp": "double", "Humidity": "double", "Pressure": "double", "Rainfall": "boolean", "TrackTemp": "double", "WindDirection": "int", "WindSpeed": "double"}
MESSAGE_TYPES = _SESSION | {"Time": "timestamp", "Category": "string", "Message": "string", "Status": "string", "Flag": "string", "Scope": "string", "Sector": "double", "RacingNumber": "string", "Lap": "double"}
TELEMETRY_TYPES = _SESSION | {"DriverNumber": "string", "Date": "timestamp", "Speed": "double", "RPM": "double", "nGear": "int", "Throttle": "double", "Brake": "boolean", "DRS": "int", "X": "double", "Y": "double", "Z": "double"}
EVENT_TYPES = {"season": "int", "RoundNumber": "int", "EventName": "string", "EventFormat": "string", "EventDate": "date", "Country": "string", "Location": "string"}


def documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).json(path, multiLine=True)


def schedule(spark: SparkSession, path: str) -> DataFrame:
    """(season, round, race_name, circuit_id, circuit_name, date, has_sprint, session_dates, first_practice)."""
    r = documents(spark, path, "schedule").select(F.explode("MRData.RaceTable.Races").alias("r"))
    days = F.map_from_entries(
        F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"r.{k}.date").try_cast("date").alias("value")) for k in SESSION_KEYS]), lambda x: x["value"].isNotNull())
    )
    return r.select(
        F.col("r.season").try_cast("int").alias("season"),
        F.col("r.round").try_cast("int").alias("round"),
        F.col("r.raceName").alias("race_name"),
        F.col("r.Circuit.circuitId").alias("circuit_id"),
        F.col("r.Circuit.circuitName").alias("circuit_name"),
        F.col("r.date").try_cast("date").alias("date"),
        F.col("r.Sprint").isNotNull().alias("has_sprint"),
        days.alias("session_dates"),
    ).withColumn("first_practice", F.element_at("session_dates", "FirstPractice"))


def race_results(spark: SparkSession, path: str) -> DataFrame:
    """One row a classified entry; a position that is no number is null."""
    races = documents(spark, path, "results").select(F.explode("MRData.RaceTable.Races").alias("r"))
    rows = races.select(F.col("r.season").alias("season"), F.col("r.round").alias("round"), F.col("r.date").alias("date"), F.explode("r.Results").alias("x"))
    position = F.when(F.col("x.positionText").rlike(r"^[0-9]+$"), F.col("x.positionText").try_cast("int"))
    return rows.select(
        F.col("season").try_cast("int").alias("season"),
        F.col("round").try_cast("int").alias("round"),
        F.col("x.Driver.driverId").alias("driver"),
        F.col("x.Constructor.constructorId").alias("team"),
        F.col("x.grid").try_cast("int").alias("grid"),
        position.alias("position"),
        F.col("x.positionText").alias("position_text"),
        F.col("x.status").alias("status"),
        F.col("x.points").try_cast("double").alias("points"),
        F.col("x.laps").try_cast("int").alias("laps_completed"),
        F.col("date").try_cast("date").alias("date"),
    )


def standings(spark: SparkSession, path: str, kind: str = "drivers") -> DataFrame:
    """Standings after each round: of drivers (position, driver, code, points, wins) or of constructors (position, team, name, points, wins)."""
    inner = "DriverStandings" if kind == "drivers" else "ConstructorStandings"
    lists = documents(spark, path, kind).select(F.explode("MRData.StandingsTable.StandingsLists").alias("l"))
    rows = lists.select(F.col("l.season").alias("season"), F.col("l.round").alias("round"), F.explode(f"l.{inner}").alias("x"))
    who = (
        [F.col("x.Driver.driverId").alias("driver"), F.coalesce("x.Driver.code", F.lit("")).alias("code")]
        if kind == "drivers"
        else [F.col("x.Constructor.constructorId").alias("team"), F.col("x.Constructor.name").alias("name")]
    )
    number = lambda c, t: F.col(f"x.{c}").try_cast(t).alias(c)
    return rows.select(F.col("season").try_cast("int").alias("season"), F.col("round").try_cast("int").alias("round"), number("position", "int"), *who, number("points", "double"), number("wins", "int"))


def timing_laps(spark: SparkSession, path: str, accurate_only: bool = True) -> DataFrame:
    """Laps of the timing tables with ``lap_s`` in seconds; absent columns are null. Filters on season, round and session prune partitions."""
    rows = fill_columns(null_nan(spark.read.parquet(path)), LAP_TYPES)
    rows = rows.where("IsAccurate") if accurate_only else rows
    return rows.withColumn("lap_s", F.col("LapTime") / F.lit(1e9))


def as_pace_laps(laps: DataFrame) -> DataFrame:
    """Timing laps under the names that the pace operators use."""
    return laps.select(
        "season", "round", "session_type", F.col("Driver").alias("driver"), F.col("Team").alias("team"), F.col("Stint").cast("string").alias("stint"), F.col("LapNumber").alias("lap_number"),
        "lap_s", F.col("TyreLife").alias("tyre_life"), F.col("TrackStatus").alias("track_status"), F.col("IsAccurate").alias("is_accurate"),
    )


def session_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all sessions of the timing source; absent columns are null, NaN too."""
    return fill_columns(null_nan(spark.read.parquet(path)), RESULT_TYPES)


def weather(spark: SparkSession, path: str) -> DataFrame:
    """(season, round, session_type, time, air_temp, humidity, pressure, rainfall, track_temp, wind_direction, wind_speed): a session's samples, about one a minute."""
    rows = fill_columns(null_nan(spark.read.parquet(path)), WEATHER_TYPES)
    return rows.select(*_SESSION, F.col("Time").alias("time"), *[F.col(c).alias(_snake(c)) for c in list(WEATHER_TYPES)[4:]])


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(season, round, session_type, time, category, message, status, flag, scope, sector, car_number, lap): what race control said."""
    rows = fill_columns(null_nan(spark.read.parquet(path)), MESSAGE_TYPES).withColumnsRenamed({"RacingNumber": "car_number"})
    named = [F.col(c).cast("int").alias(_snake(c)) if c in ("Sector", "Lap") else F.col(c).alias(_snake(c)) for c in ("Category", "Message", "Status", "Flag", "Scope", "Sector", "car_number", "Lap")]
    return rows.select(*_SESSION, F.col("Time").alias("time"), *named)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """(season, round, session_type, car_number, time, speed, rpm, gear, throttle, brake, drs, x, y, z): samples of each car, several a second."""
    rows = fill_columns(null_nan(spark.read.parquet(path)), TELEMETRY_TYPES)
    return rows.select(*_SESSION, F.col("DriverNumber").alias("car_number"), F.col("Date").alias("time"), *[F.col(c).alias(c.lower().replace("ngear", "gear")) for c in list(TELEMETRY_TYPES)[5:]])


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(name))


def session_drivers(results: DataFrame) -> DataFrame:
    """(season, round, session_type, car_number, driver, full_name, team): who took part; rows without a number or an abbreviation are left out."""
    return results.where(F.col("DriverNumber").isNotNull() & F.col("Abbreviation").isNotNull()).select(
        "season", "round", "session_type", F.col("DriverNumber").alias("car_number"), F.col("Abbreviation").alias("driver"), F.col("FullName").alias("full_name"), F.col("TeamName").alias("team")
    )


def event_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(season, round, event_name, event_format, date, country, location) of the timing source; testing (round 0) is left out."""
    rows = fill_columns(spark.read.parquet(path), EVENT_TYPES).where(F.col("RoundNumber") > 0)
    return rows.withColumnsRenamed({"RoundNumber": "round", "EventName": "event_name", "EventFormat": "event_format", "EventDate": "date", "Country": "country", "Location": "location"})


def testing_laps(laps: DataFrame) -> DataFrame:
    """Accurate laps of landed testing, with test number and day beside the names that the pace operators use."""
    return laps.where("test_number is not null and IsAccurate").select(
        "season", "test_number", "day", F.col("Driver").alias("driver"), F.col("Team").alias("team"), F.col("Stint").cast("string").alias("stint"), F.col("LapNumber").alias("lap_number"), "lap_s"
    )


def pace_session(laps: DataFrame, formats: DataFrame) -> DataFrame:
    """Laps of the session that gives race pace; ``formats`` has (season, round, event_format)."""
    wanted = F.when(F.col("event_format").startswith("sprint"), PACE_SESSION["sprint"]).otherwise(PACE_SESSION["conventional"])
    return laps.join(formats.select("season", "round", wanted.alias("session_type")), ["season", "round", "session_type"], "left_semi")


def qualifying_results(results: DataFrame) -> DataFrame:
    """(season, round, driver, team, quali_pos, best_lap_s): the time of the last part a driver took part in."""
    best = F.coalesce(*[F.when(F.col(q) > 0, F.col(q)) for q in ("Q3", "Q2", "Q1")])
    return results.select("season", "round", F.col("Abbreviation").alias("driver"), F.col("TeamName").alias("team"), F.col("Position").try_cast("int").alias("quali_pos"), F.bround(best, 4).alias("best_lap_s"))


def testing_days(laps: DataFrame) -> DataFrame:
    """(season, test_number, day) of landed testing, each test's days up to the first that is missing."""
    days = laps.select("season", "test_number", "day").distinct()
    nth = F.row_number().over(Window.partitionBy("season", "test_number").orderBy("day"))
    return days.withColumn("nth", nth).where("nth = day").drop("nth")
