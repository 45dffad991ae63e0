"""Rule tables, calendars and their constraints; scans of session data other than laps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stintline import rules as own
from stintline.plans import validity
from stintline.sources import landings

SPRINTS = [2, 4, 5, 9, 12, 16]


def calendar(spark, season=2026, n=22):
    rows = [(season, r, f"c{r}", dt.date(season, 3, 1) + dt.timedelta(days=9 * r), "sprint" if r in SPRINTS else "normal", "low", "easy", "high") for r in range(1, n + 1)]
    return spark.createDataFrame(rows, validity.CALENDAR)


def found(df):
    return sorted((r.constraint, r.subject) for r in df.collect())


def test_own_rules_hold_and_come_back(spark):
    table = validity.own_rules(spark)
    assert found(validity.rule_violations(table)) == []
    for season, units in own.ALLOCATIONS.items():
        got = validity.season_rules(table, season)
        assert got["simulation"] == own.SIMULATION and got["pace"] == own.PACE and got["race_points"] == own.RACE_POINTS
        assert got["sprint_points"] == own.SPRINT_POINTS and got["allocations"] == units
    assert validity.season_rules(table, 2031)["allocations"] == own.ALLOCATIONS[2027]


@pytest.mark.parametrize(
    "more, without, wanted",
    [
        (("simulation.n_sims", "", 500.0, 2025, None), "rule <> 'simulation.n_sims'", [("1000 simulations", "simulation.n_sims//2025")]),
        (("points.sprint", "9", 0.5, 2025, None), "true", [("eight sprint places", "2025")]),
        (None, "not (rule = 'points.race' and key = '3')", [("points without gaps", f"points.race/{p}/2025") for p in (10, 4, 5, 6, 7, 8, 9)]),
        (("points.fastest_lap", "", 1.0, 2025, None), "rule <> 'points.fastest_lap'", [("no point for the fastest lap", "points.fastest_lap//2025")]),
        (("allocation", "ICE", 4.0, 2026, 2030), "true", [("overlap", "allocation/ICE/2026"), ("overlap", "allocation/ICE/2027")]),
        (("allocation", "ICE", None, 2020, 2019), "true", [("complete", "allocation/ICE/2020"), *[("every component", f"{c}/2020") for c in sorted(own.COMPONENTS) if c != "ICE"]]),
        (None, "not (rule = 'allocation' and key = 'GB' and first_season = 2027)", [("every component", "GB/2027")]),
        (("simulation.noise", "", -1.0, 2025, None), "rule <> 'simulation.noise'", [("not negative", "simulation.noise//2025")]),
    ],
)
def test_broken_rules(spark, more, without, wanted):
    table = validity.own_rules(spark).where(without)
    if more:
        table = table.unionByName(spark.createDataFrame([more], validity.RULES))
    assert found(validity.rule_violations(table)) == sorted(wanted)
    with pytest.raises(ValueError, match=wanted[0][0]):
        validity.season_rules(table, 2026)


def test_landed_rules(spark, tmp_path):
    validity.own_rules(spark).coalesce(1).write.json(str(tmp_path / "rules"))
    (tmp_path / "rules" / "more.json").write_text('{"rule": "pace.min_lap_s", "value": "many", "first_season": 2025}\n')
    assert ("complete", "pace.min_lap_s/2025") in found(validity.rule_violations(validity.landed_rules(spark, str(tmp_path / "rules"))))


def test_calendars(spark):
    both = calendar(spark).unionByName(calendar(spark, 2027, 21))
    assert found(validity.calendar_violations(calendar(spark), 22, SPRINTS)) == []
    assert found(validity.calendar_violations(both, 22, SPRINTS)) == [("number of rounds", "2027")]
    bad = calendar(spark).withColumn("round", F.when(F.col("round") == 7, 6).otherwise(F.col("round"))).withColumn("weekend_format", F.when(F.col("round") == 4, "festival").otherwise(F.col("weekend_format")))
    bad = bad.withColumn("circuit_id", F.when(F.col("round") == 20, "c1").otherwise(F.col("circuit_id")))
    got = found(validity.calendar_violations(bad, 22, SPRINTS))
    assert got == sorted([("rounds without gaps", "2026/6"), ("circuits once", "2026/c1"), ("weekend_format", "2026/4"), ("sprint rounds", "2026/4"), ("number of rounds", "2026")])
    late = calendar(spark).withColumn("date", F.when(F.col("round") == 9, F.lit("2026-01-01").cast("date")).otherwise(F.col("date")))
    assert found(validity.calendar_violations(late)) == [("dates in order", "2026/9")]
    assert found(validity.calendar_violations(calendar(spark).limit(0), 22, SPRINTS)) == []


def test_weather_messages_and_telemetry(spark, tmp_path):
    """Absent columns are null, NaN too."""
    time = dt.datetime(2026, 3, 8, 13)
    spark.createDataFrame([(2026, 1, "R", time, 21.5, float("nan"), True)], "season int, round int, session_type string, Time timestamp, AirTemp double, WindSpeed double, Rainfall boolean").write.parquet(str(tmp_path / "w"))
    row = landings.weather(spark, str(tmp_path / "w")).first()
    assert (row.time, row.air_temp, row.wind_speed, row.rainfall, row.pressure, row.session_type) == (time, 21.5, None, True, None, "R")
    spark.createDataFrame([(2026, 1, "R", time, "Flag", "YELLOW", "44", 3.0)], "season int, round int, session_type string, Time timestamp, Category string, Flag string, RacingNumber string, Lap double").write.parquet(str(tmp_path / "m"))
    row = landings.messages(spark, str(tmp_path / "m")).first()
    assert (row.category, row.flag, row.car_number, row.lap, row.message) == ("Flag", "YELLOW", "44", 3, None)
    spark.createDataFrame([(2026, 1, "R", "44", time, 301.0, 8)], "season int, round int, session_type string, DriverNumber string, Date timestamp, Speed double, nGear int").write.parquet(str(tmp_path / "t"))
    row = landings.telemetry(spark, str(tmp_path / "t")).first()
    assert (row.car_number, row.time, row.speed, row.gear, row.rpm) == ("44", time, 301.0, 8, None)
