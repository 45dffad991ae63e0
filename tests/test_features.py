"""Pace, gaps, reliability, penalties and strength on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from stintline.functions import scalars
from stintline.operators import gaps, pace, penalties, reliability, strength

LAP = "season int, round int, driver string, team string, stint string, lap_number int, lap_s double, tyre_life int, track_status string, is_accurate boolean"


def laps(spark, times, driver="a", stint="1", status="1", start=1, round_=1, team="t"):
    rows = [(2026, round_, driver, team, stint, start + i, float(t) if t is not None else None, start + i, status, True) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, LAP)


def test_fuel_falls_to_nothing_on_the_last_lap(spark):
    rows = pace.fuel_corrected(laps(spark, [90, 90, 90])).orderBy("lap_number").collect()
    assert [round(r.lap_s - r.corrected_s, 9) for r in rows] == [0.112, 0.056, 0]
    unknown = laps(spark, [90, 90, 90]).withColumn("tyre_life", F.lit(None).cast("int"))
    rows = pace.fuel_corrected(unknown, age="auto").orderBy("lap_number").collect()
    assert [round(r.lap_s - r.corrected_s, 9) for r in rows] == [0.112, 0.056, 0]


@pytest.mark.parametrize("n, kept", [(3, 0), (5, 5), (7, 7)])
def test_long_stints(spark, n, kept):
    assert pace.long_stints(laps(spark, [90] * n)).count() == kept


def test_outliers(spark):
    assert pace.drop_slow_outliers(laps(spark, [90.0] * 8 + [120.0]), value="lap_s").count() == 8
    assert pace.drop_slow_outliers(laps(spark, [90 + i / 10 for i in range(8)]), value="lap_s").count() == 8


def test_long_run_ignores_flags_and_invalid_laps(spark):
    rows = laps(spark, [90] * 6 + [5, None]).union(laps(spark, [99] * 5, stint="2", status="4")).union(laps(spark, [99] * 5, stint="3", status="12"))
    got = pace.long_run_pace(rows).collect()
    assert len(got) == 1 and got[0].long_run_pace_s < 90 and got[0].long_run_n == 6 and got[0].team == "t"


def test_features_join_all_drivers_once(spark):
    practice = laps(spark, [90] * 6).union(laps(spark, [91, 89.8], "b")).union(laps(spark, [89.9], "b", team="other", start=9))
    quali = laps(spark, [85, 84], "b")
    got = {r.driver: r for r in pace.pace_features(practice, quali).collect()}
    assert set(got) == {"a", "b"} and got["b"].long_run_pace_s is None and got["b"].fp_best_lap_s == 89.8
    assert got["b"].team == "t" and got["b"].quali_pace_s == 84 and got["a"].quali_pace_s is None
    assert pace.pace_features(practice.where("false")).count() == 0


def test_trim_needs_three_laps(spark):
    rows = laps(spark, [90, 90, 90, 90, 100])
    got = pace.trimmed_pace(rows, ["driver", "stint"], ["driver", "team"]).collect()
    assert got[0].testing_long_run_s == 90 and got[0].testing_laps_n == 5


def test_sprint_pace(spark):
    got = pace.sprint_pace(laps(spark, [99, 90, 91, 92, 99]).union(laps(spark, [99, 90, 90], "b"))).collect()
    assert [(r.driver, r.sprint_pace_s, r.n) for r in got] == [("a", 91, 3)]


PAIR = "season int, round int, driver string, team string, long_run_pace_s double, quali_pace_s double"


def test_teammate_gaps(spark):
    rows = [(1, 1, "a", "t", 89.0, 80.0), (1, 1, "b", "t", 90.5, None), (1, 1, "c", "u", 1.0, 1.0), (1, 1, "d", None, 1.0, 1.0), (1, 1, "x", "v", 1.0, 5.0), (1, 1, "y", "v", 2.0, 5.5), (1, 1, "z", "v", 9.0, 9.0)]
    got = {r.driver: r for r in gaps.teammate_gaps(spark.createDataFrame(rows, PAIR)).collect()}
    assert got["a"].gap_race == -1.5 and got["b"].gap_race == 1.5 and got["a"].gap_quali is None
    assert got["c"].gap_race is None and set(got) == {"a", "b", "c", "x", "y"} and got["x"].gap_quali == -0.5
    with pytest.raises(ValueError, match="quali_pace_s"):
        gaps.teammate_gaps(spark.createDataFrame(rows, PAIR).drop("quali_pace_s"))


def test_suspects_and_team_names(spark):
    rows = [(1, 1, "a", "t", 90.0, 80.0), (1, 1, "b", "t", 93.5, 81.0), (1, 1, "x", "v", 1.0, 1.0), (1, 1, "y", "v", 2.0, 9.0), (1, 1, "z", "v", 9.0, None)]
    got = {r.driver: (r.long_run_suspect, r.quali_suspect) for r in gaps.flag_suspects(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {"a": (False, False), "b": (True, False), "x": (False, False), "y": (False, True), "z": (False, False)}
    holes = spark.createDataFrame([(1, "a", None), (2, "a", "t"), (3, "a", None), (1, "b", None)], "round int, driver string, team string")
    assert {(r["round"], r.driver): r.team for r in gaps.fill_teams(holes).collect()} == {(1, "a"): "t", (2, "a"): "t", (3, "a"): "t", (1, "b"): None}


def test_status_and_rates(spark):
    said = ["Engine", "GEARBOX", " Power Unit ", "Collision", "Spun off", "Retired", "Disqualified", "Finished", "+1 Lap", "Lapped", "Collision damage", "Engine fire after crash"]
    want = ["mechanical"] * 3 + ["incident"] * 2 + ["other"] * 2 + ["finished"] * 2 + ["other", "incident", "mechanical"]
    rows = spark.createDataFrame([(i, s, "d", f"t{i % 2}") for i, s in enumerate(said)], "i int, status string, driver string, team string")
    assert [r.k for r in rows.select("i", scalars.status_class(F.col("status")).alias("k")).orderBy("i").collect()] == want
    one = reliability.driver_reliability(rows).first()
    assert (one.starts, one.mechanical_dnfs, one.incident_dnfs, one.other_dnfs, one.total_dnfs) == (12, 4, 3, 3, 10)
    assert one.mechanical_dnf_rate == pytest.approx(5.2 / 27)
    engines = spark.createDataFrame([("t0", "e"), ("t1", "e")], "team string, engine string")
    assert reliability.engine_reliability(rows, engines).first().starts == 12
    assert spark.range(1).select(scalars.beta_rate(F.lit(0), F.lit(0), "mechanical").alias("x")).first().x == pytest.approx(0.08)


USE = "driver string, season int, component string, units_used int, units_allowed int, seq int"


def test_penalties(spark):
    rows = [("a", 2026, "ICE", 5, 4, 1), ("b", 2026, "ICE", 6, 4, 1), ("c", 2026, "ICE", 5, 4, 1), ("c", 2026, "TC", 5, 4, 1), ("d", 2026, "ICE", 2, 9, 1), ("d", 2026, "ICE", 1, 4, 2)]
    got = {r.driver: r for r in penalties.driver_penalties(spark.createDataFrame(rows, USE)).collect()}
    assert [(got[k].penalty_positions_total, got[k].starts_from_pit_lane) for k in "abcd"] == [(10, False), (15, False), (20, True), (0, False)]
    assert got["d"].ICE_used == 2 and got["d"].ICE_remaining == 2 and got["d"].GB_used == 0


@pytest.mark.parametrize("k, rate, want", [(5, 0.0, 1), (-1, 1.0, 0), (0, 1.0, math.exp(-1)), (100, 1.0, 1), (3, 2.0, 0.857123)])
def test_poisson(spark, k, rate, want):
    assert spark.range(1).select(scalars.poisson_cdf(F.lit(k), F.lit(rate)).alias("p")).first().p == pytest.approx(want, abs=1e-6)


def test_penalty_risk(spark):
    full = [("full", 2026, c, 0, 4, 1) for c in ("ICE", "TC")] + [("empty", 2026, c, 4, 4, 1) for c in ("ICE", "TC")]
    rows = spark.createDataFrame(full, USE)
    few = {r.driver: r for r in penalties.penalty_risk(rows, 3).collect()}
    many = {r.driver: r for r in penalties.penalty_risk(rows, 10).collect()}
    assert few["full"].penalty_risk_season < 0.2 and many["empty"].penalty_risk_season > 0.5
    assert many["full"].penalty_risk_season > few["full"].penalty_risk_season
    assert all(r.penalty_risk_next_race <= r.penalty_risk_season and r.expected_penalty_pos >= 10 for r in [*few.values(), *many.values()])
    assert penalties.penalty_risk(rows, 0).count() == 0
    with pytest.raises(ValueError):
        penalties.penalty_risk(rows, -1)


def field(spark, rounds=3):
    rows = [(2026, r, d, t, None, 80.0 + r + x) for r in range(1, rounds + 1) for d, t, x in (("a", "t", 0.0), ("b", "t", 0.4), ("c", "u", 0.1), ("d", "u", 0.3), ("e", "v", 0.2), ("f", " ", 0.0))]
    return spark.createDataFrame(rows, PAIR)


def test_driver_strength(spark):
    got = {r.driver: r for r in strength.driver_strengths(field(spark)).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"].mean - got["b"].mean == pytest.approx(0.4, abs=1e-9)
    assert sum(r.mean for r in got.values()) == pytest.approx(0, abs=1e-10)
    assert all(r.n_obs == 3 and r.sd == 0.01 for r in got.values())
    assert {r.sd for r in strength.driver_strengths(field(spark, 1)).collect()} == {2.0}
    assert strength.driver_strengths(field(spark, 1), min_rounds=2).count() == 0


def test_outliers_and_suspects_leave_the_signal(spark):
    slow = field(spark).withColumn("quali_pace_s", F.when((F.col("driver") == "b") & (F.col("round") == 1), 99.0).otherwise(F.col("quali_pace_s")))
    assert {r.driver: r.n_obs for r in strength.driver_strengths(slow).collect()} == {"a": 2, "b": 2, "c": 3, "d": 3}
    flagged = field(spark).withColumn("quali_suspect", F.when(F.col("driver") == "d", F.lit(True)))
    assert {r.driver for r in strength.driver_strengths(flagged).collect()} == {"a", "b"}


def test_teams_and_engines(spark):
    engines = spark.createDataFrame([("t", "e"), ("u", "e")], "team string, engine string")
    teams = {r.team: r for r in strength.team_strengths(field(spark), engine_of=engines).collect()}
    assert set(teams) == {"t", "u", "v"} and teams["v"].engine is None
    given = spark.createDataFrame([("m", 0.5, 0.1, 10, "x"), ("a", 0.3, 0.2, 8, "x"), ("r", 0.2, 0.15, 12, "y"), ("n", 0.0, 1.0, 1, None)], "team string, mean double, sd double, n_obs int, engine string")
    got = {r.engine: r for r in strength.engine_strengths(given).collect()}
    assert set(got) == {"x", "y"} and got["x"].mean == pytest.approx((0.5 * 10 + 0.3 * 8) / 18) and got["y"].sd == 2.0 and got["x"].n_teams == 2


def test_grid_and_total_strength(spark):
    fits = strength.fit_all(field(spark))
    total = strength.total_strength(fits["driver"], fits["team"], strength.latest_team(field(spark)))
    grid = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "driver string, grid int")
    before, after = ({r.driver: r.mean for r in x.collect()} for x in (total, strength.with_grid(total, grid)))
    assert [round(after[k] - before[k], 9) for k in "abcd"] == [0.15, 0.0, -0.15, 0.0]
    assert strength.strength_long(fits["driver"], fits["team"], fits["engine"], 3).count() == 4 + 3


def test_seconds_and_nulls(spark):
    row = spark.sql("select 90500000000L as ns, interval '1:30.5' minute to second as i, '1:30.5' as t, 'x' as bad, double('nan') as nan")
    got = row.select(*[scalars.seconds(F.col(c), k).alias(c) for c, k in (("ns", "ns"), ("i", "interval"), ("t", "text"), ("bad", "text"))]).first()
    assert (got.ns, got.i, got.t, got.bad) == (90.5, 90.5, 90.5, None)
    assert scalars.null_nan(row).first().nan is None


def test_places_without_one_sort(spark):
    from stintline.operators.records import place_by

    rows = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", 0.0)], "driver string, points double")
    assert {r.driver: r.position for r in place_by(rows, "points", ["driver"]).collect()} == {"c": 1, "a": 2, "b": 3, "d": 4}
