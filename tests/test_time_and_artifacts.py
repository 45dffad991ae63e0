"""Cutoffs, frozen artifacts, replay, landings, records, streams."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stintline import cli
from stintline.operators import point_in_time as pit
from stintline.operators import records
from stintline.plans import export
from stintline.plans.model import Model, StrengthModel, freeze_round, replay_statuses, walk_forward
from stintline.sources import landings
from stintline.sources.artifacts import FrozenError, NotFrozenError, Predictions, Snapshot, snapshot_listing
from stintline.streaming import rounds as streams

FP1 = date(2026, 3, 6)


@pytest.fixture
def schedule(spark):
    rows = [(2026, r, FP1 + timedelta(14 * (r - 1)) if r != 3 else None, FP1 + timedelta(14 * (r - 1) + 2), r % 2 == 0) for r in range(1, 6)]
    return spark.createDataFrame(rows, "season int, round int, first_practice date, date date, has_sprint boolean")


def dated(spark, *days):
    return spark.createDataFrame([(str(d) if d else None, i) for i, d in enumerate(days)], "date string, value int")


def test_guard(spark, schedule):
    guard = pit.Guard(schedule)
    assert guard.cutoff(3) == FP1 + timedelta(28)
    pit.check_frame(dated(spark, "2026-03-05", "2026-03-05T23:59:59", None, "garbage"), guard.cutoff(1))
    pit.check_frame(dated(spark), guard.cutoff(1))
    with pytest.raises(pit.LeakageError, match="1 rows"):
        pit.check_frame(dated(spark, "2026-03-05", "2026-03-06"), guard.cutoff(1))
    with pytest.raises(ValueError, match="no column"):
        pit.check_frame(dated(spark).drop("date"), guard.cutoff(1))
    with pytest.raises(ValueError, match="not in the schedule"):
        guard.cutoff(9)
    guard.check_round(1, 2)
    with pytest.raises(pit.LeakageError):
        guard.check_round(2, 2)
    with guard.for_round(2) as check:
        assert dated(spark, "2026-03-10").transform(check).count() == 1
    assert pit.last_completed(schedule, "2026-03-08").first()[0] == 0
    assert pit.last_completed(schedule, "2026-03-08", inclusive=True).first()[0] == 1 and pit.next_round(schedule, "2026-03-08").first()[0] == 2


def pace_rows(spark, schedule, last=4):
    rows = [(2026, r, "FP2", f"d{i}", f"t{i // 2}", 90 + 0.2 * i + 0.05 * r, 15, 85 + 0.15 * i, 84 + 0.15 * i) for r in range(1, last + 1) for i in range(6)]
    return spark.createDataFrame(rows, "season int, round int, session_type string, driver string, team string, long_run_pace_s double, long_run_n long, fp_best_lap_s double, quali_pace_s double")


def test_snapshot_freezes(spark, schedule, tmp_path):
    snap = Snapshot(spark, str(tmp_path), 2026, 2)
    with pytest.raises(NotFrozenError):
        snap.freeze()
    with pytest.raises(ValueError):
        snap.write_frame("x", dated(spark, "2026-03-01"))
    snap.start(FP1).write_frame("x", dated(spark, "2026-03-01"))
    with pytest.raises(pit.LeakageError):
        snap.write_frame("y", dated(spark, FP1))
    snap.write_frame("y", dated(spark, FP1), check=False).freeze()
    assert snap.freeze().is_frozen and snap.frames == ["x", "y"] and snap.frame("x").count() == 1
    with pytest.raises(FrozenError):
        snap.write_frame("z", dated(spark))
    with pytest.raises(FileNotFoundError, match="x, y"):
        snap.frame("nope")
    assert snapshot_listing(spark, str(tmp_path), 2026, frozen=True) == [2] and not snap.rebuild("2026-01-01").exists


class Counting:
    version = "counting"

    def __init__(self):
        self.calls = 0

    def predict(self, snapshot, round_, guard):
        self.calls += 1
        return snapshot.spark.createDataFrame([("a", 1, 1.0)], "driver string, finish_pos int, probability double")


def test_replay_predicts_once(spark, schedule, tmp_path):
    guard, model = pit.Guard(schedule), Counting()
    assert isinstance(model, Model)
    root = str(tmp_path)
    status = lambda: replay_statuses(spark, root, 2026, [2]).first()["status"]
    walk = lambda *rounds, **how: walk_forward(spark, root, 2026, model, guard, rounds, **how)
    assert status() == "snapshot_missing"
    with pytest.raises(NotFrozenError):
        walk(2, errors="raise")
    with pytest.raises(TypeError):
        walk_forward(spark, root, 2026, object(), guard, [2])
    results = pace_rows(spark, schedule).select("season", "round", "driver")
    freeze_round(Snapshot(spark, root, 2026, 2), guard, schedule, pace_rows(spark, schedule), results)
    assert status() == "prediction_missing"
    assert walk(2)[2].count() == 1 and walk(2)[2].count() == 1 and model.calls == 1
    walk(2, force=True)
    out = walk(2, 1)
    assert list(out) == [1, 2] and model.calls == 2 and status() == "prediction_frozen" and isinstance(out[1], NotFrozenError)
    stored = Predictions(spark, str(tmp_path), 2026)
    assert stored.listing() == [(2, "pre-fp1")] and stored.load(3) is None and stored.load(2)[1]["model_version"] == "counting"
    with pytest.raises(FrozenError):
        stored.save(dated(spark).withColumn("driver", F.lit("a")), 2, FP1)


def test_strength_model(spark, schedule, tmp_path):
    guard = pit.Guard(schedule)
    snap = freeze_round(Snapshot(spark, str(tmp_path), 2026, 4), guard, schedule, pace_rows(spark, schedule), pace_rows(spark, schedule).select("season", "round", "driver"))
    assert snap.frame("pace_features").agg(F.max("round")).first()[0] == 3
    grid = StrengthModel(200, 1).predict(snap, 4, guard)
    best = grid.where("finish_pos = 1").orderBy(F.desc("probability")).first().driver
    assert grid.count() == 36 and best == "d0"


RACES = {"MRData": {"RaceTable": {"Races": [
    {"season": "2026", "round": "1", "raceName": "One", "date": "2026-03-08", "Circuit": {"circuitId": "c1", "circuitName": "C 1"}, "FirstPractice": {"date": "2026-03-06"}, "Sprint": {"date": "2026-03-07"}},
    {"season": "2026", "round": "2", "raceName": "Two", "date": "2026-03-22", "Circuit": {"circuitId": "c2", "circuitName": "C 2"}},
]}}}
ENTRY = {"grid": "1", "status": "Finished", "points": "25", "laps": "58", "Driver": {"driverId": "max", "code": "MAX"}, "Constructor": {"constructorId": "t", "name": "T"}}
RESULTS = {"MRData": {"RaceTable": {"Races": [{"season": "2026", "round": "1", "date": "2026-03-08", "Results": [{**ENTRY, "position": "1", "positionText": "1"}, {**ENTRY, "position": "2", "positionText": "R"}]}]}}}
TABLE = {"MRData": {"StandingsTable": {"StandingsLists": [{"season": "2026", "round": "1", "DriverStandings": [{"position": "1", "points": "25", "wins": "1", "Driver": {"driverId": "max"}}]}]}}}


def land(folder, name, document):
    (folder / name).mkdir(parents=True)
    (folder / name / "1.json").write_text(json.dumps(document, indent=1))
    return str(folder / name)


def test_landings(spark, tmp_path, capsys):
    rows = landings.schedule(spark, land(tmp_path / "landing", "schedule", RACES)).orderBy("round").collect()
    assert [(r.has_sprint, r.circuit_id, str(r.first_practice)) for r in rows] == [(True, "c1", "2026-03-06"), (False, "c2", "None")]
    got = landings.race_results(spark, land(tmp_path / "landing", "results", RESULTS)).collect()
    assert [r.position for r in got] == [1, None] and got[0].points == 25.0 and got[0].team == "t"
    one = landings.standings(spark, land(tmp_path / "landing", "drivers", TABLE)).first()
    assert (one.driver, one.code, one.points, one.wins) == ("max", "", 25.0, 1)
    cli.main(["--root", str(tmp_path), "--season", "2026", "last-round", "--as-of", "2026-03-20"])
    assert capsys.readouterr().out.strip().endswith("1")


def test_timing(spark, tmp_path):
    laps = spark.createDataFrame([("A", "T", 1, 90_000_000_000, 1, True, 2026, 1, "FP1"), ("A", "T", 2, None, 1, False, 2026, 1, "FP2")], "Driver string, Team string, LapNumber int, LapTime long, Stint int, IsAccurate boolean, season int, round int, session_type string")
    laps.write.parquet(f"{tmp_path}/laps")
    read = landings.timing_laps(spark, f"{tmp_path}/laps")
    assert read.count() == 1 and read.first().lap_s == 90.0 and read.first().TyreLife is None
    formats = spark.createDataFrame([(2026, 1, "sprint_qualifying")], "season int, round int, event_format string")
    assert landings.pace_session(landings.as_pace_laps(landings.timing_laps(spark, f"{tmp_path}/laps", False)), formats).first().session_type == "FP1"
    quali = spark.createDataFrame([(2026, 1, "A", "T", "1", 80.12345, 79.0, None), (2026, 1, "B", "T", "x", 81.0, 0.0, 0.0)], "season int, round int, Abbreviation string, TeamName string, Position string, Q1 double, Q2 double, Q3 double")
    assert [(r.best_lap_s, r.quali_pos) for r in landings.qualifying_results(quali).orderBy("driver").collect()] == [(79.0, 1), (81.0, None)]
    days = spark.createDataFrame([(2026, 1, 1), (2026, 1, 2), (2026, 2, 1), (2026, 2, 3)], "season int, test_number int, day int")
    assert landings.testing_days(days).count() == 3


def test_records(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "k string, o int, v string").withColumn("o", F.col("o") + (F.col("v") == "y").cast("int"))
    new = spark.createDataFrame([("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in records.upsert(old, new, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}
    assert records.replace_by(old, new.withColumn("k", F.lit("a")), ["k"]).count() == 1
    assert records.same_keys(old, old.limit(1), ["k"]) and not records.same_keys(old, new, ["k"])
    known = spark.createDataFrame([("a", 1, "p", None), ("a", 2, None, "q")], "k string, o int, x string, y string")
    assert records.last_known(known, ["k"], ["o"], ["x", "y"]).first()[1:] == ("p", "q")
    people = spark.createDataFrame([("Max Verstappen",), ("Nico Hülkenberg",), ("Kevin Du Pont",), ("Guanyu Zhou",), ("No One",)], "full_name string")
    ids = spark.createDataFrame([("max_verstappen",), ("hulkenberg",), ("kevin_du_pont",), ("du_pont",), ("zhou",)], "id string")
    got = {r.full_name: (r.id, r.rule) for r in records.bridge_names(people, ids).collect()}
    assert got == {"Max Verstappen": ("max_verstappen", 2), "Nico Hülkenberg": ("hulkenberg", 1), "Kevin Du Pont": ("kevin_du_pont", 3), "Guanyu Zhou": ("zhou", 1), "No One": (None, None)}
    session = spark.createDataFrame([("63", "NEW"), ("1", "ver"), ("99", "ROO")], "car string, driver string")
    reference = spark.createDataFrame([("63", "RUS"), ("1", "VER")], "car string, driver string")
    assert {r.car: r.is_regular for r in records.regular_drivers(session, reference).collect()} == {"63": False, "1": True, "99": True}
    assert records.absent_regulars(session, reference).count() == 2


def test_documents(spark):
    rows = spark.createDataFrame([(1, "pre-fp1", "2026-03-06", "a", 0.2), (1, "pre-fp1", "2026-03-06", "b", 0.8)], "round int, cutoff string, cutoff_date string, driver string, win_prob double")
    doc = json.loads(export.predictions_document(rows).first().document)
    assert [d["driver"] for d in doc["cutoffs"]["pre-fp1"]["drivers"]] == ["b", "a"] and doc["cutoffs"]["pre-fp1"]["generated_at"] == "2026-03-06"
    drivers = spark.createDataFrame([("a", 0.1, 50.0, "Ann", "t"), ("b", 0.9, 40.0, "Bea", None)], "entity_id string, title_prob double, expected_points double, display_name string, team string")
    titles = json.loads(export.championship_document(drivers, drivers.where("entity_id = 'a'").select("entity_id", "title_prob"), 3).first().document)
    assert titles["driver_title_probs"][0] == {"entity_id": "b", "value": 0.9, "display_name": "Bea"} and titles["driver_expected_points"][0] == {"entity_id": "a", "value": 50.0}
    assert titles["constructor_title_probs"] == [{"entity_id": "a", "value": 0.1}] and titles["as_of_round"] == 3
    meta = spark.createDataFrame([("a", "Ann", "t")], "driver string, display_name string, team string")
    assert {r.driver: (r.display_name, r.team) for r in export.with_meta(rows, meta).collect()} == {"a": ("Ann", "t"), "b": ("b", "unknown")}
    assert export.results_lookup(rows.select("round", "driver"), rows.select((F.col("round") + F.lit(1)).alias("round"), "driver")).count() == 4


def test_streams(spark, tmp_path):
    schema = "season int, round int, driver string, team string, stint string, lap_number int, lap_s double, tyre_life int, track_status string, is_accurate boolean, ts timestamp"
    rows = [(2026, r, "a", "t", "1", i, 90.0 + i / 10, i, "1", True, f"2026-03-06 10:{i:02d}:00") for r in (1, 2) for i in range(1, 8)]
    laps = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    laps.repartition(3).write.parquet(f"{tmp_path}/laps")
    stream = streams.lap_stream(spark, f"{tmp_path}/laps", schema, 1)
    streams.feature_sink(stream, f"{tmp_path}/laps", f"{tmp_path}/features", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/features").orderBy("round").collect()
    assert [(r["round"], r.long_run_n) for r in got] == [(1, 7), (2, 7)]
    query = streams.running_best(stream).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("best").first().laps == 14
    query = streams.windowed_pace(stream).writeStream.format("memory").queryName("win").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("win").count() >= 1


def test_frames_are_checked_by_the_job_that_stores_them(spark, tmp_path):
    """One pass: rows, first and last date come with the write; a leak leaves no frame of that name, and the old one stays."""
    from stintline.sources.artifacts import Folder, write_watched

    folder = Folder(spark, str(tmp_path / "store"))
    facts = write_watched(folder, "a.parquet", dated(spark, "2026-03-01", None, "2026-02-01"), "2026-03-06")
    assert facts == {"rows": 3, "first": "2026-02-01", "last": "2026-03-01"} and folder.names() == ["a.parquet"]
    with pytest.raises(pit.LeakageError, match="2 rows from 2026-03-06 to 2026-03-07"):
        write_watched(folder, "a.parquet", dated(spark, "2026-03-06", "2026-03-07", "2026-03-05"), "2026-03-06")
    assert spark.read.parquet(f"{folder.path}/a.parquet").count() == 3 and folder.names() == ["a.parquet"]
    assert write_watched(folder, "b.parquet", spark.range(0)) == {"rows": 0, "first": None, "last": None}
    with pytest.raises(ValueError, match="no column"):
        write_watched(folder, "c.parquet", spark.range(1), "2026-03-06")


@pytest.mark.parametrize(
    "as_of, known, wanted",
    [
        ("2026-03-04", [], 1),  # four days before the first race, without any forecast
        ("2026-03-03", [], None),
        ("2026-03-09", [], 1),  # the day after
        ("2026-03-10", [1, 2], 1),
        ("2026-03-10", [2, 3], 2),
        ("2026-03-18", [1], 2),
        ("2026-12-31", [1, 2], 2),
    ],
)
def test_default_round(spark, as_of, known, wanted):
    calendar = spark.createDataFrame([(1, "2026-03-08"), (2, "2026-03-22"), (3, "2026-04-05")], "round int, date string").selectExpr("round", "cast(date as date) as date")
    available = spark.createDataFrame([(r,) for r in known], "round int")
    assert export.default_round(available, calendar, as_of).first()["round"] == wanted
