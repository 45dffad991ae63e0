"""Two landed rounds through every step of the command line; the known winner is found and scored."""

import json

import pytest
from pyspark.sql import functions as F

from stintline import cli
from stintline.sources.artifacts import FrozenError, Snapshot

DRIVERS = [("ALF", "Ann Alfa", "ann_alfa", "Red"), ("BRA", "Bob Bravo", "bravo", "Red"), ("CHA", "Cid Charlie", "charlie", "Blue"), ("DEL", "Dan Delta", "delta", "Blue")]
DAYS = {1: ("2026-03-06", "2026-03-08"), 2: ("2026-03-20", "2026-03-22"), 3: ("2026-04-03", "2026-04-05")}


def land(folder, name, document):
    (folder / "landing" / name).mkdir(parents=True, exist_ok=True)
    (folder / "landing" / name / f"{len(list((folder / 'landing' / name).iterdir()))}.json").write_text(json.dumps({"MRData": document}))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("season")
    races = [
        {"season": "2026", "round": str(r), "raceName": f"Race {r}", "date": race, "Circuit": {"circuitId": f"c{r}", "circuitName": f"C{r}"}, "FirstPractice": {"date": fp1}, **({"Sprint": {"date": race}} if r == 2 else {})}
        for r, (fp1, race) in DAYS.items()
    ]
    land(root, "schedule", {"RaceTable": {"Races": races}})
    who = lambda i: {"Driver": {"driverId": DRIVERS[i][2], "code": DRIVERS[i][0]}, "Constructor": {"constructorId": DRIVERS[i][3].lower(), "name": DRIVERS[i][3]}}
    for r in (1, 2):
        entries = [{**who(i), "position": str(i + 1), "positionText": str(i + 1), "grid": str(i + 1), "status": "Finished", "points": str(25 - 7 * i), "laps": "50"} for i in range(4)]
        land(root, "results", {"RaceTable": {"Races": [{"season": "2026", "round": str(r), "date": DAYS[r][1], "Results": entries}]}})
        table = [{**who(i), "position": str(i + 1), "points": str(r * (25 - 7 * i)), "wins": str(r * (i == 0))} for i in range(4)]
        land(root, "drivers", {"StandingsTable": {"StandingsLists": [{"season": "2026", "round": str(r), "DriverStandings": table}]}})
        teams = [{"position": str(k + 1), "points": str(100 - 50 * k), "wins": "0", "Constructor": {"constructorId": t, "name": t}} for k, t in enumerate(("red", "blue"))]
        land(root, "constructors", {"StandingsTable": {"StandingsLists": [{"season": "2026", "round": str(r), "ConstructorStandings": teams}]}})
    laps, results = [], []
    for r in DAYS:
        for s in ("FP1", "FP2", "Q", "S", "R"):
            if r == 3 and s not in ("FP1", "FP2"):
                continue
            for i, (code, name, _, team) in enumerate(DRIVERS):
                stranger = (r, s, i) == (3, "FP1", 1)  # a newcomer in a regular driver's car
                results.append((2026, r, s, f"0{i + 1}", "NEW" if stranger else code, "New Comer" if stranger else name, team, float(i + 1), 80.0 + i if s == "Q" else None))
                for lap in range(1, 9):
                    time = (90.0 if s != "Q" else 80.0) + 0.6 * i + 0.01 * lap + 0.02 * r
                    laps.append((code, str(i + 1), team, lap, int(time * 1e9), 1, "SOFT", lap, "1", True, 2026, r, s, None, None))
    for i, (code, _, _, team) in enumerate(DRIVERS):
        for lap in range(1, 9):
            laps.append((code, str(i + 1), team, lap, int((91 + 0.6 * i) * 1e9), 1, "SOFT", lap, "1", True, 2026, 0, "T", 1, 1))
    schema = "Driver string, DriverNumber string, Team string, LapNumber int, LapTime long, Stint int, Compound string, TyreLife int, TrackStatus string, IsAccurate boolean, season int, round int, session_type string, test_number int, day int"
    spark.createDataFrame(laps, schema).write.parquet(f"{root}/landing/laps")
    spark.createDataFrame(results, "season int, round int, session_type string, DriverNumber string, Abbreviation string, FullName string, TeamName string, Position double, Q3 double").write.parquet(f"{root}/landing/sessions")
    return root


def test_every_step(spark, root, capsys):
    run = lambda *args: cli.main(["--root", str(root), "--season", "2026", *args])
    run("session-map")
    mapped = spark.read.parquet(f"{root}/session_map")
    assert [r.driver for r in mapped.where("not is_regular").collect()] == ["NEW"] and {r.car_number for r in mapped.collect()} == {"1", "2", "3", "4"}
    run("features")
    features = spark.read.parquet(f"{root}/features")
    assert features.count() == 12 and {"gap_to_teammate_race", "long_run_suspect"} <= set(features.columns)
    assert all(r.gap_to_teammate_quali == pytest.approx(-0.6 if r.driver in ("ALF", "CHA") else 0.6) for r in features.where("round < 3").collect())
    assert spark.read.parquet(f"{root}/testing").count() == 4
    stored = spark.read.parquet(f"{root}/testing").inputFiles()
    run("features", "--round", "3")
    assert spark.read.parquet(f"{root}/testing").inputFiles() == stored and spark.read.parquet(f"{root}/features").count() == 12  # stored testing stays
    with pytest.raises(ValueError, match="1000"):
        run("freeze", "--n-sims", "999")
    run("freeze", "--n-sims", "1000")
    assert "round 3: predicted" in capsys.readouterr().out
    assert {"driver_session_map", "drivers_standings", "constructors_standings", "pace_features", "race_results"} == set(Snapshot(spark, str(root), 2026, 3).frames)
    run("post-q", "--round", "2", "--n-sims", "1000")
    run("post-sprint", "--round", "2", "--n-sims", "1000")
    run("fit", "--as-of-round", "2")
    run("championship", "--as-of-round", "2", "--n-sims", "2000")
    summary = {r.entity_id: r for r in spark.read.parquet(f"{root}/championship/2026/as_of_r02/summary").collect()}
    assert summary["ann_alfa"].title_prob > 0.9 and set(summary) == {"ann_alfa", "bravo", "charlie", "delta", "red", "blue"}
    seasons = spark.read.parquet(f"{root}/championship/2026/as_of_r02/seasons")
    added = {r.driver: r.p for r in seasons.groupBy("driver").agg(F.avg("sim_points").alias("p")).collect()}
    assert added["ann_alfa"] > added["charlie"] > added["delta"] and added["bravo"] > added["delta"]  # the faster team counts
    run("evaluate")
    scored = spark.read.parquet(f"{root}/reports/2026/accuracy").where("round = 2").first()
    assert (scored.winner, scored.predicted_winner, scored.top1_hit) == ("ann_alfa", "ann_alfa", True)
    assert spark.read.parquet(f"{root}/reports/2026/per_round").where("round = 2").first().bs_win < 0.1875
    run("export", "--as-of", "2026-03-25")
    shown = json.loads((root / "export" / "predictions_02.json").read_text())
    assert set(shown["cutoffs"]) == {"pre-fp1", "post-q", "post-sprint"}
    for forecast in shown["cutoffs"].values():
        assert sum(d["win_prob"] for d in forecast["drivers"]) == pytest.approx(1, abs=0.001) and forecast["drivers"][0]["driver"] == "ann_alfa"
    manifest = json.loads((root / "export" / "manifest.json").read_text())
    assert manifest["default_round"] == 2 and manifest["default_cutoffs"]["2"] == "post-q" and manifest["has_championship"] and manifest["has_evaluation"]
    titles = json.loads((root / "export" / "championship_2026.json").read_text())
    assert list(titles) == ["as_of_round", "driver_title_probs", "constructor_title_probs", "driver_expected_points"] and titles["as_of_round"] == 2
    best = titles["driver_title_probs"][0]
    assert (best["entity_id"], best["display_name"], best["team"]) == ("ann_alfa", "Alfa", "red") and titles["constructor_title_probs"][0]["entity_id"] == "red"
    assert [r["value"] for r in titles["driver_expected_points"]] == sorted((r["value"] for r in titles["driver_expected_points"]), reverse=True)
    assert json.loads((root / "export" / "schedule.json").read_text())["n_rounds"] == 3
    stored = Snapshot(spark, str(root), 2026, 3).metadata["facts"]["pace_features"]
    assert stored["rows"] == 8 and stored["last"] < "2026-03-30"


def test_only_rounds_to_come_are_rebuilt(spark, root):
    with pytest.raises(FrozenError):
        Snapshot(spark, str(root), 2026, 2).rebuild("2026-03-25")
    assert not Snapshot(spark, str(root), 2026, 3).rebuild("2026-03-25").exists
    with pytest.raises(TypeError):
        Snapshot(spark, str(root), 2026, 2).rebuild()
    before = Snapshot(spark, str(root), 2026, 2).metadata["created_at"]
    cli.main(["--root", str(root), "--season", "2026", "freeze", "--rebuild", "2026-03-25", "--no-predict"])  # over the season: past rounds are skipped
    assert Snapshot(spark, str(root), 2026, 2).metadata["created_at"] == before and Snapshot(spark, str(root), 2026, 3).is_frozen
