"""Strengths as of every round from one plan, the same from a stream in pieces, and what was known at many cutoffs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stintline.operators import asof, gaps, moments, strength
from stintline.sources.artifacts import materialised
from stintline.streaming import strengths

PACE = "season int, round int, driver string, team string, long_run_pace_s double"


def features(seed, rounds=6, drivers=9):
    """Three teams of three, missing and blank teams, missing times, an outlier, a driver who changes team, a lone driver."""
    rng = random.Random(seed)
    rows = []
    for season in (2025, 2026):
        for r in range(1, rounds + 1):
            for k in range(drivers):
                team = ["red", "blue", "green"][(k + (r > 3 and k == 4)) % 3]
                team = rng.choice([team, team, team, None, " "])
                rows.append((season, r, f"d{k}", team, None if rng.random() < 0.1 else round(90 + k / 7 + rng.random() + (30 if rng.random() < 0.05 else 0), 3)))
            rows.append((season, r, "lone", "solo", 91.0))
    return rows


def flat(rows):
    """Rows in order, without floats, and all floats beside them."""
    rows = sorted(rows if isinstance(rows, list) else rows.collect(), key=lambda r: (r.as_of_round, r.entity_type, r.entity_id))
    return [(r.as_of_round, r.entity_type, r.entity_id, r.n_obs) for r in rows], [x for r in rows for x in (r.mean, r.sd)]


def same(a, b):
    (known, floats), (wanted, others) = flat(a), flat(b)
    assert known == wanted and floats == pytest.approx(others, abs=1e-9)


@pytest.mark.parametrize("by_season", [False, True])
def test_one_plan_equals_round_by_round(spark, by_season):
    pace = gaps.fill_teams(spark.createDataFrame(features(1), PACE)).cache()
    engine_of = spark.createDataFrame([("red", "x"), ("blue", "x"), ("green", "y"), ("solo", None)], "team string, engine string")
    wanted = []
    for r in range(1, 7):
        fits = strength.fit_all(pace, "race", engine_of=engine_of, as_of_round=r, by_season=by_season)
        for kind, n in (("driver", "n_obs"), ("team", "n_obs"), ("engine", "n_teams")):
            wanted += fits[kind].select(F.lit(r).alias("as_of_round"), F.lit(kind).alias("entity_type"), F.col(kind).alias("entity_id"), "mean", "sd", F.col(n).alias("n_obs")).collect()
    found = moments.round_moments(pace, "race", by_season)
    got = moments.strengths_by_round(found, by_season=by_season, engine_of=engine_of)
    same(got, wanted)
    one = moments.merged(found.where("round <= 3"), "entity_type", "entity_id").where("entity_type = 'driver'").collect()
    all_at_once = {r.entity_id: r for r in moments.merged(moments.merged(found.where("round <= 3"), "season", "entity_type", "entity_id"), "entity_type", "entity_id").collect()}
    assert one and all(abs(r.m2 - all_at_once[r.entity_id].m2) < 1e-9 and r.n == all_at_once[r.entity_id].n for r in one)


def test_rounds_asked_for_and_empty(spark):
    pace = spark.createDataFrame(features(2, 3), PACE)
    asked = spark.createDataFrame([(0,), (2,), (9,)], "round int")
    got = moments.strengths_by_round(moments.round_moments(pace, "race"), asked, min_rounds=2)
    assert {r.as_of_round for r in got.collect()} == {2, 9}
    assert got.where("entity_type = 'driver'").agg(F.min("n_obs")).first()[0] >= 2
    assert moments.strengths_by_round(moments.round_moments(pace.limit(0), "race")).count() == 0


def test_features_are_read_once(spark, tmp_path):
    spark.createDataFrame(features(3), PACE).write.parquet(str(tmp_path / "pace"))
    found = materialised(moments.round_moments(spark.read.parquet(str(tmp_path / "pace")), "race"))
    got = moments.strengths_by_round(found)
    plan = got._jdf.queryExecution().toString()
    assert str(tmp_path / "pace") not in plan and got.count() > 0
    lines = moments.round_moments(spark.read.parquet(str(tmp_path / "pace")), "race")._jdf.queryExecution().executedPlan().toString().splitlines()
    fields = [line.split("ReadSchema:")[1] for line in lines if "FileScan parquet" in line]
    assert len(fields) == 2 and sum("team" in f for f in fields) == 1, fields  # the other reads two columns, for the best time of a round


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    """Three pieces that cut through rounds and teams, late rounds first, each a new start; a repeated row and a null driver."""
    rows = features(4, 4)
    rows += [rows[5], (2026, 2, None, "red", 88.0)]
    random.Random(0).shuffle(rows)
    rows.sort(key=lambda r: -(r[1] // 3))
    folder = str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame(rows[k::3] if k else rows[0::3], PACE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        strengths.follow(spark, str(tmp_path / "in"), folder, "long_run_pace_s", suspect_s=0.9)
    known = spark.createDataFrame([r for r in rows if r[2]], PACE)
    filled = gaps.fill_teams(known)
    key = lambda df: sorted(map(str, ((r.season, r.round, r.driver, r.team) for r in df.collect())))
    assert key(strengths.filled_teams(spark, folder)) == key(filled)
    flagged = gaps.flag_suspects(filled.withColumn("quali_pace_s", F.lit(None).cast("double")), long_run_s=0.9)
    batch = moments.round_moments(flagged, "race", outlier_s=1e9)
    in_order = lambda df: sorted(df.collect(), key=lambda r: [str(r[c]) for c in moments.KEYS])
    streamed, wanted = in_order(strengths.streamed_moments(spark, folder)), in_order(batch)
    assert [[*[r[c] for c in moments.KEYS], r.n] for r in streamed] == [[*[r[c] for c in moments.KEYS], r.n] for r in wanted]
    assert [x for r in streamed for x in (r["sum"], r.m2)] == pytest.approx([x for r in wanted for x in (r["sum"], r.m2)], abs=1e-9)
    same(moments.strengths_by_round(strengths.streamed_moments(spark, folder)), moments.strengths_by_round(batch))


def test_contributions_by_themselves():
    team = strengths.TeamRound(1.0)
    assert team.contributions("t", [("a", 90.0, True), ("b", 92.0, True)]) == [("team", "t", 90.0)]
    assert team.contributions("t", [("a", 90.0, True), ("b", 90.5, True)]) == [("driver", "a", 0.25), ("driver", "b", -0.25), ("team", "t", 90.25)]
    assert team.contributions("t", [("a", 90.0, False), ("b", None, True)]) == []
    assert strengths.TeamHistory.filled([(1, 1, None, 1.0, True), (1, 2, "x", 1.0, True), (1, 3, " ", None, False)]) == [(1, 1, "x", 1.0, True), (1, 2, "x", 1.0, True), (1, 3, "x", None, False)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_known_as_of_against_brute_force(spark, inclusive):
    rng = random.Random(7)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 200))
    facts = [(rng.choice("abb"), rng.choice([day(), day(), None]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for _ in range(300)]
    facts += facts[:5] + [(None, day(), 1, "x")]
    asks = [(k, rng.choice([day(), day(), None]), n) for n in range(60) for k in "abc"] + [("a", dt.date(2026, 2, 1), 7)] * 2 + [(None, day(), 1)]
    got = asof.known_as_of(
        spark.createDataFrame(asks, "who string, cutoff date, n int").withColumn("team", F.lit("own")),
        spark.createDataFrame(facts, "who string, date date, place int, team string"), ["who"], ["place", "team"], inclusive=inclusive, bucket=9,
    )

    def answer(who, cutoff, column):
        rows = [f for f in facts if f[0] == who and f[1] and cutoff and who and (f[1] <= cutoff if inclusive else f[1] < cutoff) and f[column] is not None]
        return max(rows, key=lambda f: (f[1], f[2] if f[2] is not None else -1, f[3] or ""))[column] if rows else None

    wanted = sorted(map(str, ((w, c, n, answer(w, c, 2), answer(w, c, 3)) for w, c, n in asks)))
    assert sorted(str((r.who, r.cutoff, r.n, r.place, r.team)) for r in got.collect()) == wanted


def test_during_against_brute_force(spark):
    rng = random.Random(2)
    base = dt.datetime(2026, 3, 8, 13)
    time = lambda: base + dt.timedelta(seconds=rng.randint(0, 3600))
    spans = [(rng.choice(["r", "q", None]), n, rng.choice([time(), time(), None]), rng.choice([time(), time(), None])) for n in range(150)]
    spans += [("r", 900, base, base), ("r", 901, base, base + dt.timedelta(seconds=1)), ("r", 901, base, base + dt.timedelta(seconds=1))]
    points = [(rng.choice(["r", "q", None]), f"m{n}", rng.choice([time(), None])) for n in range(80)] + [("r", "edge", base)]
    got = asof.during(
        spark.createDataFrame(spans, "s string, lap int, a timestamp, b timestamp"), spark.createDataFrame(points, "s string, m string, t timestamp"), ["s"], "a", "b", "t", 7 * asof.MINUTE
    )
    wanted = sorted((lap, m) for s, lap, a, b in spans for k, m, t in points if s and s == k and a and b and t and a <= t < b)
    assert sorted((r.lap, r.m) for r in got.collect()) == wanted and (901, "edge") in wanted


def test_known_as_of_by_the_second(spark):
    base = dt.datetime(2026, 3, 8, 13)
    samples = [("r", base + dt.timedelta(seconds=60 * i), 20.0 + i) for i in range(90)]
    laps = [("r", n, base + dt.timedelta(seconds=95 * n)) for n in range(40)] + [("r", -1, base - dt.timedelta(seconds=1)), ("x", 0, base)]
    got = asof.known_as_of(
        spark.createDataFrame(laps, "s string, lap int, cutoff timestamp"), spark.createDataFrame(samples, "s string, date timestamp, air double"), ["s"], ["air"], inclusive=True, bucket=5 * asof.MINUTE, clock="micro"
    )
    assert {(r.s, r.lap): r.air for r in got.collect()} == {("r", n): 20.0 + 95 * n // 60 for n in range(40)} | {("r", -1): None, ("x", 0): None}
