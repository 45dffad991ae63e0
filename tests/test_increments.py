"""What adds up: blocks of simulations, tick counts, ranks over ranges; each against the same done at once."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.operators import ledger, pace, quantiles, ranks, simulate

FIELD = "driver string, standing int, start_points double, mean double, sd double, dnf double, team string"


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(f"d{i}", i + 1, 100.0 - 9 * i, 1.0 - 0.1 * i, 0.3, 0.1, f"t{i // 2}") for i in range(6)], FIELD)


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(1, True), (2, False)], "round int, has_sprint boolean")


@pytest.mark.parametrize("engine", ["philox", "xxhash64"])
def test_blocks_add_up(spark, tmp_path, field, calendar, engine):
    """100 and 100 more equal 200 at once; a lost block is made again; what is there is not."""
    book = ledger.Ledger(spark, str(tmp_path / "book"), field, calendar, block=50, engine=engine)
    assert book.titles().count() == 0
    assert book.extend(100) == [0, 1] and book.extend(160) == [2, 3] and book.extend(200) == []
    whole = simulate.title_probability(simulate.simulate_season(spark, field, calendar, 200, engine=engine)).orderBy("driver").collect()
    assert book.titles().orderBy("driver").select(*whole[0].asDict()).collect() == whole
    assert book.points().agg(F.sum("n")).first()[0] == 6 * 200
    lost = book.folder.read("ledger.json")
    book.folder.write("ledger.json", {**lost, "blocks": [0, 2, 3]})  # block 1 failed before it was named
    assert book.points().agg(F.sum("n")).first()[0] == 6 * 150
    assert book.extend(200) == [1] and book.titles().orderBy("driver").select(*whole[0].asDict()).collect() == whole


def test_other_inputs_are_refused(spark, tmp_path, field, calendar):
    ledger.Ledger(spark, str(tmp_path / "book"), field, calendar, block=50).extend(50)
    for other in ({"seed": 7}, {"block": 25}, {"develop": False}):
        with pytest.raises(ValueError, match="another"):
            ledger.Ledger(spark, str(tmp_path / "book"), field, calendar, **{"block": 50, **other}).extend(50)
    with pytest.raises(ValueError, match="another"):
        ledger.Ledger(spark, str(tmp_path / "book"), field.withColumn("mean", F.col("mean") + 1), calendar, block=50).titles()


def test_stretches():
    assert ledger._stretches([]) == [] and ledger._stretches([0, 1, 2, 5, 7, 8]) == [(0, 2), (5, 5), (7, 8)]


def test_quantiles_from_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([None, rng.randint(80_000, 80_040) / 1000, rng.randint(79_000, 99_000) / 1000])) for _ in range(400)] + [("one", 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    parts = [quantiles.tick_counts(df.where(c), ["k"], F.col("x")) for c in ("x < 80.02", "x >= 80.02 or x is null")]
    got = {r.k: r for r in quantiles.quantiles(quantiles.merged_counts(["k"], *parts), ["k"], {"q1": 0.25, "q2": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", "one"}
    for k, r in got.items():
        x = [v for key, v in rows if key == k and v is not None]
        assert r.n == len(x)
        assert [r.q1, r.q2, r.q3, r.low, r.high] == pytest.approx(np.percentile(x, [25, 50, 75, 0, 100]).tolist(), abs=1e-9)


def test_long_runs_from_counts(spark):
    """Stints that come in two parts, an older tyre in the second, missing ages, short and slow stints."""
    rng = random.Random(9)
    rows = []
    for d in "abcd":
        for stint in "123":
            for lap in range(rng.choice([3, 5, 9, 14])):
                age = None if rng.random() < 0.08 else lap + 1
                rows.append((2026, 1, d, rng.choice(["x", None]), stint, lap + 1, round(90 + rng.random() + 20 * (rng.random() < 0.1), 3), age, rng.choice(["1"] * 9 + ["4"]), lap, lap))
    laps = spark.createDataFrame(rows, "season int, round int, driver string, team string, stint string, lap_number int, lap_s double, tyre_life int, track_status string, order_key int, part_key int")
    parts = [quantiles.stint_counts(laps.where(c)) for c in ("lap_number % 2 = 0", "lap_number % 2 = 1")]
    got = quantiles.long_run_from_counts(quantiles.merged_stints(parts[0].unionByName(parts[1])))
    wanted = {(r.driver): r for r in pace.long_run_pace(laps).collect()}
    found = {r.driver: r for r in got.collect()}
    assert set(found) == set(wanted) and found
    for d, r in found.items():
        assert r.long_run_n == wanted[d].long_run_n and r.long_run_pace_s == pytest.approx(wanted[d].long_run_pace_s, abs=1e-6)


@pytest.mark.parametrize("how", [2, 64])
def test_average_ranks_over_ranges(spark, how):
    rng = random.Random(3)
    rows = [("a", rng.choice([1.0, 2.0, 5.0, round(rng.random(), 2)])) for _ in range(300)] + [("b", 7.0)] * 40 + [("c", 1.0), ("c", None)]
    got = ranks.with_average_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "r", how).collect()
    assert len(got) == len(rows)
    for r in got:
        values = [x for g, x in rows if g == r.g and x is not None]
        assert r.r == (None if r.x is None else sum(v > r.x for v in values) + (sum(v == r.x for v in values) + 1) / 2)
    plan = ranks.with_average_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_softmax_over_groups(spark):
    rows = [("a", 800.0), ("a", 799.0), ("a", None), ("b", -1e3)]
    got = sorted(((r.g, r.p) for r in ranks.softmax(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()), key=str)
    assert [g for g, _ in got] == ["a", "a", "a", "b"] and sorted(p for _, p in got if p) == pytest.approx([0.2689414, 0.7310586, 1.0], abs=1e-6)
    assert statistics.fsum(p for g, p in got if g == "a" and p) == pytest.approx(1)
