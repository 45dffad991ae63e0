"""Races and seasons: invariants, degenerate cases, reproducibility."""

import pytest
from pyspark.sql import functions as F

from stintline.functions.random import gumbel, normal, uniform
from stintline.operators import evaluate, simulate
from stintline.rules import ChaosRules, SimulationRules

N = 400


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(f"d{i}", 2.0 - 0.3 * i, 0.2, 0.1) for i in range(12)], "driver string, mean double, sd double, dnf double")


@pytest.fixture(scope="module")
def orders(spark, field):
    return simulate.simulate_race(spark, field, N, seed=1).cache()


def test_random_numbers_have_their_distributions(spark):
    u, v = uniform(F.col("id"), F.lit("a")), uniform(F.col("id"), F.lit("b"))
    row = spark.range(40_000).select(F.avg(u), F.stddev(normal(u, v)), F.avg(normal(u, v)), F.avg(gumbel(u)), F.avg(uniform(F.col("id"), engine="md5"))).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(1, abs=0.02) and row[2] == pytest.approx(0, abs=0.02)
    assert row[3] == pytest.approx(0.5772, abs=0.03) and row[4] == pytest.approx(0.5, abs=0.01)


def test_each_simulation_is_a_permutation_with_retired_cars_last(orders):
    per = orders.groupBy("sim_id").agg(F.collect_set("pos").alias("p"), F.max(F.when(~F.col("dnf_flag"), F.col("pos"))).alias("in"), F.min(F.when(F.col("dnf_flag"), F.col("pos"))).alias("out"), F.sum("points").alias("s"))
    for r in per.collect():
        assert sorted(r.p) == list(range(1, 13)) and (r.out is None or r["in"] is None or r["in"] < r.out) and r.s <= 101
    assert orders.where("dnf_flag and points > 0").count() == 0


def test_summary_and_distribution(orders):
    rows = simulate.race_summary(orders).collect()
    assert sum(r.win_prob for r in rows) == pytest.approx(1) and sum(r.podium_prob for r in rows) == pytest.approx(3)
    assert max(rows, key=lambda r: r.win_prob).driver == "d0" and sum(r.dnf_prob for r in rows) / 12 == pytest.approx(0.1, abs=0.02)
    grid = simulate.finish_distribution(orders)
    assert grid.count() == 144
    for by in ("driver", "finish_pos"):
        assert all(r.s == pytest.approx(1) for r in grid.groupBy(by).agg(F.sum("probability").alias("s")).collect())


def test_same_seed_same_orders_whatever_the_partitions(spark, field, orders):
    again = simulate.simulate_race(spark, field.repartition(7), N, seed=1)
    assert not orders.select("sim_id", "driver", "pos").exceptAll(again.select("sim_id", "driver", "pos")).count()
    assert orders.select("sim_id", "driver", "pos").exceptAll(simulate.simulate_race(spark, field, N, seed=2).select("sim_id", "driver", "pos")).count()


def test_all_retired_nobody_scores(spark, field):
    out = simulate.simulate_race(spark, field.withColumn("dnf", F.lit(1.0)), 20)
    assert out.agg(F.sum("points")).first()[0] == 0


def test_field_is_checked(spark, field):
    with pytest.raises(ValueError):
        simulate.simulate_race(spark, field.where("false"), 5)
    with pytest.raises(ValueError):
        simulate.simulate_race(spark, field.withColumn("dnf", F.lit(1.5)), 5)
    with pytest.raises(ValueError):
        simulate.simulate_race(spark, spark.range(31).select(F.col("id").alias("driver"), F.lit(0.0).alias("mean")), 5)
    with pytest.raises(ValueError):
        SimulationRules(n_sims=0)


def test_grid_penalty(spark):
    rows = spark.createDataFrame([("a", 1.0, 0, False), ("b", 1.0, 10, False), ("c", 1.0, 20, True), ("d", 1.0, None, None)], "driver string, mean double, penalty_positions int, pit_lane boolean")
    assert {r.driver: round(r["mean"], 9) for r in simulate.grid_penalised(rows).collect()} == {"a": 1.0, "b": 0.8, "c": 0.4, "d": 1.0}


def test_chaos_hurts_the_favourite(spark, field):
    best = lambda c: {r.driver: r.win_prob for r in simulate.race_summary(simulate.simulate_race(spark, field, 1500, chaos=c)).collect()}["d0"]
    calm = best(None)
    assert best(ChaosRules(safety_car=1, rain=1)) < calm
    assert best(ChaosRules(safety_car=0, rain=1, rain_noise=1)) < calm


STAND = "driver string, position int, points double"


def season(spark, rows, means, rounds, sims=300, sd=0.1):
    standings = spark.createDataFrame(rows, STAND)
    known = spark.createDataFrame([(k, v, sd) for k, v in means.items()], "driver string, mean double, sd double")
    calendar = spark.createDataFrame([(i, i % 2 == 0) for i in range(1, rounds + 1)], "round int, has_sprint boolean")
    return simulate.simulate_season(spark, simulate.season_field(standings, known), calendar, sims)


def test_season(spark):
    none = season(spark, [("a", 1, 100.0), ("b", 2, 80.0), ("c", 3, 60.0)], {"a": 0.0}, 0)
    assert {r.driver: r.title_prob for r in simulate.title_probability(none).collect()} == {"a": 1, "b": 0, "c": 0}
    star = simulate.title_probability(season(spark, [("a", 1, 200.0), ("b", 2, 100.0)], {"a": 5.0, "b": 0.0}, 5)).collect()
    got = {r.driver: r for r in star}
    assert got["a"].title_prob > 0.85 and got["a"].title_prob + got["b"].title_prob == pytest.approx(1)
    assert got["a"].expected_points == pytest.approx(200 + got["a"].expected_added)
    tie = simulate.title_probability(season(spark, [("z", 1, 50.0), ("a", 2, 50.0)], {}, 0)).collect()
    assert {r.driver: r.title_prob for r in tie} == {"z": 1, "a": 0}


def test_unknown_strengths_and_constructors(spark):
    field = simulate.season_field(spark.createDataFrame([("a", 1, 1.0)], STAND), spark.createDataFrame([], "driver string, mean double, sd double")).first()
    assert (field["mean"], field.sd, field.dnf) == (0.0, 2.0, 0.08)
    run = season(spark, [("a", 1, 10.0), ("b", 2, 5.0)], {}, 3).withColumn("team", F.when(F.col("driver") == "a", "t"))
    teams = spark.createDataFrame([("t", 1, 10.0), ("u", 2, 400.0)], "team string, position int, points double")
    assert {r.team: r.title_prob for r in simulate.constructor_title(run, teams).collect()} == {"t": 0, "u": 1}


def test_magic_number(spark):
    magic = lambda rows, left: {r.driver: r.magic_number for r in simulate.magic_numbers(spark.createDataFrame(rows, STAND), left).collect()}
    assert magic([("a", 1, 400.0), ("b", 2, 200.0)], 0)["a"] == 200
    assert magic([("a", 1, 200.0), ("b", 2, 190.0)], 10)["a"] < 0
    assert magic([("a", 1, 200.0)], 1)["a"] is None


FORE = "round int, driver string, finish_pos int, probability double"
RES = "round int, driver string, position int"


def grid(spark, p):
    return spark.createDataFrame([(1, f"d{i}", j, p(i, j)) for i in range(1, 5) for j in range(1, 5)], FORE)


def test_metrics(spark):
    results = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 5)], RES)
    even, sure = grid(spark, lambda i, j: 0.25), grid(spark, lambda i, j: float(i == j))
    assert evaluate.brier_win(even, results).first().bs_win == pytest.approx(3 / 16) and evaluate.brier_win(sure, results).first().bs_win == 0
    assert evaluate.brier_full(even, results).first().bs_full == pytest.approx(3 / 16) and evaluate.brier_full(sure, results).first().bs_full == 0
    assert evaluate.brier_topk(sure, results, 3).first().bs_top3 == 0 and evaluate.log_loss_win(sure, results).first().log_loss_win < 1e-5
    for sign, rho in ((-1, 1), (1, -1)):
        score = spark.createDataFrame([(1, f"d{i}", float(sign * i)) for i in range(1, 5)], "round int, driver string, score double")
        assert evaluate.rank_correlation(score, results).first().rank_corr == pytest.approx(rho)
    hit = evaluate.accuracy(sure, results).first()
    assert hit.top1_hit and hit.top3_hit and hit.predicted_winner == "d1"
    report = evaluate.evaluate_rounds(even, results)
    assert evaluate.summarize(report, evaluate.win_pairs(even, results)).first().n_rounds == 1
    assert evaluate.brier_win(even, results.where("false")).count() == 0
    with pytest.raises(ValueError):
        evaluate.win_probs(results)


def test_calibration_bins(spark):
    pairs = spark.createDataFrame([(0.0, 0), (0.3, 1), (1.0, 1), (1.0, 0)], "p double, y int")
    rows = {r.bin: r for r in evaluate.reliability_diagram(pairs).collect()}
    assert len(rows) == 10 and rows[2]["count"] == 1 and rows[9]["count"] == 2 and rows[5].mean_pred is None and rows[9].gap == 0.5
    assert evaluate.calibration_error(evaluate.reliability_diagram(pairs)).first().ece == pytest.approx((0 + 0.7 + 2 * 0.5) / 4)


@pytest.mark.parametrize(
    "counter, key, block",
    [  # known answers of Philox 4x32-10
        ((0, 0, 0, 0), (0, 0), (0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8)),
        ((0xFFFFFFFF,) * 4, (0xFFFFFFFF,) * 2, (0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD)),
        ((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), (0xA4093822, 0x299F31D0), (0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1)),
    ],
)
def test_philox_known_answers(spark, counter, key, block):
    from stintline.functions.random import philox

    row = philox(spark.range(1), key, [F.lit(c).cast("bigint") for c in counter], list("abcd")).first()
    assert (row.a, row.b, row.c, row.d) == block


def test_philox_streams_and_words(spark):
    from stintline.functions.random import spawn, uniforms, words

    df = spark.range(20_000).withColumn("name", F.concat(F.lit("d"), F.col("id").cast("string")))
    drawn = [uniforms(df, spawn(7, s), [F.col("id"), F.lit(0), *words(F.col("name"), "string")], list("abcd")).orderBy("id").collect() for s in (0, 1, 1)]
    assert drawn[1] == drawn[2] and all(x.a != y.a for x, y in zip(drawn[0][:100], drawn[1]))
    for c in "abcd":
        values = [r[c] for r in drawn[0]]
        assert 0 < min(values) and max(values) < 1 and abs(sum(values) / len(values) - 0.5) < 0.01
    assert spark.range(1).select(*words(F.lit(-1), "bigint"), *words(F.lit(None), "bigint")).first()[:] == (0xFFFFFFFF, 0xFFFFFFFF, 0, 0)
    with pytest.raises(ValueError, match="32 bits"):
        spawn(1, 2**32)


def test_engines_agree_in_distribution(spark, field):
    """The counter-based engine, also with chaos and offsets for a season, against the hash."""
    from stintline.rules import ChaosRules

    for options in ({}, {"chaos": ChaosRules(), "sample": True, "develop": True}):
        a, b = ({r.driver: r for r in simulate.race_summary(simulate.simulate_race(spark, field, 4000, engine=e, **options)).collect()} for e in ("philox", "xxhash64"))
        assert all(abs(a[d].win_prob - b[d].win_prob) < 0.04 and abs(a[d].expected_points - b[d].expected_points) < 0.6 for d in b)
