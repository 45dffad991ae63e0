"""Registered queries over the racing domain; each has SQL of the same name in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import allocation, grid_modifier, seconds, status_class, team_slug
from stintline.operators import asof, evaluate, gaps, ledger, moments, pace, penalties, point_in_time, quantiles, records, reliability, sessions, simulate, strength
from stintline.plans import export, oracle, validity
from stintline.plans.model import freeze_round, replay_statuses, walk_forward
from stintline.rules import STRENGTH, ChaosRules
from stintline.sources import bindings as fx
from stintline.sources import landings
from stintline.sources.artifacts import Snapshot, materialised, shared_folder
from stintline.streaming import rounds, strengths

Query = Callable[[SparkSession, str], DataFrame]
#: Simulations of the registered queries: the fewest that SimulationRules accepts (its default is more). The SQL holds the same number.
RACE_SIMS = SEASON_SIMS = FORECAST_SIMS = 1000
SUSPECT_S = 0.5
LAP_KEYS = ["season", "round", "driver", "stint", "lap_number"]
_FOUND: dict[str, Query] = {}


def registered(build: Query, places: int = 8) -> Query:
    """Register a query; its floats come rounded to eight places, its integers long, its dates as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(spark, sf_dir), places)

    _FOUND[build.__name__] = run
    return run


def registered_to(places: int) -> Callable[[Query], Query]:
    """For means over a few rounds, which are often exact ties at any number of places: other places, and ties moved by NUDGE, in SQL too."""
    return lambda build: registered(build, places)


def tidy(df: DataFrame, places: int = 8) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(name)
        if kind in ("double", "float"):
            return F.round(c if places == 8 else c + F.lit(oracle.NUDGE), places) + F.lit(0.0)
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint")
        return c.cast("string") if kind in ("date", "timestamp") else c

    return df.select(*[one(n, t).alias(n) for n, t in df.dtypes])


def _valid(spark, d):
    return pace.valid_laps(pace.green_laps(pace.accurate_laps(fx.laps(spark, d))))


def _long(spark, d):
    return pace.long_stints(_valid(spark, d))


def _quali_laps(spark, d):
    return fx.laps(spark, d).where(~F.col("is_accurate"))


def pace_table(spark, d):
    return pace.pace_features(pace.accurate_laps(fx.laps(spark, d)), _quali_laps(spark, d))


def _flagged(spark, d):
    """Pace features with suspect flags, stored once: every strength reads them several times, the laps only once."""
    return materialised(gaps.flag_suspects(pace_table(spark, d), long_run_s=SUSPECT_S, quali_s=SUSPECT_S))


def _engine_of(flagged):
    """The engine of each team that has pace features."""
    return flagged.where("team is not null").select("team", fx.engine_of_team(F.col("team")).alias("engine")).distinct()


@registered
def scan_project_filter(spark, d):
    return _valid(spark, d).select(*LAP_KEYS, "lap_s")


@registered
def lap_units(spark, d):
    laps = fx.laps(spark, d)
    ns = F.rint(F.col("lap_s") * 1e9).cast("bigint")
    interval = F.make_dt_interval(secs=F.col("lap_s").cast("decimal(18,6)"))
    text = F.format_string("%d:%09.6f", F.floor(F.col("lap_s") / 60), F.col("lap_s") - 60 * F.floor(F.col("lap_s") / 60))
    return laps.select(
        "order_key", "part_key", "driver", "lap_number", seconds(ns, "ns").alias("from_ns"), seconds(interval, "interval").alias("from_interval"),
        seconds(text, "text").alias("from_text"), seconds(F.lit("no time"), "s").alias("from_bad"),
    )


@registered
def long_stints(spark, d):
    return _long(spark, d).select(*LAP_KEYS, "lap_s")


@registered
def fuel_corrected(spark, d):
    return pace.fuel_corrected(_long(spark, d)).select(*LAP_KEYS, "lap_s", "corrected_s")


@registered
def fuel_corrected_rank(spark, d):
    return pace.fuel_corrected(_long(spark, d), age="rank", order=fx.LAP_ORDER).select(*LAP_KEYS, "order_key", "part_key", "corrected_s")


@registered
def stint_iqr_filter(spark, d):
    return pace.drop_slow_outliers(pace.fuel_corrected(_long(spark, d))).select(*LAP_KEYS, "corrected_s")


@registered
def long_run_pace(spark, d):
    return pace.long_run_pace(pace.accurate_laps(fx.laps(spark, d)))


@registered
def session_best(spark, d):
    return pace.session_best(pace.accurate_laps(fx.laps(spark, d)))


@registered
def pace_features(spark, d):
    return pace_table(spark, d)


@registered
def trimmed_mean_pace(spark, d):
    return pace.trimmed_pace(fx.laps(spark, d), ["driver", "season", "stint"], ["driver", "team"])


@registered
def sprint_pace(spark, d):
    return pace.sprint_pace(fx.laps(spark, d))


@registered
def teammate_gaps(spark, d):
    return gaps.teammate_gaps(pace_table(spark, d))


@registered
def teammate_gaps_nation(spark, d):
    nations = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("driver"), F.col("s_nationkey").alias("team"))
    return gaps.teammate_gaps(pace_table(spark, d).drop("team").join(nations, "driver")).withColumnRenamed("team", "nation_team")


@registered
def intra_team_suspects(spark, d):
    return _flagged(spark, d).select("season", "round", "driver", "team", "long_run_suspect", "quali_suspect")


@registered
def team_ffill_bfill(spark, d):
    holes = pace_table(spark, d).select("round", "driver", F.when((F.col("driver") + F.col("round")) % 3 != 0, F.col("team")).alias("team"))
    return gaps.fill_teams(holes)


@registered
def field_outliers(spark, d):
    return strength.drop_field_outliers(pace_table(spark, d), "quali_pace_s", 1.0).select("season", "round", "driver", "quali_pace_s")


@registered
def driver_strength(spark, d):
    return strength.driver_strengths(_flagged(spark, d), "race")


@registered
def team_strength(spark, d):
    flagged = _flagged(spark, d)
    return strength.team_strengths(flagged, "race", engine_of=_engine_of(flagged))


@registered
def engine_strength(spark, d):
    flagged = _flagged(spark, d)
    return strength.engine_strengths(strength.team_strengths(flagged, "race", engine_of=_engine_of(flagged)))


@registered
def strength_long(spark, d):
    flagged = _flagged(spark, d)
    fits = strength.fit_all(flagged, "race", engine_of=_engine_of(flagged), as_of_round=7)
    return strength.strength_long(fits["driver"], fits["team"], fits["engine"], 7)


@registered_to(10)
def strength_walk(spark, d):
    """Strengths as of every round, from one plan over the stored features."""
    flagged = _flagged(spark, d)
    return moments.strengths_by_round(materialised(moments.round_moments(flagged, "race")), engine_of=_engine_of(flagged))


@registered
def driver_total_strength(spark, d):
    flagged = _flagged(spark, d)
    return strength.total_strength(strength.driver_strengths(flagged, "race"), strength.team_strengths(flagged, "race"), strength.latest_team(flagged))


@registered
def grid_modifier_(spark, d):
    results = fx.results(spark, d)
    entrants = results.groupBy("round").agg(F.count(F.lit(1)).alias("entrants"))
    return results.join(F.broadcast(entrants), "round").select("round", "driver", grid_modifier(F.col("grid"), F.col("entrants")).alias("move"))  # one row a round


@registered
def status_class_(spark, d):
    return fx.results(spark, d).select("round", "driver", "status", status_class(F.col("status")).alias("kind"))


@registered
def driver_reliability(spark, d):
    return reliability.driver_reliability(fx.results(spark, d))


@registered
def team_reliability(spark, d):
    return reliability.team_reliability(fx.results(spark, d))


@registered
def engine_reliability(spark, d):
    results = fx.results(spark, d)
    return reliability.engine_reliability(results, results.select("team", "engine").distinct())


@registered
def penalty_positions(spark, d):
    return penalties.driver_penalties(fx.usage(spark, d))


@registered
def penalty_risk(spark, d):
    return penalties.penalty_risk(fx.usage(spark, d), 5)


@registered
def rookie_flags(spark, d):
    cars = fx.results(spark, d).select("round", F.col("grid").alias("car"), F.col("driver").cast("string").alias("driver"))
    return records.regular_drivers(cars, cars.withColumn("round", F.col("round") + 1), ["round"])


@registered
def absent_regulars(spark, d):
    results = fx.results(spark, d).select("round", "driver")
    last = results.agg(F.max("round").alias("last"))
    due = results.crossJoin(F.broadcast(last)).where("round < last").select((F.col("round") + 1).alias("round"), "driver")  # one row
    return records.absent_regulars(results.where("(driver + round) % 7 <> 0"), due, ["round"])


@registered
def identity_bridge(spark, d):
    people = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.concat("c_mktsegment", F.lit(" Customer_"), F.element_at(F.split("c_name", "#"), 2)).alias("full_name")
    )
    ids = fx.table(spark, d, "supplier").select(F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))).alias("id"))
    return records.bridge_names(people, ids)


@registered
def upsert_latest(spark, d):
    old = fx.usage(spark, d).select("driver", "component", "units_used", F.lit(0).alias("batch"))
    new = old.where("driver % 3 = 0").select("driver", "component", (F.col("units_used") + 1).alias("units_used"), F.lit(1).alias("batch"))
    return records.upsert(old, new, ["driver", "component"], ["batch"])


@registered
def replace_by_round(spark, d):
    old = fx.results(spark, d).select("round", "driver", "v", F.lit("old").alias("src"))
    new = old.where("round % 2 = 0").select("round", "driver", (F.col("v") + 1).alias("v"), F.lit("new").alias("src"))
    return records.replace_by(old, new, ["round"])


@registered
def last_nonnull_per_key(spark, d):
    rows = fx.results(spark, d).select(
        "driver", "round", F.when(F.col("status") != "Finished", F.col("status")).alias("status"), F.when(F.col("position") > 3, F.col("position")).alias("position")
    )
    return records.last_known(rows, ["driver"], ["round"], ["status", "position"])


def _win(spark, d):
    return evaluate.win_probs(fx.scores(spark, d))


@registered
def topk_per_round(spark, d):
    return records.top_per(_win(spark, d), ["round"], [F.round("p", 12).desc(), F.col("driver")], 3).select("round", "driver", "p", "rk")


@registered
def next_round(spark, d):
    return point_in_time.next_round(fx.schedule(spark, d), "1998-06-30")


@registered
def last_completed(spark, d):
    return point_in_time.last_completed(fx.schedule(spark, d), "1998-06-30")


@registered
def points_scoring(spark, d):
    results = fx.results(spark, d)
    out = status_class(F.col("status")) != "finished"
    return results.select(
        "round", "driver", "position", simulate.score(F.col("position"), out, F.lit(False)).alias("race_points"), simulate.score(F.col("position"), out, F.lit(True)).alias("sprint_points")
    )


@registered
def grid_penalty_strength(spark, d):
    return simulate.grid_penalised(fx.race_field(spark, d)).select("driver", "mean")


def _orders(spark, d, chaos=None):
    return simulate.simulate_race(spark, fx.race_field(spark, d), RACE_SIMS, chaos=chaos, engine="md5", most=None)


@registered
def plackett_luce_orders(spark, d):
    order = Window.partitionBy("sim_id").orderBy(F.round("speed", 9).desc(), "driver")
    return _orders(spark, d).select("sim_id", "driver", F.row_number().over(order).alias("pos"))


@registered
def dnf_reorder(spark, d):
    finishers = F.count_if(~F.col("dnf_flag")).over(Window.partitionBy("sim_id"))
    return _orders(spark, d).select("sim_id", "driver", "dnf_flag", "pos", finishers.alias("n_finishers"))


@registered
def race_summary(spark, d):
    return simulate.race_summary(_orders(spark, d))


@registered
def finish_distribution(spark, d):
    return simulate.finish_distribution(_orders(spark, d))


@registered
def race_of_a_checked_field(spark, d):
    """The leading 22 of the standings, within the limit of entrants that every other registered race turns off."""
    leaders = fx.standings(spark, d).where("position <= 22").select("driver")
    return simulate.race_summary(simulate.simulate_race(spark, fx.race_field(spark, d).join(leaders, "driver", "left_semi"), RACE_SIMS, engine="md5"))


@registered
def race_chaos(spark, d):
    return simulate.race_summary(_orders(spark, d, ChaosRules()))


def _season_field(spark, d):
    entrants = fx.race_field(spark, d)
    standings = fx.standings(spark, d)
    teams = standings.select("driver", F.floor(F.col("driver") / 2).alias("team"))
    return simulate.season_field(standings, entrants.select("driver", "mean", "sd"), entrants.select("driver", "dnf"), teams)


def _season(spark, d):
    field = _season_field(spark, d)
    return simulate.simulate_season(spark, field, fx.schedule(spark, d), SEASON_SIMS, engine="philox", most=None)


@registered
def season_points(spark, d):
    return _season(spark, d).select("sim_id", "driver", "sim_points")


@registered
def title_probability(spark, d):
    return simulate.title_probability(_season(spark, d))


@registered
def ledger_titles(spark, d):
    """Title chances from a ledger: 400 simulations, then as many more as make the same number as title_probability's."""
    book = ledger.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", materialised(_season_field(spark, d)), materialised(fx.schedule(spark, d)), block=200, engine="philox", most=None)
    book.extend(400)
    book.extend(SEASON_SIMS)
    return book.titles()


@registered
def constructor_title(spark, d):
    standings = fx.standings(spark, d).groupBy(F.floor(F.col("driver") / 2).alias("team")).agg(F.sum("points").alias("points"), F.min("position").alias("position"))
    return simulate.constructor_title(_season(spark, d), standings)


@registered
def magic_number(spark, d):
    return simulate.magic_numbers(fx.standings(spark, d), 3)


@registered
def win_probs_softmax(spark, d):
    return _win(spark, d)


@registered
def brier_win(spark, d):
    return evaluate.brier_win(fx.scores(spark, d), fx.results(spark, d))


def forecasts(spark, d, zeros=True):
    """Canonical finishing probabilities of every round from the form before it; without ``zeros`` only the cells that occurred."""
    rows = fx.scores(spark, d).select("round", "driver", F.col("score").alias("mean"), F.lit(0.0).alias("dnf"), F.lit(False).alias("is_sprint"), F.col("round").alias("race"))
    sims = spark.range(FORECAST_SIMS).withColumnRenamed("id", "sim_id")
    orders = simulate.race_orders(rows.crossJoin(F.broadcast(sims)), engine="md5")  # FORECAST_SIMS rows
    seen = orders.groupBy("round", "driver", F.col("pos").alias("finish_pos")).agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return seen.select("round", "driver", "finish_pos", (F.col("n") / F.lit(float(FORECAST_SIMS))).alias("probability"))
    grid = orders.select("round", "driver").distinct().join(orders.select("round", F.col("pos").alias("finish_pos")).distinct(), "round")
    return grid.join(seen, ["round", "driver", "finish_pos"], "left").select(
        "round", "driver", "finish_pos", (F.coalesce("n", F.lit(0)) / F.lit(float(FORECAST_SIMS))).alias("probability")
    )


@registered
def brier_topk(spark, d):
    return evaluate.brier_topk(forecasts(spark, d, zeros=False), fx.results(spark, d), 3)


@registered
def brier_full(spark, d):
    # every driver and place occurs, so the grid's size is known from the cells that did; the others add nothing to the sum
    return evaluate.brier_full(materialised(forecasts(spark, d, zeros=False)), fx.results(spark, d))


@registered
def log_loss_win(spark, d):
    return evaluate.log_loss_win(fx.scores(spark, d), fx.results(spark, d))


def _diagram(spark, d):
    return evaluate.reliability_diagram(evaluate.win_pairs(fx.scores(spark, d), fx.results(spark, d)))


@registered
def reliability_diagram(spark, d):
    return _diagram(spark, d)


@registered
def ece(spark, d):
    return evaluate.calibration_error(_diagram(spark, d))


@registered
def rank_correlation(spark, d):
    return evaluate.rank_correlation(fx.scores(spark, d), fx.results(spark, d))


@registered
def eval_per_round(spark, d):
    return evaluate.evaluate_rounds(fx.scores(spark, d), fx.results(spark, d))


@registered
def accuracy(spark, d):
    return evaluate.accuracy(fx.scores(spark, d), fx.results(spark, d))


@registered
def skill_score(spark, d):
    pairs = evaluate._outcomes(_win(spark, d), fx.results(spark, d), 1, ["round"])
    per = pairs.groupBy("round").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("bs"), F.count(F.lit(1)).cast("double").alias("n"))
    return per.select("round", evaluate.skill_score(F.col("bs"), evaluate.naive_brier(F.col("n"))).alias("skill"))


@registered
def round_cutoffs(spark, d):
    calendar = fx.schedule(spark, d).withColumn("first_practice", F.when(F.col("round") % 3 != 0, F.col("first_practice")))
    return point_in_time.round_cutoffs(calendar)


@registered
def leakage_violations(spark, d):
    cutoffs = fx.schedule(spark, d).select("season", "round", F.date_add("first_practice", 180).alias("cutoff"))
    return point_in_time.leaks(fx.laps(spark, d).select("season", "round", "date"), cutoffs, ["season", "round"])


@registered
def known_at_cutoffs(spark, d):
    """Each driver's last team, lap and place in a round before every round's cutoff."""
    laps = fx.laps(spark, d)
    raced = laps.groupBy("season", "round", "driver").agg(F.max("date").alias("date"), F.min("lap_s").alias("best"))
    place = raced.select("driver", "date", F.floor(F.col("best") * 10).cast("bigint").alias("standing"))
    told = laps.select("driver", "date", F.when((F.col("order_key") % 5) != 0, F.col("team")).alias("team"), F.round("lap_s", 6).alias("lap_s"))
    facts = told.unionByName(place, allowMissingColumns=True)
    cutoffs = point_in_time.round_cutoffs(fx.schedule(spark, d))
    asks = laps.select("driver").distinct().crossJoin(simulate.small(cutoffs))  # a calendar, its size checked
    return asof.known_as_of(asks, facts, ["driver"], ["team", "lap_s", "standing"])


def _timed(spark, d):
    """(laps, samples, messages): a user's events of a day as laps up to the next one, views as weather samples, errors as messages."""
    events = fx.table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    turn = Window.partitionBy("day", "user_id").orderBy("ts", "event_id")
    laps = events.select("day", F.col("user_id").alias("driver"), F.col("event_id").alias("lap"), F.col("ts").alias("start"), F.lead("ts").over(turn).alias("end"))
    samples = events.where("event_type = 'view'").select("day", F.col("ts").alias("date"), "event_id", F.round("value", 6).alias("air_temp"))
    return laps, samples, events.where("event_type = 'error'").select("day", F.col("ts").alias("at"), F.col("event_id").alias("message"))


@registered
def weather_at_laps(spark, d):
    """The weather sample that held when each lap began."""
    laps, samples, _ = _timed(spark, d)
    asks = laps.select("day", "driver", "lap", F.col("start").alias("cutoff"))
    return asof.known_as_of(asks, samples, ["day"], ["air_temp"], inclusive=True, bucket=30 * asof.MINUTE, order=["event_id"], clock="micro").drop("cutoff")


@registered
def messages_in_laps(spark, d):
    """How many messages came during each lap that had any, and the first and last of them."""
    laps, _, messages = _timed(spark, d)
    met = asof.during(laps, messages, ["day"], "start", "end", "at", 30 * asof.MINUTE)
    return met.groupBy("day", "driver", "lap").agg(F.count(F.lit(1)).alias("messages"), F.min("message").alias("low"), F.max("message").alias("high"))


@registered
def prior_rounds_snapshot(spark, d):
    return point_in_time.before_round(pace_table(spark, d), fx.schedule(spark, d), 5).select("season", "round", "driver", "quali_pace_s", "date")


@registered
def replay_status(spark, d):
    calendar = fx.schedule(spark, d)
    snapshots = calendar.select("round", (F.col("round") % 4 != 0).alias("frozen"))
    return point_in_time.replay_status(calendar, snapshots, calendar.where("round <= 3").select("round"))


@registered
def coverage(spark, d):
    return pace.coverage(pace_table(spark, d), ["long_run_pace_s", "quali_pace_s"], ["season", "round"])


@registered
def export_driver_rows(spark, d):
    return export.driver_rows(forecasts(spark, d, zeros=False), fx.results(spark, d))


@registered
def json_props(spark, d):
    props = fx.table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return props.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max"))


@registered
def default_cutoff(spark, d):
    calendar = fx.schedule(spark, d)
    kinds = F.array_compact(
        F.array(F.lit("pre-fp1"), F.when(F.col("has_sprint"), F.lit("post-sprint")), F.when(F.col("round") % 3 == 1, F.lit("post-q")))
    )
    return export.default_cutoffs(calendar.select("round", F.explode(kinds).alias("cutoff")))


@registered
def qualifying_best(spark, d):
    orders = fx.table(spark, d, "orders")
    part = lambda status, by: F.when(F.col("o_orderstatus") == status, F.col("o_totalprice") / by)
    timed = orders.select(
        F.lit(2026).alias("season"), F.year("o_orderdate").alias("round"), F.col("o_orderkey").alias("Abbreviation"), F.col("o_custkey").alias("TeamName"),
        F.col("o_orderpriority").substr(1, 1).alias("Position"), part("F", 8999.7).alias("Q3"), F.when(F.col("o_orderstatus") == "O", 0.0).alias("Q2"), (F.col("o_totalprice") / 7999.7).alias("Q1"),
    )
    return landings.qualifying_results(timed)


@registered
def testing_days(spark, d):
    items = fx.table(spark, d, "lineitem")
    return landings.testing_days(items.select(F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("test_number"), F.col("l_linenumber").alias("day")))


@registered
def pace_session_laps(spark, d):
    kinds = F.when(F.col("stint").startswith("A"), "FP1").when(F.col("stint").startswith("N"), "FP2").otherwise("FP3")
    formats = fx.schedule(spark, d).select("season", "round", F.when(F.col("has_sprint"), "sprint_qualifying").otherwise("conventional").alias("event_format"))
    chosen = landings.pace_session(fx.laps(spark, d).withColumn("session_type", kinds), formats)
    return chosen.groupBy("season", "round", "session_type").agg(F.count(F.lit(1)).alias("laps"), F.min("lap_s").alias("best_s"))


@registered
def allocation_left(spark, d):
    usage = fx.usage(spark, d)
    allowed = allocation(F.col("season"), F.col("component"))
    return usage.select("driver", "component", "units_used", allowed.alias("allowed"), F.greatest(allowed - F.col("units_used"), F.lit(0)).alias("units_left"))


@registered
def win_pairs(spark, d):
    pairs = evaluate.win_pairs(fx.scores(spark, d), fx.results(spark, d))
    return pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))


@registered
def summary_metrics(spark, d):
    scores, results = fx.scores(spark, d), fx.results(spark, d)
    per_round = evaluate.brier_win(scores, results).join(evaluate.log_loss_win(scores, results), "round").drop("round")
    return evaluate.summarize(per_round, evaluate.win_pairs(scores, results))


@registered
def results_lookup(spark, d):
    rows = fx.results(spark, d).select("round", "driver", "position")
    return export.results_lookup(rows.where("round % 3 <> 0").withColumn("source", F.lit("first")), rows.where("round >= 3").withColumn("source", F.lit("fallback")))


@registered
def season_entrants(spark, d):
    standings = fx.standings(spark, d)
    known = fx.race_field(spark, d).where("driver % 4 <> 0")
    rates = fx.race_field(spark, d).where("driver % 3 <> 0").select("driver", "dnf")
    teams = standings.where("driver % 5 <> 0").select("driver", F.floor(F.col("driver") / 2).alias("team"))
    return simulate.season_field(standings, known, rates, teams)


@registered
def race_posterior(spark, d):
    return simulate.race_summary(simulate.simulate_race(spark, fx.race_field(spark, d), RACE_SIMS, engine="md5", most=None, sample=True))


@registered
def export_with_meta(spark, d):
    names = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("driver"), F.col("s_name").alias("display_name"), F.concat(F.lit("team_"), F.col("s_nationkey").cast("string")).alias("team"))
    return export.with_meta(fx.results(spark, d).select("round", "driver", "points"), names)


@registered
def last_completed_inclusive(spark, d):
    last_day = fx.schedule(spark, d).where("round = 4").agg(F.max("date")).first()[0]
    return point_in_time.last_completed(fx.schedule(spark, d), str(last_day), inclusive=True)


@registered
def streamed_windows(spark, d):
    return rounds.event_windows(spark, d)


def _streamed_laps(spark, d):
    """(folder, path): laps written to a new folder of the shared one, to be read as a stream of files."""
    folder = f"{shared_folder(spark)}/laps-{uuid.uuid4().hex}"
    fx.laps(spark, d).write.parquet(f"{folder}/laps")
    return folder, f"{folder}/laps"


@registered
def streamed_features(spark, d):
    folder, path = _streamed_laps(spark, d)
    stream = rounds.lap_stream(spark, path, spark.read.parquet(path).schema)
    rounds.feature_sink(stream, path, f"{folder}/features", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/features").select(*pace_table(spark, d).columns)


@registered
def streamed_best(spark, d):
    folder, path = _streamed_laps(spark, d)
    cutoffs = fx.schedule(spark, d).select("round", F.date_add("first_practice", 180).alias("cutoff"))
    stream = rounds.lap_stream(spark, path, spark.read.parquet(path).schema)
    return rounds.drained(rounds.running_best(rounds.guarded(stream, cutoffs)), folder)


def _followed(spark, d):
    """(folder, engines): features with missing teams, as three files that cut across rounds and teams, late rounds first, followed by the streams."""
    folder = f"{shared_folder(spark)}/strengths-{uuid.uuid4().hex}"
    table = pace_table(spark, d).withColumn("team", F.when((F.col("driver") + F.col("round")) % 3 != 0, F.col("team")))
    table.write.parquet(f"{folder}/all")
    features = spark.read.parquet(f"{folder}/all")
    part = F.when(F.col("round") >= 6, 0).when(F.col("driver") % 4 < 2, 1).otherwise(2)
    limits = features.groupBy("round").agg((F.min("long_run_pace_s") + F.lit(STRENGTH.long_run_outlier_s)).alias("most"))
    for k in range(3):
        features.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/features")
        strengths.follow(spark, f"{folder}/features", folder, "long_run_pace_s", limits, SUSPECT_S)  # each time a new start from the checkpoint
    return folder


@registered
def streamed_teams(spark, d):
    return strengths.filled_teams(spark, _followed(spark, d)).withColumn("driver", F.col("driver").cast("bigint")).withColumn("team", F.col("team").cast("bigint"))


@registered_to(10)
def streamed_strengths(spark, d):
    return moments.strengths_by_round(materialised(strengths.streamed_moments(spark, _followed(spark, d))))


@registered
def streamed_long_runs(spark, d):
    """Long-run pace from tick counts that three batches of laps added to."""
    folder = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    fx.laps(spark, d).where("is_accurate").repartition(3).write.parquet(f"{folder}/laps")
    stream = rounds.lap_stream(spark, f"{folder}/laps", spark.read.parquet(f"{folder}/laps").schema, 1)
    rounds.count_sink(stream, f"{folder}/counts", f"{folder}/checkpoint", ticks=1_000_000).awaitTermination()
    return quantiles.long_run_from_counts(rounds.stored_counts(spark, f"{folder}/counts"), ticks=1_000_000)


@registered
def fuel_corrected_auto(spark, d):
    worn = _long(spark, d).withColumn("tyre_life", F.lit(None).cast("int"))
    return pace.fuel_corrected(worn, age="auto", order=fx.LAP_ORDER).select(*LAP_KEYS, "order_key", "part_key", "corrected_s")


@registered
def strength_as_of(spark, d):
    flagged = _flagged(spark, d)
    return strength.fit_all(flagged, "race", engine_of=_engine_of(flagged), as_of_round=4)["driver"]


@registered
def features_full(spark, d):
    return gaps.full_features(materialised(pace_table(spark, d)), long_run_s=SUSPECT_S, quali_s=SUSPECT_S)


@registered
def extra_pace(spark, d):
    quali, sprint = _FOUND["qualifying_best"](spark, d), pace.sprint_pace(fx.laps(spark, d))
    return pace.extra_pace(quali).withColumn("kind", F.lit("post-q")).unionByName(pace.extra_pace(sprint).withColumn("kind", F.lit("post-sprint")))


@registered
def testing_pace(spark, d):
    items = fx.table(spark, d, "lineitem")
    timed = items.select(
        F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("Driver"), (F.col("l_suppkey") % 5).alias("Team"), F.col("l_linestatus").alias("Stint"), F.col("l_linenumber").alias("LapNumber"),
        F.when(F.col("l_tax") > 0.01, 1).alias("test_number"), F.col("l_linenumber").alias("day"), (F.col("l_returnflag") == "N").alias("IsAccurate"), (60 + F.col("l_extendedprice") / 10000).alias("lap_s"),
    )
    return pace.trimmed_pace(landings.testing_laps(timed), ["driver", "season", "test_number", "day", "stint"], ["season", "driver", "team"])


def _session_map(spark, d):
    results = fx.results(spark, d)
    driver, team = F.concat(F.lit("d"), F.col("driver").cast("string")), F.col("team").cast("string")
    kinds = F.explode(F.array(F.lit("FP1"), F.lit("R")))
    drivers = results.select(F.lit(2024).alias("season"), "round", kinds.alias("session_type"), F.lpad(F.col("grid").cast("string"), 4, "0").alias("car_number"), driver.alias("driver"), F.concat(F.lit("Driver "), driver).alias("full_name"), team.alias("team"))
    formats = sessions.event_formats(results.select(F.lit(2024).alias("season"), "round", (F.col("round") % 2 == 0).alias("has_sprint")).distinct())
    return sessions.session_map(drivers, formats)


@registered
def session_map(spark, d):
    return _session_map(spark, d)


@registered
def session_identities(spark, d):
    ids = fx.results(spark, d).where("driver % 4 <> 0").select(F.concat(F.lit("d"), F.col("driver").cast("string")).alias("id")).distinct()
    return sessions.identities(_session_map(spark, d), ids)


@registered
def evaluation_bridged(spark, d):
    named = F.concat(F.lit("D"), F.col("driver").cast("string"))
    scores = fx.scores(spark, d).withColumn("driver", named)
    results = fx.results(spark, d).withColumn("driver", F.col("driver").cast("string"))
    ids = results.select(F.concat(F.lit("D"), F.col("driver")).alias("driver"), F.col("driver").alias("id")).distinct()
    return evaluate.evaluate_rounds(evaluate.bridged(scores, ids), results)


@registered
def championship_summary(spark, d):
    standings = fx.standings(spark, d).groupBy(F.floor(F.col("driver") / 2).alias("team")).agg(F.sum("points").alias("points"), F.min("position").alias("position"))
    return simulate.championship_summary(simulate.championship(_season(spark, d), standings))


@registered
def reliability_features_(spark, d):
    results = fx.results(spark, d)
    found = reliability.reliability_features(results, results.select("team", "engine").distinct())
    rows = [df.select(F.lit(k).alias("kind"), F.col(k).cast("string").alias("id"), "starts", "total_dnfs", "total_dnf_rate") for k, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@registered
def team_slugs(spark, d):
    known = {"united states": "usa", "united kingdom": "britain"}
    return fx.table(spark, d, "nation").select("n_nationkey", team_slug(F.initcap(F.col("n_name")), known).alias("slug"))


@registered
def calendar_checks(spark, d):
    """What breaks a calendar's constraints, on the season's rounds with circuits that come again and an unknown word."""
    word = lambda name: F.lit(name)
    rows = fx.schedule(spark, d).select(
        F.lit(2026).alias("season"), "round", F.concat(F.lit("c"), F.col("round") % 3).alias("circuit_id"), "date",
        F.when(F.col("has_sprint"), "sprint").otherwise("normal").alias("weekend_format"), word("low").alias("downforce_level"),
        F.when(F.col("round") % 4 == 0, "steep").otherwise("easy").alias("overtaking"), word("high").alias("tyre_deg"),
    )
    return validity.calendar_violations(rows, 22, [2, 5])


@registered
def default_round(spark, d):
    """Before all rounds, between two, after all, and in the weekend of a round without a forecast."""
    calendar = materialised(fx.schedule(spark, d))
    weekend = calendar.where("round = 6").agg(F.date_sub(F.max("date"), 3).cast("string")).first()[0]
    found = [export.default_round(calendar.where("round <= 5").select("round"), calendar, day).withColumn("as_of", F.lit(day)) for day in ("1990-01-01", "1998-06-30", "2050-01-01", weekend)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


class _Uniform:
    """Equal chances for every driver that a snapshot has pace of."""

    version = "uniform"

    def predict(self, snapshot, round_, guard):
        drivers = snapshot.frame("pace_features").select("driver").distinct()
        n = drivers.agg(F.count(F.lit(1)).alias("n"))
        return drivers.crossJoin(F.broadcast(n)).select("driver", F.lit(1).alias("finish_pos"), (1 / F.col("n")).alias("probability"))  # one row


@registered
def frozen_replay(spark, d):
    """What is stored after rounds 2 to 4 are frozen and 2 and 3 predicted: status, rows and last round of each snapshot, mean forecast, and whether a leak is refused."""
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    calendar, features = materialised(fx.schedule(spark, d)), materialised(pace_table(spark, d))
    guard = point_in_time.Guard(calendar)
    snapshots = {r: Snapshot(spark, root, 1998, r) for r in (2, 3, 4)}
    for snapshot in snapshots.values():
        freeze_round(snapshot, guard, calendar, features, features.select("season", "round", "driver"))
    forecasts = walk_forward(spark, root, 1998, _Uniform(), guard, [2, 3], errors="raise")
    stored = [s.frame("pace_features").agg(F.count(F.lit(1)).alias("rows"), F.max("round").alias("last_round")).withColumn("round", F.lit(r)) for r, s in snapshots.items()]
    chances = [forecasts[r].agg(F.avg("probability").alias("mean_chance")).withColumn("round", F.lit(r)) for r in (2, 3)]
    late = Snapshot(spark, root, 1998, 5).start(guard.cutoff(5))
    try:
        late.write_frame("leaky", fx.laps(spark, d).where("round = 5"))
        refused = False
    except point_in_time.LeakageError:
        refused = True
    out = replay_statuses(spark, root, 1998, sorted(guard.cutoffs)).join(stored[0].unionByName(stored[1]).unionByName(stored[2]), "round", "left")
    return out.join(chances[0].unionByName(chances[1]), "round", "left").withColumn("leak_refused", F.lit(refused))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps to pace, pace to strengths, strengths to a simulated race: each driver's chances, best first."""
    flagged = _flagged(spark, sf_dir)
    total = strength.total_strength(strength.driver_strengths(flagged, "race"), strength.team_strengths(flagged, "race"), strength.latest_team(flagged))
    orders = simulate.simulate_race(spark, total.select("driver", "mean", "sd"), RACE_SIMS, sample=True, most=None)
    return tidy(simulate.race_summary(orders)).orderBy(F.desc("win_prob"), "driver")


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): run for name, run in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
