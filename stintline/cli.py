"""Command line: the batch steps of a season over a folder of landed data.

The folder holds ``landing/`` (JSON documents; timing laps and session results as Parquet), ``session_map``, ``features``, ``testing``, ``strengths``,
``snapshots``, ``predictions``, ``championship``, ``reports`` and ``export``.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.operators import evaluate, gaps, pace, point_in_time, sessions, simulate, strength
from stintline.operators.records import same_keys
from stintline.plans import export
from stintline.plans.model import StrengthModel, freeze_round, testing_as_pace, walk_forward
from stintline.rules import SIMULATION
from stintline.sources import fetch, landings
from stintline.sources.artifacts import Folder, Predictions, Snapshot, materialised, replace_rounds


class Season:
    """Where a season's tables lie."""

    def __init__(self, spark: SparkSession, root: str, season: int):
        self.spark, self.root, self.season = spark, root.rstrip("/"), season

    def schedule(self) -> DataFrame:
        return landings.schedule(self.spark, f"{self.root}/landing/schedule").where(F.col("season") == self.season)

    def results(self) -> DataFrame:
        return landings.race_results(self.spark, f"{self.root}/landing/results").where(F.col("season") == self.season)

    def standings(self, kind: str, after: int) -> DataFrame:
        rows = landings.standings(self.spark, f"{self.root}/landing/{kind}", kind)
        return rows.where((F.col("season") == self.season) & (F.col("round") == after))

    def has(self, name: str) -> bool:
        return Folder(self.spark, self.path(name)).exists()

    def timing(self) -> DataFrame:
        return landings.timing_laps(self.spark, f"{self.root}/landing/laps", False).where(F.col("season") == self.season)

    def laps(self) -> DataFrame:
        return landings.as_pace_laps(self.timing().where("test_number is null"))

    def sessions(self) -> DataFrame:
        return landings.session_results(self.spark, f"{self.root}/landing/sessions").where(F.col("season") == self.season)

    def session_map(self) -> DataFrame:
        return self.spark.read.parquet(self.path("session_map")).where(F.col("season") == self.season)

    def identities(self, ids: DataFrame) -> DataFrame:
        """(driver, full_name, team, id): abbreviations of the timing tables and the results' ids; empty before the session map is built."""
        if not self.has("session_map"):
            return self.spark.createDataFrame([], "driver string, full_name string, team string, id string")
        return sessions.identities(self.session_map(), ids)

    def features(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/features").where(F.col("season") == self.season)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def ingest(season: Season, args) -> None:
    """The calendar, then the results and standings of the rounds raced by ``as_of``; what was fetched lately is not asked for again."""
    root, year = season.path("landing"), season.season
    got = fetch.land(season.spark, root, args.base, [("schedule", year, None)])
    done = season.schedule().where(F.col("date") < F.lit(args.as_of).cast("date")).select("round").distinct().collect()  # a season's rounds
    got += fetch.land(season.spark, root, args.base, [(kind, year, r["round"]) for r in done for kind in ("results", "drivers", "constructors")])
    print(f"{got} documents")


def build_session_map(season: Season, args) -> None:
    """Who drove in each session, and who is a regular driver; all rounds at once."""
    mapped = sessions.session_map(landings.session_drivers(season.sessions()), sessions.event_formats(season.schedule()))
    replace_rounds(season.spark, season.path("session_map"), mapped)


def build_features(season: Season, args) -> None:
    """Pace of the session that a weekend's format names, with gaps, suspects and filled teams; testing, if any was landed."""
    laps, formats = season.laps(), sessions.event_formats(season.schedule())
    practice = pace.accurate_laps(landings.pace_session(laps, formats))
    features = gaps.full_features(materialised(pace.pace_features(practice, pace.accurate_laps(laps.where("session_type = 'Q'")))))
    # teams are filled over all rounds before one of them is chosen
    chosen = features if args.round is None else features.where(F.col("round") == args.round)
    replace_rounds(season.spark, season.path("features"), chosen.sortWithinPartitions("season", "round", "driver"))
    testing, keys = landings.testing_laps(season.timing()), ["season", "driver", "team"]
    stored = season.spark.read.parquet(season.path("testing")).where(F.col("season") == season.season) if season.has("testing") else None
    if testing.limit(1).count() and not (stored is not None and not args.force and same_keys(stored, testing, keys)):  # what is stored for the same drivers stays
        paced = pace.trimmed_pace(testing, ["driver", "season", "test_number", "day", "stint"], ["season", "driver", "team"])
        paced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(season.path("testing"))


def _testing(season: Season) -> DataFrame | None:
    if not season.has("testing"):
        return None
    return testing_as_pace(season.spark.read.parquet(season.path("testing")).where(F.col("season") == season.season))


def freeze_history(season: Season, args) -> None:
    schedule = season.schedule()
    guard = point_in_time.Guard(schedule)
    rounds = [args.round] if args.round is not None else sorted(guard.cutoffs)
    mapped = season.session_map() if season.has("session_map") else None
    for round_ in rounds:
        snapshot = Snapshot(season.spark, season.root, season.season, round_)
        if args.rebuild and (args.round is not None or not snapshot.is_past(args.rebuild)):
            snapshot.rebuild(args.rebuild)  # over a season past rounds keep theirs; asked for alone, one is refused
        tables = {f"{kind}_standings": season.standings(kind, round_ - 1) for kind in ("drivers", "constructors") if round_ > 1 and season.has(f"landing/{kind}")}
        freeze_round(snapshot, guard, schedule, season.features(), season.results(), mapped, tables)
    if not args.no_predict:
        model = StrengthModel(args.n_sims, SIMULATION.seed, testing=_testing(season))
        out = walk_forward(season.spark, season.root, season.season, model, guard, rounds, force=args.force)
        for round_, result in out.items():
            print(f"round {round_}: {result if isinstance(result, Exception) else 'predicted'}")


def predict_weekend(season: Season, args) -> None:
    """A round's forecast after its sprint or its qualifying: the frozen snapshot and what the weekend itself showed."""
    guard = point_in_time.Guard(season.schedule())
    snapshot = Snapshot(season.spark, season.root, season.season, args.round)
    if args.step == "post-sprint":
        laps = season.laps().where((F.col("round") == args.round) & (F.col("session_type") == "S"))
        extra, grid = pace.extra_pace(pace.sprint_pace(pace.accurate_laps(laps))), None
    else:
        quali = landings.qualifying_results(season.sessions().where((F.col("round") == args.round) & (F.col("session_type") == "Q")))
        extra, grid = pace.extra_pace(quali), quali.where("quali_pos is not null").select("driver", F.col("quali_pos").alias("grid"))
    extra = materialised(extra)
    if not extra.limit(1).count():
        raise SystemExit(f"round {args.round} has no times for {args.step}")
    model = StrengthModel(args.n_sims, SIMULATION.seed, testing=_testing(season), extra_pace=extra, grid=grid, signal="race" if args.step == "post-sprint" else None)
    Predictions(season.spark, season.root, season.season).save(model.predict(snapshot, args.round, guard), args.round, guard.cutoff(args.round), args.step, model.version, args.force)


def fit_models(season: Season, args) -> None:
    fits = strength.fit_all(season.features(), args.signal, args.min_rounds, as_of_round=args.as_of_round)
    rows = strength.strength_long(fits["driver"], fits["team"], fits["engine"], args.as_of_round).withColumn("season", F.lit(season.season))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "as_of_round").parquet(season.path("strengths"))


def simulate_championship(season: Season, args) -> None:
    fits = season.spark.read.parquet(season.path("strengths")).where((F.col("season") == season.season) & (F.col("as_of_round") == args.as_of_round))
    drivers = season.standings("drivers", args.as_of_round)
    of = lambda kind, key: fits.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(key), "mean", "sd")
    people = season.identities(drivers.select(F.col("driver").alias("id")))
    # a driver's chance is the driver's own strength and the team's
    total = strength.total_strength(of("driver", "driver"), of("team", "team"), people.select("driver", "team"))
    # of several names of one driver the strongest row counts, whole
    known = evaluate.bridged(total, people).groupBy("driver").agg(F.max_by(F.struct("mean", "sd"), F.struct("mean", "sd")).alias("row")).select("driver", "row.*")
    teams = season.results().where(F.col("round") <= args.as_of_round).groupBy("driver").agg(F.max_by("team", "round").alias("team"))
    left = season.schedule().where(F.col("round") > args.as_of_round)
    run = simulate.simulate_season(season.spark, simulate.season_field(drivers, known, teams=teams), left, args.n_sims, seed=args.seed)
    out = f"{season.path('championship')}/{season.season}/as_of_r{args.as_of_round:02d}"
    run.write.mode("overwrite").parquet(f"{out}/seasons")
    results = simulate.championship(season.spark.read.parquet(f"{out}/seasons"), season.standings("constructors", args.as_of_round))
    summary = simulate.championship_summary(results).orderBy("entity_type", F.desc("title_prob"), "entity_id")
    for name, frame in (*results.items(), ("summary", summary)):
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
    best = season.spark.read.parquet(f"{out}/summary")
    best.where("entity_type = 'driver'").orderBy(F.desc("title_prob")).limit(10).show()
    best.where("entity_type = 'constructor'").orderBy(F.desc("title_prob")).limit(10).show()
    Folder(season.spark, out).write("summary.json", {"as_of_round": args.as_of_round, "n_sims": args.n_sims, "seed": args.seed})


def _forecasts(season: Season) -> DataFrame | None:
    stored = Predictions(season.spark, season.root, season.season)
    out = None
    for round_, cutoff in stored.listing():
        frame, meta = stored.load(round_, cutoff)
        frame = frame.withColumns({"round": F.lit(round_), "cutoff": F.lit(cutoff), "cutoff_date": F.lit(meta["cutoff_date"])})
        out = frame if out is None else out.unionByName(frame)
    return out if out is None else evaluate.bridged(out, season.identities(season.results().select(F.col("driver").alias("id"))))


def evaluate_season(season: Season, args) -> None:
    forecast, results = _forecasts(season), season.results()
    if forecast is None:
        raise SystemExit("there are no predictions")
    out = f"{season.path('reports')}/{season.season}"
    forecast = materialised(forecast.where(F.col("cutoff") == args.cutoff))
    per_round = evaluate.evaluate_rounds(forecast, results)
    pairs = evaluate.win_pairs(forecast, results)
    summary = materialised(evaluate.summarize(per_round, pairs))
    frames = {"per_round": per_round.orderBy("round"), "accuracy": evaluate.accuracy(forecast, results).orderBy("round"), "summary": summary, "reliability": evaluate.reliability_diagram(pairs).orderBy("bin")}
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
    Folder(season.spark, out).write("summary.json", summary.first().asDict())


def export_json(season: Season, args) -> None:
    """The page's documents, each a file of its own JSON."""
    forecast, folder = _forecasts(season), Folder(season.spark, season.path("export"))
    folder.write("schedule.json", export.schedule_document(season.schedule(), args.as_of).first().document)
    written = {"season": season.season, "updated_at": args.as_of, "has_predictions": forecast is not None, "has_championship": False, "has_evaluation": season.has(f"reports/{season.season}/summary")}
    available = season.spark.createDataFrame([], "round int, cutoff string")
    if forecast is not None:
        rows = export.driver_rows(forecast, season.results())
        for row in export.predictions_document(rows).toLocalIterator():  # a season's rounds
            folder.write(f"predictions_{row['round']:02d}.json", row.document)
        available = forecast.select("round", "cutoff").distinct()
        written["default_cutoffs"] = {str(r["round"]): r.cutoff for r in export.default_cutoffs(available).collect()}  # a season's rounds
    written["default_round"] = export.default_round(available, season.schedule(), args.as_of).first()["round"]
    titles = Folder(season.spark, f"{season.path('championship')}/{season.season}").names()
    if titles:
        as_of_round = int(titles[-1][-2:])
        summary = season.spark.read.parquet(f"{season.path('championship')}/{season.season}/{titles[-1]}/summary")
        drivers = summary.where("entity_type = 'driver'")
        people = season.identities(drivers.select(F.col("entity_id").alias("id"))).where("id is not null")
        people = people.groupBy(F.col("id").alias("entity_id")).agg(F.max(F.element_at(F.split(F.trim("full_name"), r"\s+"), -1)).alias("display_name"))
        teams = season.results().where(F.col("round") <= as_of_round).groupBy(F.col("driver").alias("entity_id")).agg(F.max_by("team", "round").alias("team"))
        named = drivers.join(people, "entity_id", "left").join(teams, "entity_id", "left").withColumn("display_name", F.coalesce("display_name", "entity_id"))
        document = export.championship_document(named, summary.where("entity_type = 'constructor'"), as_of_round).first().document
        folder.write(f"championship_{season.season}.json", document)
        written |= {"has_championship": True, "championship_round": as_of_round}
    if written["has_evaluation"]:
        read = lambda name: season.spark.read.parquet(f"{season.path('reports')}/{season.season}/{name}")
        folder.write("evaluation.json", export.evaluation_document(read("summary"), read("per_round")).first().document)
    folder.write("manifest.json", written)


def last_round(season: Season, args) -> None:
    print(point_in_time.last_completed(season.schedule(), args.as_of).first().last_round)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stintline")
    top.add_argument("--root", required=True)
    top.add_argument("--season", type=int, required=True)
    steps = top.add_subparsers(dest="step", required=True)

    def step(name, run, **options):
        sub = steps.add_parser(name)
        sub.set_defaults(run=run)
        for key, how in options.items():
            sub.add_argument("--" + key.replace("_", "-"), **how)

    whole, flag, need = {"type": int, "default": None}, {"action": "store_true"}, {"type": int, "required": True}
    sims = {"type": int, "default": SIMULATION.n_sims}
    step("ingest", ingest, base={"required": True}, as_of={"required": True})
    step("session-map", build_session_map)
    step("features", build_features, round=whole, force=flag)
    step("freeze", freeze_history, round=whole, force=flag, no_predict=flag, n_sims=sims, rebuild={"default": None, "metavar": "AS_OF"})
    for name in ("post-sprint", "post-q"):
        step(name, predict_weekend, round=need, force=flag, n_sims=sims)
    step("fit", fit_models, as_of_round=need, signal={"choices": ["quali", "race"], "default": "quali"}, min_rounds={"type": int, "default": 1})
    step("championship", simulate_championship, as_of_round=need, n_sims=sims, seed={"type": int, "default": SIMULATION.seed})
    step("evaluate", evaluate_season, cutoff={"choices": ["pre-fp1", "post-sprint", "post-q"], "default": "pre-fp1"})
    step("export", export_json, as_of={"required": True})
    step("last-round", last_round, as_of={"required": True})
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if "n_sims" in args:
        replace(SIMULATION, n_sims=args.n_sims)  # refuses fewer than the rules allow
    spark = SparkSession.builder.appName(f"stintline-{args.step}").getOrCreate()
    args.run(Season(spark, args.root, args.season), args)


if __name__ == "__main__":
    main(sys.argv[1:])
