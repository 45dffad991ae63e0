"""Monte Carlo of races and seasons, in long form: one row a simulation, race and driver.

Draws come from hashes of their keys, so results do not depend on partitions or retries. A field of
drivers is small (``max_entrants``) and goes to all tasks behind that check; simulations spread over
the cluster. Rows are dealt by ``sim_id`` once; the order of a race, its points and the season's
sums all work within that dealing.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.functions.random import gumbel, normal, spawn, uniform, uniforms, words
from stintline.functions.scalars import points
from stintline.rules import RACE_POINTS, SIMULATION, SPRINT_POINTS, ChaosRules, SimulationRules

#: A field (or a list of races) of up to this many rows may be sent to every task.
SMALL_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, given only if the table really is small (counted at once)."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def field_facts(field: DataFrame):
    """In one job: the number of entrants and the ranges of their retirement rates and spreads."""
    column = lambda c: F.col(c) if c in field.columns else F.lit(None).cast("double")
    return field.agg(
        F.count(F.lit(1)).alias("n"), F.min(column("dnf")).alias("low"), F.max(column("dnf")).alias("high"), F.min(column("sd")).alias("sd_low"), F.max(column("sd")).alias("sd_high")
    ).first()


def check_entrants(facts, most: int | None = SIMULATION.max_entrants) -> int:
    """The number of entrants: 1 to ``most``, with retirement rates in [0, 1]; else ValueError."""
    if not facts.n or (most is not None and facts.n > most):
        raise ValueError(f"a field has 1 to {most} drivers, not {facts.n}")
    if facts.low is not None and (facts.low < 0 or facts.high > 1):
        raise ValueError("a retirement rate lies outside [0, 1]")
    return facts.n


def grid_penalised(field: DataFrame, rules: SimulationRules = SIMULATION) -> DataFrame:
    """``mean`` less the weight of lost grid places (half as much again from the pit lane)."""
    lost = F.coalesce(F.col("penalty_positions"), F.lit(0)) * F.lit(rules.grid_weight)
    extra = F.when(F.coalesce(F.col("pit_lane"), F.lit(False)), 1 + rules.pit_lane_extra).otherwise(1.0)
    return field.withColumn("mean", F.col("mean") - lost * extra)


def simulations(spark: SparkSession, n_sims: int, first: int = 0) -> DataFrame:
    """(sim_id) from ``first`` on, dealt by simulation before anything is multiplied by it, so that orders, sums and titles need no exchange."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return spark.range(first, first + n_sims).withColumnRenamed("id", "sim_id").repartition(tasks, "sim_id")


def draws(spark: SparkSession, field: DataFrame, entrants: int, races: DataFrame, n_races: int, n_sims: int, season_seed: int | None = None, first: int = 0) -> DataFrame:
    """Every simulation x race x driver. Fields and calendars are small; they are sent to all tasks only if they are.

    With ``season_seed`` what a driver draws once a season is drawn before races multiply the rows.
    """
    hint = F.broadcast if entrants * n_races <= SMALL_ROWS else (lambda x: x)
    if season_seed is not None:
        return _season_draws(simulations(spark, n_sims, first).crossJoin(hint(field)), season_seed).crossJoin(hint(races))
    return simulations(spark, n_sims, first).crossJoin(hint(races.crossJoin(hint(field))))


#: Streams of the counter-based engine.
RACE_STREAM, SEASON_STREAM, CHAOS_STREAM = 0, 1, 2


def _season_draws(rows: DataFrame, seed: int) -> DataFrame:
    """Two uniforms for each simulation and driver, for the whole season; before races multiply the rows."""
    counter = [F.col("sim_id"), F.lit(0), *words(F.col("driver"), dict(rows.dtypes)["driver"])]
    return uniforms(rows, spawn(seed, SEASON_STREAM), counter, ["__dev1", "__dev2", "__dev3", "__dev4"]).drop("__dev3", "__dev4")


def _race_draws(rows: DataFrame, seed: int, chaos: bool, develop: bool) -> DataFrame:
    """Four uniforms for each simulation, race and driver, from one block; two more for each race under chaos."""
    if develop and "__dev1" not in rows.columns:
        rows = _season_draws(rows, seed)
    if chaos:
        block = [F.col("sim_id"), F.col("race_no"), F.lit(0), F.lit(0)]
        rows = uniforms(rows, spawn(seed, CHAOS_STREAM), block, ["__car", "__rain", "__c3", "__c4"]).drop("__c3", "__c4")
    counter = [F.col("sim_id"), F.col("race_no"), *words(F.col("driver"), dict(rows.dtypes)["driver"])]
    return uniforms(rows, spawn(seed, RACE_STREAM), counter, ["__order", "__dnf", "__post1", "__post2"])


def race_orders(
    rows: DataFrame, rules: SimulationRules = SIMULATION, seed: int | None = None, chaos: ChaosRules | None = None, sample: bool = False, develop: bool = False, engine: str = "xxhash64"
) -> DataFrame:
    """Add ``dnf_flag``, ``pos`` and ``points`` to rows of (sim_id, race, driver, mean, sd, dnf, is_sprint).

    Strength plus Gumbel noise gives the order (Plackett and Luce); retired drivers come last, in that
    order among themselves, and score nothing. ``sample`` draws each strength from its posterior,
    ``develop`` adds one offset a simulation and driver for the whole season. ``chaos`` draws a safety
    car and rain for each simulation and race: both widen the noise, rain pulls strengths
    towards the field's mean, and everybody retires a little more often. The engine ``philox`` also needs ``race_no``,
    a number of 32 bits for each race.
    """
    seed = rules.seed if seed is None else seed
    if engine == "philox":
        rows = _race_draws(rows, seed, chaos is not None, develop)
        u = lambda what, *key: F.col(f"__{what}")
    else:
        u = lambda what, *key: uniform(F.lit(seed), F.lit(what), *[F.col(k) for k in key], engine=engine)
    mean, noise, dnf = F.col("mean"), F.lit(rules.noise), F.coalesce(F.col("dnf"), F.lit(rules.default_dnf))
    if chaos is not None:
        car, rain = u("car", "sim_id", "race") < chaos.safety_car, u("rain", "sim_id", "race") < chaos.rain
        centre = F.col("field_mean")
        mean = F.when(rain, centre + (mean - centre) * chaos.rain_compression).otherwise(mean)
        noise = noise * F.when(car, chaos.safety_car_noise).otherwise(1.0) * F.when(rain, chaos.rain_noise).otherwise(1.0)
        dnf = F.least(F.greatest(dnf + chaos.extra_dnf, F.lit(0.0)), F.lit(1.0))
    if sample:
        mean = mean + normal(u("post1", "sim_id", "race", "driver"), u("post2", "sim_id", "race", "driver")) * F.greatest(F.col("sd"), F.lit(1e-9))
    if develop:
        mean = mean + normal(u("dev1", "sim_id", "driver"), u("dev2", "sim_id", "driver")) * rules.development_sd
    raced = rows.withColumns(
        {"speed": mean + gumbel(u("order", "sim_id", "race", "driver")) * noise, "dnf_flag": u("dnf", "sim_id", "race", "driver") < dnf}
    )
    order = Window.partitionBy("sim_id", "race").orderBy("dnf_flag", F.round("speed", 9).desc(), "driver")
    drawn = [c for c in raced.columns if c.startswith("__")]
    placed = raced.drop(*drawn).withColumn("pos", F.row_number().over(order))
    return placed.withColumn("points", score(F.col("pos"), F.col("dnf_flag"), F.col("is_sprint")))


def score(pos: Column, retired: Column, is_sprint: Column) -> Column:
    table = F.when(is_sprint, points(pos, SPRINT_POINTS)).otherwise(points(pos, RACE_POINTS))
    return F.when(retired, 0.0).otherwise(table)


def with_field_mean(field: DataFrame) -> DataFrame:
    """Add the mean of the field's strengths (what rain pulls towards)."""
    return field.crossJoin(F.broadcast(field.agg(F.avg("mean").alias("field_mean"))))  # one row


def one_race(spark: SparkSession, name: str = "race", is_sprint: bool = False) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("race"), F.lit(crc32(name.encode())).cast("bigint").alias("race_no"), F.lit(is_sprint).alias("is_sprint"))


def simulate_race(
    spark: SparkSession, field: DataFrame, n_sims: int = SIMULATION.n_sims, race: str = "race", is_sprint: bool = False, rules: SimulationRules = SIMULATION,
    seed: int | None = None, chaos: ChaosRules | None = None, sample: bool = False, develop: bool = False, engine: str = "xxhash64", most: int | None = SIMULATION.max_entrants,
) -> DataFrame:
    """Orders of ``n_sims`` simulations of one race; ``field`` has (driver, mean) and may have sd, dnf, penalty_positions and pit_lane."""
    entrants = check_entrants(field_facts(field), most)
    for name, kind in (("sd", "double"), ("dnf", "double"), ("penalty_positions", "int"), ("pit_lane", "boolean")):
        if name not in field.columns:
            field = field.withColumn(name, F.lit(0.0 if name == "dnf" else None).cast(kind))
    field = grid_penalised(with_field_mean(field), rules)
    return race_orders(draws(spark, field, entrants, one_race(spark, race, is_sprint), 1, n_sims), rules, seed, chaos, sample, develop, engine)


def race_summary(orders: DataFrame) -> DataFrame:
    """(driver, win_prob, podium_prob, top10_prob, dnf_prob, expected_points); one row of partial sums a task and driver is shuffled."""
    share = lambda c: F.avg(c.cast("double"))
    return orders.groupBy("driver").agg(
        share(F.col("pos") == 1).alias("win_prob"),
        share(F.col("pos") <= 3).alias("podium_prob"),
        share(F.col("pos") <= 10).alias("top10_prob"),
        share(F.col("dnf_flag")).alias("dnf_prob"),
        F.avg("points").alias("expected_points"),
    )


def finish_distribution(orders: DataFrame) -> DataFrame:
    """(driver, finish_pos, probability), zeros included."""
    seen = orders.groupBy("driver", F.col("pos").alias("finish_pos")).agg(F.count(F.lit(1)).alias("n"))
    drivers = seen.groupBy("driver").agg(F.sum("n").alias("sims"))
    last = seen.agg(F.max("finish_pos").alias("last"))
    grid = drivers.crossJoin(F.broadcast(last)).withColumn("finish_pos", F.explode(F.sequence(F.lit(1), F.col("last"))))  # one row
    return grid.join(seen, ["driver", "finish_pos"], "left").select(
        "driver", "finish_pos", (F.coalesce("n", F.lit(0)) / F.col("sims").cast("double")).alias("probability")
    )


def races_of(schedule: DataFrame) -> DataFrame:
    """(race, race_no, round, is_sprint): a race a round, and before it a sprint where the round has one."""
    kinds = F.when(F.col("has_sprint"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = schedule.select("round", F.explode(kinds).alias("is_sprint"))
    number = F.col("round").cast("bigint") * 2 + F.col("is_sprint").cast("bigint")
    return rows.withColumns({"race": F.concat(F.col("round").cast("string"), F.when(F.col("is_sprint"), "s").otherwise("r")), "race_no": number})


def season_points(orders: DataFrame, *facts: str) -> DataFrame:
    """(sim_id, driver, facts, sim_points) over all races; ``facts`` are columns that depend on the driver alone."""
    return orders.groupBy("sim_id", "driver", *facts).agg(F.sum("points").alias("sim_points"))


def season_field(standings: DataFrame, strengths: DataFrame, dnf: DataFrame | None = None, teams: DataFrame | None = None, rules: SimulationRules = SIMULATION) -> DataFrame:
    """(driver, standing, start_points, mean, sd, dnf, team): the standings' drivers; unknown strength is 0 with a wide spread."""
    rows = standings.select("driver", F.col("position").alias("standing"), F.col("points").alias("start_points"))
    rows = rows.join(strengths.select("driver", "mean", "sd"), "driver", "left")
    rows = rows.withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "sd": F.coalesce("sd", F.lit(rules.unknown_sd))})
    rows = rows.join(dnf.select("driver", "dnf"), "driver", "left") if dnf is not None else rows.withColumn("dnf", F.lit(None).cast("double"))
    rows = rows.withColumn("dnf", F.coalesce("dnf", F.lit(rules.default_dnf)))
    return rows.join(teams.select("driver", "team"), "driver", "left") if teams is not None else rows.withColumn("team", F.lit(None).cast("string"))


def simulate_season(
    spark: SparkSession, field: DataFrame, schedule: DataFrame, n_sims: int = SIMULATION.n_sims, rules: SimulationRules = SIMULATION,
    seed: int | None = None, chaos: ChaosRules | None = None, engine: str = "xxhash64", sample: bool | None = None, develop: bool = True, most: int | None = SIMULATION.max_entrants, first_sim: int = 0,
) -> DataFrame:
    """(sim_id, driver, team, standing, start_points, sim_points) over the rounds of ``schedule``.

    Strengths are drawn from their posterior unless every one of them is unknown. Without
    rounds each simulation ends as the standings are; without drivers the result is empty.
    """
    facts = field_facts(field)
    if sample is None:
        sample = not (facts.sd_low == rules.unknown_sd == facts.sd_high)
    races = races_of(schedule)
    n_races = races.count()  # a calendar
    if not facts.n or not n_races:
        hint = F.broadcast if facts.n <= SMALL_ROWS else (lambda x: x)
        known = field.select("driver", "team", "standing", "start_points", F.lit(0.0).alias("sim_points"))
        return simulations(spark, n_sims, first_sim).crossJoin(hint(known))
    by_counter = (rules.seed if seed is None else seed) if engine == "philox" and develop else None
    rows = draws(spark, with_field_mean(field), check_entrants(facts, most), races, n_races, n_sims, by_counter, first_sim)
    orders = race_orders(rows, rules, seed, chaos, sample, develop, engine)
    return season_points(orders, "team", "standing", "start_points")


def title_probability(season: DataFrame) -> DataFrame:
    """(driver, title_prob, expected_points, expected_added); ties go to the better standing."""
    total = F.round(F.col("start_points") + F.col("sim_points"), 6)
    order = Window.partitionBy("sim_id").orderBy(total.desc(), "standing", "driver")
    ranked = season.withColumns({"total": total, "place": F.row_number().over(order)})
    return ranked.groupBy("driver").agg(
        F.avg((F.col("place") == 1).cast("double")).alias("title_prob"), F.avg("total").alias("expected_points"), F.avg("sim_points").alias("expected_added")
    )


def constructor_title(season: DataFrame, constructors: DataFrame) -> DataFrame:
    """(team, title_prob, expected_points) from ``constructors`` (team, position, points); drivers without a team do not count."""
    added = season.where(F.col("team").isNotNull()).groupBy("sim_id", "team").agg(F.sum("sim_points").alias("added"))
    sims = season.select("sim_id").distinct()
    rows = sims.crossJoin(small(constructors.select("team", F.col("position").alias("standing"), F.col("points").alias("start"))))
    rows = rows.join(added, ["sim_id", "team"], "left").withColumn("total", F.round(F.col("start") + F.coalesce("added", F.lit(0.0)), 6))
    place = F.row_number().over(Window.partitionBy("sim_id").orderBy(F.desc("total"), "standing", "team"))
    return rows.withColumn("place", place).groupBy("team").agg(F.avg((F.col("place") == 1).cast("double")).alias("title_prob"), F.avg("total").alias("expected_points"))


def magic_numbers(standings: DataFrame, rounds_left: int, rules: SimulationRules = SIMULATION) -> DataFrame:
    """(driver, magic_number): points ahead of the best other driver's greatest possible total; null for a driver alone."""
    best = standings.agg(F.max("points").alias("best"), F.max_by("driver", F.struct("points", F.col("driver"))).alias("who"))
    second = standings.join(F.broadcast(best), F.col("driver") != F.col("who"), "inner").agg(F.max("points").alias("second"))  # one row
    rows = standings.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(second))
    other = F.when(F.col("driver") == F.col("who"), F.col("second")).otherwise(F.col("best"))
    return rows.select("driver", (F.col("points") - (other + rounds_left * rules.max_points_per_round)).alias("magic_number"))


def championship(season: DataFrame, constructors: DataFrame) -> dict[str, DataFrame]:
    """All results of simulated seasons: ``drivers`` and ``constructors`` (with title chance and expected points), and ``points``, each driver's distribution."""
    points = season.groupBy("driver", F.round(F.col("start_points") + F.col("sim_points"), 6).alias("points")).agg(F.count(F.lit(1)).alias("n"))
    return {"drivers": title_probability(season), "constructors": constructor_title(season, constructors), "points": points}


def championship_summary(results: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, title_prob, expected_points) of drivers and constructors."""
    rows = lambda df, kind, key: df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), "title_prob", "expected_points")
    return rows(results["drivers"], "driver", "driver").unionByName(rows(results["constructors"], "constructor", "team"))
