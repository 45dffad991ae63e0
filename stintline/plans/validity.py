"""Rules as tables with the seasons they hold for, and constraints as queries: one row for each violation.

A rule table is long: (rule, key, value, first_season, last_season), the last season open where it is null. It comes from the package's own
fixed values or from a landed file, and what a season's model or simulation uses is read from it only after it was checked.
"""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.rules import ALLOCATIONS, COMPONENTS, PACE, PENALTY, RACE_POINTS, SIMULATION, SPRINT_POINTS, STRENGTH

RULES = "rule string, key string, value double, first_season int, last_season int"
CALENDAR = "season int, round int, circuit_id string, date date, weekend_format string, downforce_level string, overtaking string, tyre_deg string"
# The values that the columns of a calendar may have.
DOMAINS = {
    "weekend_format": ("normal", "sprint"), "downforce_level": ("low", "medium", "high"), "overtaking": ("easy", "medium", "hard"), "tyre_deg": ("low", "medium", "high"),
}
#: Dataclasses whose numbers may come from rules named group.field.
GROUPS = {"pace": PACE, "strength": STRENGTH, "penalty": PENALTY, "simulation": SIMULATION}


def own_rules(spark: SparkSession) -> DataFrame:
    """The rule table of the package's own values: points from 2025 on, allocations by season (the last one stays), constants of the models."""
    rows = [("points.race", str(p), float(v), 2025, None) for p, v in RACE_POINTS.items()] + [("points.sprint", str(p), float(v), 2025, None) for p, v in SPRINT_POINTS.items()]
    rows.append(("points.fastest_lap", "", 0.0, 2025, None))
    seasons = sorted(ALLOCATIONS)
    for season, later in zip(seasons, [*seasons[1:], None]):
        rows += [("allocation", c, float(n), season, None if later is None else later - 1) for c, n in ALLOCATIONS[season].items()]
    for group, rules in GROUPS.items():
        rows += [(f"{group}.{f.name}", "", float(v), 2025, None) for f in fields(rules) if isinstance(v := getattr(rules, f.name), (int, float))]
    return spark.createDataFrame(rows, RULES)


def landed_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON lines; what cannot be read is null and is a violation."""
    return spark.read.schema(RULES).json(path)


def of_season(rules: DataFrame, season: int) -> DataFrame:
    """(rule, key, value) of the rules that hold in a season."""
    return rules.where((F.col("first_season") <= season) & (F.coalesce("last_season", F.lit(season)) >= season)).select("rule", "key", "value")


def _violation(rows: DataFrame, constraint: str, subject: Column) -> DataFrame:
    return rows.select(F.lit(constraint).alias("constraint"), subject.cast("string").alias("subject"))


def rule_violations(rules: DataFrame) -> DataFrame:
    """(constraint, subject) of a rule table; empty if it may be used.

    * complete: rule, value and first season are there, and the last season is not before the first;
    * overlap: two rows of one rule and key hold in one season (a repeated row does);
    * points: race and sprint points cover places 1 to n without a gap (n = 8 in sprints), fall from place to place, and there is none for the fastest lap;
    * allocation: every component, none negative; simulation: 1000 simulations or more; no negative spread or limit.
    """
    named = F.concat_ws("/", "rule", "key", "first_season")
    at = Window.partitionBy("rule", "key").orderBy("first_season", F.col("last_season").asc_nulls_last())
    open_end = F.coalesce("last_season", F.lit(1 << 30))
    ends = F.max(open_end).over(at.rowsBetween(Window.unboundedPreceding, -1))
    points = rules.where("rule in ('points.race', 'points.sprint')").withColumn("place", F.col("key").try_cast("int"))
    table = Window.partitionBy("rule", "first_season").orderBy("place")
    in_turn = points.withColumns({"nth": F.row_number().over(table), "better": F.lag("value").over(table)})
    sprint = points.where("rule = 'points.sprint'").groupBy("first_season").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    held = rules.where("rule = 'allocation'").groupBy("first_season").agg(F.collect_set("key").alias("have"))
    lacking = held.select("first_season", F.explode(F.array_except(F.array(*[F.lit(c) for c in COMPONENTS]), "have")).alias("component"))
    found = [
        _violation(rules.where("rule is null or value is null or first_season is null or last_season < first_season"), "complete", named),
        _violation(rules.withColumn("__ends", ends).where("first_season <= __ends"), "overlap", named),
        _violation(in_turn.where("place is null or place <> nth"), "points without gaps", named),
        _violation(in_turn.where("value >= better or value <= 0"), "points fall", named),
        _violation(sprint.where("last is null or last <> 8 or n <> 8"), "eight sprint places", F.col("first_season")),
        _violation(rules.where("rule = 'points.fastest_lap' and value <> 0"), "no point for the fastest lap", named),
        _violation(lacking, "every component", F.concat_ws("/", "component", "first_season")),
        _violation(rules.where("rule = 'allocation' and value < 0 or value < 0 and (rule like '%sd' or rule like '%noise' or rule like '%_s')"), "not negative", named),
        _violation(rules.where("rule = 'simulation.n_sims' and value < 1000"), "1000 simulations", named),
    ]
    return reduce(DataFrame.unionByName, found)


def calendar_violations(calendar: DataFrame, rounds: int | None = None, sprints: list[int] | None = None) -> DataFrame:
    """(constraint, subject) of calendars, all seasons at once: rounds from 1 on without gaps or repeats, in the order of their dates, circuits once a season, known words.

    ``rounds`` and ``sprints`` are the number of rounds and the sprint rounds that each season should have.
    """
    named = F.concat_ws("/", "season", "round")
    season = Window.partitionBy("season").orderBy("round", "date")
    in_turn = calendar.withColumns({"nth": F.row_number().over(season), "before": F.lag("date").over(season)})
    found = [
        _violation(in_turn.where("round is null or round <> nth"), "rounds without gaps", named),
        _violation(in_turn.where("date is null or date <= before"), "dates in order", named),
        _violation(calendar.groupBy("season", "circuit_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or circuit_id is null"), "circuits once", F.concat_ws("/", "season", "circuit_id")),
        *[_violation(calendar.where(~F.coalesce(F.col(c).isin(*words), F.lit(False))), c, named) for c, words in DOMAINS.items()],
    ]
    if rounds is not None:
        found.append(_violation(calendar.groupBy("season").agg(F.count_distinct("round").alias("n")).where(F.col("n") != rounds), "number of rounds", F.col("season")))
    if sprints is not None:
        is_sprint, wanted = F.col("weekend_format") == "sprint", F.col("round").isin(*sprints)
        found.append(_violation(calendar.where(F.coalesce(is_sprint, F.lit(False)) != wanted), "sprint rounds", named))
    return reduce(DataFrame.unionByName, found)


def refuse(violations: DataFrame, most: int = 20) -> None:
    """ValueError that names violations (the first ``most`` of them), if there are any."""
    rows = violations.limit(most).collect()
    if rows:
        raise ValueError("; ".join(f"{r.constraint}: {r.subject}" for r in rows))


def season_rules(rules: DataFrame, season: int) -> dict:
    """The dataclasses of GROUPS with a season's values, and ``points`` and ``allocations``; ValueError if the table breaks a constraint."""
    refuse(rule_violations(rules))
    rows = of_season(rules, season).collect()  # a rule book
    out: dict = {g: replace(own, **_values(own, {r.rule: r.value for r in rows}, g)) for g, own in GROUPS.items()}
    for name in ("race", "sprint"):
        out[f"{name}_points"] = {int(r.key): int(r.value) for r in rows if r.rule == f"points.{name}"}
    return out | {"allocations": {r.key: int(r.value) for r in rows if r.rule == "allocation"}}


def _values(own, known: dict[str, float], group: str) -> dict:
    """The group's fields that the rules give, in their own types."""
    return {f.name: type(getattr(own, f.name))(known[f"{group}.{f.name}"]) for f in fields(own) if f"{group}.{f.name}" in known}
