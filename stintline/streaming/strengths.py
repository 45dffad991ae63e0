"""Team names and strength moments kept current as features arrive, in keyed state.

Two streams follow each other. The first holds each driver's rounds and fills missing teams; the second holds each team's drivers of a round and
what they add to the strengths' moments. Both send changes: what a later row makes untrue is taken back with n = -1, so rounds may arrive in any order and
in pieces, and the sum of all changes is what a batch job over all rows finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stintline.operators.moments import KEYS

TEAM_CHANGES = "season int, round int, driver string, team string, x double, inside boolean, n int"
DRIVER_ROUNDS = "season int, round int, team string, x double, inside boolean"
TEAM_DRIVERS = "driver string, x double, inside boolean, n int"
MOMENT_CHANGES = "season int, round int, entity_type string, entity_id string, n int, sum double, squares double"
STATES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _null(value):
    return None if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA else value


def _named(team) -> bool:
    return _null(team) is not None and str(team).strip() != ""


class TeamHistory(StatefulProcessor):
    """A driver's rounds so far, as many as the calendar has. A missing team is the last named one before, else the next one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getListState("rounds", DRIVER_ROUNDS)

    @staticmethod
    def filled(rows: list[tuple]) -> list[tuple]:
        named = [r[2] for r in rows if _named(r[2])]
        out, last = [], named[0] if named else None
        for season, round_, team, x, inside in rows:
            last = team if _named(team) else last
            out.append((season, round_, last, x, inside))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        before = [tuple(_null(v) for v in r) for r in self.rounds.get()]
        new = [tuple(_null(v) for v in r) for df in rows for r in df[["season", "round", "team", "x", "inside"]].itertuples(index=False, name=None)]
        new = [(int(s), int(r), t, x, bool(i)) for s, r, t, x, i in new]
        after = sorted([*before, *new], key=lambda r: (r[0], r[1], str(r[2]), -1.0 if r[3] is None else r[3]))
        self.rounds.put(after)
        changes: dict[tuple, int] = {}
        for sign, listed in ((-1, self.filled(before)), (1, self.filled(after))):
            for r in listed:
                changes[r] = changes.get(r, 0) + sign
        found = [(s, r, key[0], t, x, i, n) for (s, r, t, x, i), n in changes.items() if n]
        yield pd.DataFrame(found, columns=["season", "round", "driver", "team", "x", "inside", "n"])

    def close(self) -> None:
        pass


class TeamRound(StatefulProcessor):
    """A team's drivers in one round, and what they add to the moments of drivers and team."""

    def __init__(self, suspect_s: float | None):
        self.suspect_s = suspect_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.drivers = handle.getListState("drivers", TEAM_DRIVERS)

    def contributions(self, team: str, held: list[tuple]) -> list[tuple[str, str, float]]:
        """(entity_type, entity_id, value): with exactly two times too far apart the slower is left out; a driver counts beside a team mate."""
        times = [x for _, x, _ in held if x is not None]
        limit = max(times) if self.suspect_s is not None and len(times) == 2 and max(times) - min(times) > self.suspect_s else None
        used = [(d, x) for d, x, inside in held if x is not None and inside and x != limit]
        if not used:
            return []
        own = [(d, x) for d, x in used if d is not None]
        mean = math.fsum(x for _, x in own) / len(own) if own else 0.0
        speeds = [("driver", d, mean - x) for d, x in own] if len(own) >= 2 else []
        return [*speeds, ("team", team, math.fsum(x for _, x in used) / len(used))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        season, round_, team = key
        counts: dict[tuple, int] = {}
        for *row, n in self.drivers.get():
            counts[tuple(_null(v) for v in row)] = n
        before = dict(counts)
        for df in rows:
            for driver, x, inside, n in df[["driver", "x", "inside", "n"]].itertuples(index=False, name=None):
                at = (_null(driver), _null(x), bool(inside))
                counts[at] = counts.get(at, 0) + int(n)
        self.drivers.put([(*at, n) for at, n in counts.items() if n])
        listed = lambda held: sorted((at for at, n in held.items() for _ in range(n)), key=str)
        found = []
        for sign, held in ((-1, before), (1, counts)):
            found += [(season, round_, kind, name, sign, sign * x, sign * x * x) for kind, name, x in self.contributions(team, listed(held))]
        yield pd.DataFrame(found, columns=["season", "round", "entity_type", "entity_id", "n", "sum", "squares"])

    def close(self) -> None:
        pass


@contextmanager
def _kept_in_rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which this kind of state needs; the session's own setting comes back."""
    before = spark.conf.get(STATES, None)
    spark.conf.set(STATES, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STATES) if before is None else spark.conf.set(STATES, before)


def _drain(rows: DataFrame, folder: str, name: str) -> None:
    """To a Parquet sink, whose log counts each batch once, until no file is left. Started again it goes on where it ended."""
    sink = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-checkpoint")
    sink.trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination()


def follow(spark: SparkSession, features: str, folder: str, column: str, limits: DataFrame | None = None, suspect_s: float | None = None, files_per_batch: int = 1) -> None:
    """Take the feature files that have come to ``features`` since the last call into ``folder``'s tables and state.

    Features have season, round, driver, team and ``column``; ``limits`` (round, most) leaves slower times out of a round, ``suspect_s`` the slower of two
    team mates that far apart. ``folder`` lies in a store that driver and executors share.
    """
    schema = spark.read.parquet(features).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(features)
    if limits is not None:
        stream = stream.join(limits.select("round", F.col("most").alias("__most")), "round", "left")
    inside = F.coalesce(F.col(column) <= F.col("__most"), F.lit(False)) if limits is not None else F.lit(True)
    rows = stream.select(
        F.col("season").cast("int").alias("season"), F.col("round").cast("int").alias("round"), F.col("driver").cast("string").alias("driver"),
        F.col("team").cast("string").alias("team"), F.col(column).cast("double").alias("x"), inside.alias("inside"),
    )
    with _kept_in_rocks(spark):
        changes = rows.where("driver is not null").groupBy("driver").transformWithStateInPandas(TeamHistory(), TEAM_CHANGES, "append", "none")
        _drain(changes, folder, "teams")
        named = spark.readStream.schema(TEAM_CHANGES).parquet(f"{folder}/teams").where("trim(team) <> ''")
        moved = named.groupBy("season", "round", "team").transformWithStateInPandas(TeamRound(suspect_s), MOMENT_CHANGES, "append", "none")
        _drain(moved, folder, "moments")


def filled_teams(spark: SparkSession, folder: str) -> DataFrame:
    """(season, round, driver, team) of all rows so far, missing teams filled; repeated rows are repeated."""
    summed = spark.read.schema(TEAM_CHANGES).parquet(f"{folder}/teams").groupBy("season", "round", "driver", "team", "x", "inside").agg(F.sum("n").alias("n"))
    return summed.where("n > 0").select("season", "round", "driver", "team", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")


def streamed_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The moments of all rows so far, as ``moments.round_moments`` gives them."""
    n, total = F.sum("n"), F.sum("sum")
    summed = spark.read.schema(MOMENT_CHANGES).parquet(f"{folder}/moments").groupBy(*KEYS).agg(n.alias("n"), total.alias("sum"), F.sum("squares").alias("squares"))
    rows = summed.where("n > 0")
    return rows.select(*KEYS, "n", "sum", F.greatest(F.col("squares") - F.col("sum") * F.col("sum") / F.col("n"), F.lit(0.0)).alias("m2"))
