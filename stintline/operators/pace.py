"""Pace from laps: validity, stints, fuel, outliers, long runs, best laps.

Laps carry ``driver``, ``team``, ``stint``, ``lap_number``, ``lap_s``, ``tyre_life`` and the keys of
their session (``season``, ``round`` by default). All rounds go through one plan; the windows of a
stint share one exchange, since they are all dealt by session, driver and stint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintline.functions.scalars import is_green
from stintline.rules import PACE

SESSION = ["season", "round"]
LAP_ORDER = ["lap_number", "lap_s"]


def accurate_laps(laps: DataFrame) -> DataFrame:
    return laps.where("is_accurate")


def valid_laps(laps: DataFrame, min_lap_s: float = PACE.min_lap_s) -> DataFrame:
    return laps.where(F.col("lap_s") > min_lap_s)


def green_laps(laps: DataFrame) -> DataFrame:
    """Laps under a clear track; all of them if the status is not known."""
    return laps.where(is_green(F.col("track_status"))) if "track_status" in laps.columns else laps


def _stint(session: list[str]) -> list[str]:
    return [*session, "driver", "stint"]


def long_stints(laps: DataFrame, session: list[str] = SESSION, min_laps: int = PACE.min_long_run_laps) -> DataFrame:
    """Laps of stints with at least ``min_laps`` laps that have a time."""
    n = F.count("lap_s").over(Window.partitionBy(*_stint(session)))
    return laps.withColumn("stint_laps", n).where(F.col("stint_laps") >= min_laps).drop("stint_laps")


def fuel_corrected(
    laps: DataFrame, session: list[str] = SESSION, age: str = "tyre_life", kg: float = PACE.fuel_kg_per_lap, s_per_kg: float = PACE.seconds_per_kg, order: list[str] = LAP_ORDER
) -> DataFrame:
    """Add ``corrected_s``: the time less what the fuel for the rest of the stint costs.

    ``age`` is ``tyre_life``, ``rank`` (a lap's rank in its stint) or ``auto``: the rank where no lap
    of the whole frame has a tyre life.
    """
    whole = Window.partitionBy(*_stint(session))
    life, rank = F.col("tyre_life"), F.row_number().over(whole.orderBy(*order))
    if age == "auto":
        known = laps.agg(F.coalesce(F.max(F.col("tyre_life").isNotNull()), F.lit(False))).first()[0]
        age = "tyre_life" if known else "rank"
    own, last = (life, F.max("tyre_life").over(whole)) if age == "tyre_life" else (rank, F.count(F.lit(1)).over(whole))
    rest = F.greatest(last - own, F.lit(0)).cast("double") * F.lit(kg) * F.lit(s_per_kg)
    return laps.withColumn("corrected_s", F.col("lap_s") - rest)


def drop_slow_outliers(laps: DataFrame, session: list[str] = SESSION, value: str = "corrected_s", factor: float = PACE.iqr_factor) -> DataFrame:
    """Without laps above the third quartile by more than ``factor`` interquartile ranges of their stint."""
    whole = Window.partitionBy(*_stint(session))
    bound = F.expr(f"percentile({value}, 0.75)").over(whole) * (1 + factor) - F.expr(f"percentile({value}, 0.25)").over(whole) * factor
    return laps.withColumn("bound", bound).where(F.col(value) <= F.col("bound")).drop("bound")


def long_run_pace(laps: DataFrame, session: list[str] = SESSION, min_laps: int = PACE.min_long_run_laps, age: str = "tyre_life", order: list[str] = LAP_ORDER) -> DataFrame:
    """(session, driver, team, long_run_pace_s, long_run_n): median fuel-corrected time over long green stints."""
    kept = long_stints(valid_laps(green_laps(laps)), session, min_laps)
    kept = fuel_corrected(kept, session, age, order=order).where(F.col("corrected_s").isNotNull())
    kept = drop_slow_outliers(kept, session)
    return kept.groupBy(*session, "driver").agg(
        F.min_by("team", F.struct(*order)).alias("team"),
        F.median("corrected_s").alias("long_run_pace_s"),
        F.count(F.lit(1)).alias("long_run_n"),
    )


def session_best(laps: DataFrame, session: list[str] = SESSION, name: str = "fp_best_lap_s") -> DataFrame:
    return valid_laps(laps).groupBy(*session, "driver").agg(F.min("lap_s").alias(name))


def pace_features(practice: DataFrame, quali: DataFrame | None = None, session: list[str] = SESSION) -> DataFrame:
    """Long-run pace, best practice lap and best qualifying lap of each driver, with one team a driver."""
    keys = [*session, "driver"]
    # one pass over practice gives the best lap and the team; a driver with a long run has a valid lap
    usable, named = F.col("lap_s") > PACE.min_lap_s, F.when(F.col("team").isNotNull(), F.struct(*LAP_ORDER))
    best = practice.groupBy(*keys).agg(F.min(F.when(usable, F.col("lap_s"))).alias("fp_best_lap_s"), F.min_by("team", named).alias("any_team"))
    joined = best.where("fp_best_lap_s is not null").join(long_run_pace(practice, session).withColumnRenamed("team", "run_team"), keys, "left")
    if quali is None:
        joined = joined.withColumn("quali_pace_s", F.lit(None).cast("double"))
    else:
        joined = joined.join(session_best(quali, session, "quali_pace_s"), keys, "left")
    return joined.select(*keys, F.coalesce("run_team", "any_team").alias("team"), "long_run_pace_s", "long_run_n", "fp_best_lap_s", "quali_pace_s")


def extra_pace(rows: DataFrame, session: list[str] = SESSION) -> DataFrame:
    """A weekend's own qualifying (``best_lap_s``) or sprint (``sprint_pace_s``, ``n``) in the shape of pace features; drivers without a time are left out."""
    value = "best_lap_s" if "best_lap_s" in rows.columns else "sprint_pace_s"
    none, own = F.lit(None).cast("double"), F.col(value)
    quali = value == "best_lap_s"
    return rows.where(own.isNotNull()).select(
        *session, "driver", "team", (none if quali else own).alias("long_run_pace_s"), (F.lit(0) if quali else F.col("n")).cast("bigint").alias("long_run_n"),
        none.alias("fp_best_lap_s"), (own if quali else none).alias("quali_pace_s"),
    )


def trimmed_pace(laps: DataFrame, stint_keys: list[str], group: list[str], min_laps: int = PACE.min_long_run_laps, quantile: float = PACE.trim_quantile) -> DataFrame:
    """(group, testing_long_run_s, testing_laps_n): mean over long stints; the slowest tenth is left out where there are three laps or more."""
    kept = laps.na.drop(subset=["lap_s", *stint_keys, *group])
    kept = kept.withColumn("stint_laps", F.count(F.lit(1)).over(Window.partitionBy(*stint_keys))).where(F.col("stint_laps") >= min_laps)
    per = Window.partitionBy(*group)
    kept = kept.withColumns({"n": F.count(F.lit(1)).over(per), "bound": F.expr(f"percentile(lap_s, {quantile})").over(per)})
    return kept.groupBy(*group).agg(
        F.avg(F.when((F.col("n") < 3) | (F.col("lap_s") <= F.col("bound")), F.col("lap_s"))).alias("testing_long_run_s"),
        F.count(F.lit(1)).alias("testing_laps_n"),
    )


def sprint_pace(laps: DataFrame, session: list[str] = SESSION, min_laps: int = PACE.sprint_min_laps, order: list[str] = LAP_ORDER) -> DataFrame:
    """Median time of each driver with enough laps, without the session's first and last lap."""
    last = laps.groupBy(*session).agg(F.max("lap_number").alias("last_lap"))
    inner = laps.where("lap_s > 0 and lap_number > 1").join(last, session).where("lap_number < last_lap")
    paced = inner.groupBy(*session, "driver").agg(F.min_by("team", F.struct(*order)).alias("team"), F.median("lap_s").alias("sprint_pace_s"), F.count(F.lit(1)).alias("n"))
    return paced.where(F.col("n") >= min_laps)


def coverage(features: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Share of rows with a value, by column."""
    return features.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_coverage") for c in columns])
