"""Small formulas over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.rules import ALLOCATIONS, COMPONENT_LIVES, DEFAULT_LIFE, INCIDENT, MECHANICAL, PENALTY, PRIORS


def null_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column; sources are read through this."""
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast(t)) for n, t in df.dtypes if t in ("double", "float")})


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, or ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fill_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Exactly the named columns, in order; those the frame lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def seconds(value: Column, kind: str) -> Column:
    """Lap time in seconds from nanoseconds (``ns``), a day-time interval (``interval``), ``m:ss.fff`` text (``text``)
    or a number (``s``); null where it cannot be read."""
    if kind == "ns":
        return value / F.lit(1e9)
    if kind == "interval":
        return F.unix_micros(F.timestamp_micros(F.lit(0)) + value) / F.lit(1e6)
    if kind == "text":
        minutes = F.regexp_extract(value, r"^(?:(\d+):)?(\d+(?:\.\d+)?)$", 1)
        rest = F.regexp_extract(value, r"^(?:(\d+):)?(\d+(?:\.\d+)?)$", 2)
        return F.coalesce(minutes.try_cast("double"), F.lit(0.0)) * 60 + rest.try_cast("double")
    return value.try_cast("double")


def is_green(track_status: Column) -> Column:
    return track_status.cast("string") == "1"


def lookup(values: Mapping, key: Column, kind: str) -> Column:
    """The value of a small fixed table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key).cast(kind)


def points(position: Column, table: Mapping[int, int]) -> Column:
    return F.coalesce(lookup(table, position.cast("int"), "double"), F.lit(0.0))


def status_class(status: Column) -> Column:
    """finished, mechanical, incident or other."""
    said = F.trim(F.lower(status))
    return (
        F.when((said == "finished") | said.startswith("+"), "finished")
        .when(said.rlike("|".join(MECHANICAL)), "mechanical")
        .when(said.rlike("|".join(INCIDENT)), "incident")
        .otherwise("other")
    )


def beta_rate(hits: Column, trials: Column, kind: str) -> Column:
    alpha, beta = PRIORS[kind]
    return (hits + F.lit(alpha)) / (trials + F.lit(alpha + beta))


def penalty_positions(extra: Column) -> Column:
    """Grid places lost for units beyond the allocation: ten for the first, five for each further one."""
    return F.when(extra <= 0, 0).otherwise(PENALTY.first + (extra - 1) * PENALTY.further).cast("int")


def from_pit_lane(total: Column) -> Column:
    return total > PENALTY.pit_lane_over


def poisson_cdf(k: Column, rate: Column) -> Column:
    """P(X <= k); 0 for a negative k, 1 for a rate of 0 or less."""
    terms = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * rate / i).alias("term"), (a["sum"] + a["term"] * rate / i).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k < 0, 0.0).when(rate <= 0, 1.0).otherwise(F.least(F.exp(-rate) * terms, F.lit(1.0)))


def component_life(component: Column, override: Column | None = None) -> Column:
    known = F.coalesce(lookup(COMPONENT_LIVES, component, "double"), F.lit(DEFAULT_LIFE))
    return known if override is None else F.coalesce(override, known)


def allocation(season: Column, component: Column) -> Column:
    return F.coalesce(*[F.when(season == s, lookup(t, component, "int")) for s, t in ALLOCATIONS.items()])


def grid_modifier(grid: Column, entrants: Column, scale: float = 0.15) -> Column:
    """From +scale on pole to -scale on the last place."""
    return scale * (1 - 2 * (grid - 1) / F.greatest(entrants - 1, F.lit(1)))


def team_slug(name: Column, known: Mapping[str, str]) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(lookup(known, low, "string"), F.replace(low, F.lit(" "), F.lit("_")))


def round_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
