"""Keyed records: latest row, upsert, replacement by key, last known values, top rows, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """All keys of both; where both have a key, or one has it twice, the newest row stays."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["__batch", *order]).drop("__batch")


def replace_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key the new frame lacks, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_known(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key and column the last value that is not null."""
    struct = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), struct)).alias(c) for c in columns])


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rk") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def place_by(df: DataFrame, value: str, then: list[str], name: str = "position") -> DataFrame:
    """Add each row's place from the highest value down, ties by ``then``, without sorting all rows in one task.

    Rows of one value are ranked together and moved down by the number of rows with a higher one;
    only a count for each value is summed up. Meant for values with few steps, such as points.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    above = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(value).orderBy(*then))
    ranked = df.withColumn("__w", within).join(counts.select(value, above.alias("__above")), value)
    return ranked.select(*df.columns, (F.col("__above") + F.col("__w")).cast("int").alias(name))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both frames hold the same set of keys (eager)."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return not left.exceptAll(right).limit(1).count() and not right.exceptAll(left).limit(1).count()


def fold_name(name: Column, accents: bool = True) -> Column:
    """Lower case; with ``accents`` letters lose their marks."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿčšžćđ", "aaaaaaceeeeiiiinoooooouuuuyycszcd"
    low = F.lower(F.trim(name))
    return F.translate(low, marked, plain) if accents else low


def bridge_names(people: DataFrame, ids: DataFrame, accents: bool = True) -> DataFrame:
    """(key, full_name, id, rule): people matched to ids by name.

    Rule 1: the last word is an id. Rule 2: exactly one id ends in ``_`` and the last word. Rule 3: all
    words joined by ``_`` are an id. Each rule is an equi-join on a derived key; unmatched people
    stay with a null id.
    """
    low = fold_name(F.col("full_name"), accents)
    words = F.split(low, r"\s+")
    named = people.withColumns({"__last": F.element_at(words, -1), "__all": F.array_join(words, "_")})
    known = ids.select("id").distinct()
    tails = known.where(F.col("id").contains("_")).select(F.element_at(F.split("id", "_"), -1).alias("__tail"), F.col("id").alias("__by_tail"))
    tails = tails.groupBy("__tail").agg(F.max("__by_tail").alias("__by_tail"), F.count(F.lit(1)).alias("__n")).where("__n = 1")
    one = known.select(F.col("id").alias("__by_last"))
    three = known.select(F.col("id").alias("__by_all"))
    joined = (
        named.join(one, F.col("__last") == F.col("__by_last"), "left")
        .join(tails, F.col("__last") == F.col("__tail"), "left")
        .join(three, F.col("__all") == F.col("__by_all"), "left")
    )
    rule = F.when(F.col("__by_last").isNotNull(), 1).when(F.col("__by_tail").isNotNull(), 2).when(F.col("__by_all").isNotNull(), 3)
    return joined.select(*people.columns, F.coalesce("__by_last", "__by_tail", "__by_all").alias("id"), rule.alias("rule"))


def regular_drivers(session: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``is_regular``: false if the car's driver in the reference race is somebody else; an unknown car counts as regular.

    ``by`` names columns of both frames that part many sessions, each with its own reference race.
    """
    by = by or []
    ref = reference.select(*by, F.trim(F.col("car").cast("string")).alias("__car"), F.col("driver").alias("__expected")).distinct()
    joined = session.withColumn("__car", F.trim(F.col("car").cast("string"))).join(ref, [*by, "__car"], "left")
    return joined.withColumn("is_regular", F.coalesce(F.upper("driver") == F.upper("__expected"), F.lit(True))).drop("__car", "__expected")


def absent_regulars(session: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Drivers of the reference race who are not in the session; ``by`` as in ``regular_drivers``."""
    keys = [*(by or []), "driver"]
    return reference.select(*keys).distinct().join(session.select(*keys), keys, "left_anti")
