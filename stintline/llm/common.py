"""What the corpus operators share: reading, cutting lineage, seeded order, distributed ranks."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets a distributed rank deals rows into. A bucket is one sort of about rows / RANK_BUCKETS rows.
RANK_BUCKETS = 2048
#: Bytes of an Arrow batch that goes to a Python worker. Texts are of any length, so a bound in rows alone is none in memory.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Python workers on this machine find the package where the driver did, and get batches of BATCH_BYTES at most."""
    if int(spark.conf.get(BATCH_KEY, None) or BATCH_BYTES + 1) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may do without that setting; elsewhere a temporary folder would be one that the others do not see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stintline-shared-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small derived table in the shared checkpoint folder and forget its lineage."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and how many rows that wrote: counted by the job that writes them, not by one more."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store that Spark reads will do."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns an operator is about to add; an input column of that name gives way."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def seeded(seed: int, *columns: str) -> Column:
    """A 52-bit integer that depends on the seed and the columns alone (nulls count as empty)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def ties(df: DataFrame, *but: str) -> list[Column]:
    """The other columns that can be ordered, so that an order by them is total but for wholly equal rows."""
    return [F.col(f"`{c}`") for c, t in df.dtypes if c not in but and "map<" not in t and t != "variant"]


def rank_buckets(rows: int) -> int:
    """Buckets for a distributed rank of so many rows: at most about 100,000 rows each, RANK_BUCKETS at least."""
    return max(RANK_BUCKETS, 1 << max(0, rows // 100_000).bit_length())


def spread_rank(
    df: DataFrame, groups: list[str], unit: Column, order: list[Column], rank: str, total: str, buckets: int = RANK_BUCKETS, facts: DataFrame | None = None
) -> DataFrame:
    """Add the rank (from 0) of each row in its group, and the group's row count, without one task per group.

    ``unit`` lies in [0, 1] and must not contradict ``order``. Rows are dealt by (group, bucket of
    unit); only bucket counts, at most ``buckets`` a group, are summed along a group. A hot group
    is thus sorted by as many tasks as it has buckets. ``facts`` (one row a group) are added to the
    rows through the same join.

    * a row whose group column is null is lost (callers give null groups a name); wholly equal rows take
      neighbouring ranks; an empty input gives an empty result.
    """
    dealt = df.withColumn("__bucket", F.floor(unit * buckets).cast("int"))
    keys = [*groups, "__bucket"]
    along = Window.partitionBy(*groups).orderBy("__bucket")
    whole = Window.partitionBy(*groups)
    before = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys,
            F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
            F.sum("__n").over(whole).alias(total),
        )
    )
    if facts is not None:
        before = before.join(facts, groups)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = dealt.withColumn("__within", within).join(before, keys)
    return ranked.withColumn(rank, F.col("__before") + F.col("__within") - 1).drop("__bucket", "__before", "__within")
