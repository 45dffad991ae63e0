"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import cut, rank_buckets, read, seeded, spread_rank, ties, without

SHARDS, SEED = 24, 20260


def phases(strata: DataFrame, seed: int) -> DataFrame:
    """(s, phase) of strata (s, n): where in [0, 1) the first row of a stratum stands, in units of the distance of its rows.

    Strata with equally many rows are put in seeded order, and their phases lie at equal distances, so that together they
    are one even comb: k strata of n rows each take every place (i + c) / (k n). The whole comb is shifted by a seeded
    part of a step c, else all sizes that occur once would meet in the middle.
    """
    named = strata.withColumn("h", seeded(seed + 1, "s"))
    placed = spread_rank(named, ["n"], F.col("h") / F.lit(float(2**52)), [F.col("h"), F.col("s")], "r", "k")
    turned = (F.col("r") + F.lit(0.5)) / F.col("k") + seeded(seed + 2, "n") / F.lit(float(2**52))
    return placed.select("s", (turned - F.floor(turned)).alias("phase"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", stratum: str = "source") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0) so that each shard has the mixture of the whole.

    Rows are ranked in a seeded shuffle within their stratum; the fractional rank
    (rank + phase of the stratum) / rows of the stratum puts all strata on one line, which is cut into equal runs.
    Shard sizes differ by one row at most. On any part of the line a stratum, and the strata of one size together, have
    their share to within one row.

    * a null stratum is a stratum of its own, a null key sorts as an empty one;
    * rows with equal keys are ordered by their other columns; which of two wholly equal rows comes first makes no
      difference to the result;
    * an empty input gives an empty result; input columns named ``shard`` or ``slot`` are replaced.
    """
    kept = without(docs, "shard", "slot")
    rows = kept.withColumns({"__h": seeded(seed, key), "__s": F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))})
    strata = cut(rows.groupBy(F.col("__s").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    buckets = rank_buckets(strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    order = [F.col("__h"), F.col(f"`{key}`"), *ties(kept, key, stratum)]
    facts = phases(strata, seed).toDF("__s", "__phase")
    ranked = spread_rank(rows, ["__s"], F.col("__h") / F.lit(float(2**52)), order, "__rank", "__rows", buckets, facts)
    lined = ranked.withColumn("__at", (F.col("__rank") + F.col("__phase")) / F.col("__rows"))
    placed = spread_rank(lined, [], F.col("__at"), [F.col("__at"), F.col("__s"), *order], "__pos", "__all", buckets)
    cut_at = placed.withColumn("shard", F.expr(f"(__pos * {shards}) div __all").cast("int"))
    start = F.expr(f"(cast(shard as bigint) * __all + {shards - 1}) div {shards}")
    return cut_at.withColumn("slot", F.col("__pos") - start).select(*kept.columns, "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its text's crc32, its shard and its slot, under the law ``rows``."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return interleave(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: crc32 by its definition: a table of 256 entries from the polynomial, folded over the text's bytes.
OP4_SQL = f"""
with crc_table as (
  select list(c order by i) as t from (select i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
hexed as (select doc_id, source, text, coalesce(hex(encode(text)), '') as h from documents),
sized as (
  select doc_id, source, (length(h) // 2 + 8)::BIGINT as size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT as h, coalesce('s' || source, 'n') as s
  from hexed, crc_table),
strata as (select s, count(*) as rows_of, ('0x' || substr(md5('{SEED + 1}|' || s), 1, 13))::BIGINT as sh from sized group by s),
combed as (
  select s, rows_of, (row_number() over (partition by rows_of order by sh, s) - 0.5::DOUBLE) / count(*) over (partition by rows_of)
    + ('0x' || substr(md5('{SEED + 2}|' || rows_of), 1, 13))::BIGINT / 4503599627370496::DOUBLE as turned from strata),
ranked as (
  select d.*, (row_number() over (partition by d.s order by h, doc_id, size, text_crc32) - 1 + (turned - floor(turned))) / rows_of as pt
  from sized d join combed c on c.s = d.s),
placed as (select *, row_number() over (order by pt, s, h, doc_id, size, text_crc32) - 1 as pos, count(*) over () as n from ranked)
select doc_id, size, text_crc32, 'rows' as law, (pos * {SHARDS} // n)::INTEGER as shard,
  (pos - (pos * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS})::BIGINT as slot, null::INTEGER as grown_shard, source
from placed
"""
