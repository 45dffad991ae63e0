"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.llm.common import cut, read, ties, without

#: A line on more than RATIO of a site's pages, and on at least MIN_PAGES of them, is boilerplate.
RATIO, MIN_PAGES = 0.02, 5
#: A flagged table up to this many rows is broadcast; beyond it the join is dealt by site and salt.
BROADCAST_ROWS, SALTS = 200_000, 256


def _line_hashes(text: str) -> str:
    """SQL for the distinct 64-bit hashes of a text's lines that hold more than white space."""
    return f"array_distinct(transform(filter(split({text}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'), l -> xxhash64(l)))"


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, lines, n_pages): each site's boilerplate lines by hash.

    Pages are a site's distinct texts, so exact copies of one page count once. A site has fewer
    than (mean lines a page) / ratio such lines, which bounds the collected array.
    """
    pages = docs.where(F.col(host).isNotNull() & F.col(text).isNotNull()).select(
        F.col(host).alias("site"), F.xxhash64(F.col(text)).alias("page"), F.expr(_line_hashes(f"`{text}`")).alias("lines")
    )
    # a third of the rows may be copies of one page: partial aggregation leaves one of them a task
    pages = pages.groupBy("site", "page").agg(F.first("lines").alias("lines"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = (
        pages.select("site", F.explode("lines").alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
        .withColumn("salt", F.pmod("line", F.lit(SALTS)))
    )
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    return (
        counts.join(totals, ["site", "salt"])
        .where(F.col("n") > F.col("n_pages") * F.lit(ratio))
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("line")).alias("flagged"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Documents without the lines that more than ``ratio`` of their site's pages share; adds ``n_lines_dropped``.

    * every row stays, also one that loses all its lines (its text becomes empty);
    * lines of white space are never dropped, other lines keep their order and their ``\\n``;
    * a null text stays null, and a row without a site stays as it is, for it has no pages to compare with;
    * the site's page total and a line's page count are over distinct texts, so copies and
      repeated rows do not make a page's own lines boilerplate;
    * lines, and texts, are equal if their 64-bit hashes are; an input column ``n_lines_dropped`` is replaced;
    * an empty input gives an empty result.
    """
    flagged = cut(boilerplate(docs, host, text, ratio, min_pages).toDF("__site", "__flagged"))
    size = flagged.agg(F.coalesce(F.sum(F.size("__flagged") + 4), F.lit(0))).first()[0]
    rows = without(docs, "n_lines_dropped")
    if size <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(flagged), F.col(host) == F.col("__site"), "left")
    else:
        salted = flagged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # by all columns: copies of one page and rows without a text or a site are spread as well
        rows = rows.withColumn("__key", F.pmod(F.xxhash64(*ties(rows)), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (F.col(host) == F.col("__site")) & (F.col("__key") == F.col("__salt")), "left").drop("__key", "__salt")
    hits = F.expr(f"array_intersect({_line_hashes(f'`{text}`')}, __flagged)")
    joined = joined.withColumn("__hits", F.when(F.col("__flagged").isNotNull() & F.col(text).isNotNull(), hits))
    kept = F.expr(f"filter(split(`{text}`, '\\n', -1), l -> not array_contains(__hits, xxhash64(l)))")
    joined = joined.withColumn("__kept", F.when(F.size("__hits") > 0, kept))
    n_dropped = F.when(F.col("__kept").isNotNull(), F.size(F.split(F.col(text), "\n", -1)) - F.size("__kept")).otherwise(0)
    return joined.withColumns(
        {"n_lines_dropped": n_dropped.cast("bigint"), text: F.coalesce(F.array_join("__kept", "\n"), F.col(text))}
    ).select(*without(docs, "n_lines_dropped").columns, "n_lines_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    return drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines_dropped")


OP1_SQL = rf"""
with lines as (
  select source, text, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) as line
  from (select distinct source, text from documents where source is not null and text is not null)),
totals as (select source, count(*) as n_pages from (select distinct source, text from documents where source is not null and text is not null) group by source),
flagged as (
  select source, list(line) as flagged from (
    select l.source, l.line, count(*) as n, max(t.n_pages) as n_pages from lines l join totals t on l.source = t.source group by l.source, l.line)
  where n >= {MIN_PAGES} and n > n_pages * {RATIO}::double group by source),
done as (
  select d.doc_id, d.source, d.text,
    case when f.flagged is null or d.text is null then null
         else list_filter(string_split(d.text, chr(10)), lambda l: not list_contains(f.flagged, l)) end as kept
  from documents d left join flagged f on d.source = f.source)
select doc_id, source,
  case when kept is null or len(kept) = len(string_split(text, chr(10))) then text else coalesce(array_to_string(kept, chr(10)), '') end as text,
  case when kept is null then 0 else len(string_split(text, chr(10))) - len(kept) end::bigint as n_lines_dropped
from done
"""
