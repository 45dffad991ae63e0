"""Filter interaction audit: what each of five filters removes in every order, kept current as files arrive.

The documents are read as a stream of files until none is left. Texts are dealt by hash into buckets, whose keyed state holds the least id
seen of each text; when a smaller id arrives, the earlier holder's mask is retracted from its part's counters and counted again as a copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stintline.llm.common import deleted, read, shared_folder

FILTERS = "ABCDE"
#: Bit of the filter that no text decides alone: an equal text with a smaller id exists.
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Micro-batches that the files of a table are read in, about. The result does not depend on it.
BATCHES = 4
#: Documents for each bucket of texts. A batch reads and writes the state of every bucket that it has rows of.
BUCKET_ROWS = 2000
#: Stands for a null id: it comes after all others, and null ids are not smaller than each other.
LAST = (1 << 63) - 1
CELL = "part string, mask int, good int, toxic int, n bigint"


def failures(text: Column) -> Column:
    """Bits of the conditions A to D that a text fails; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    counted = F.struct(F.size(words).alias("all"), F.size(F.array_distinct(words)).alias("distinct"))
    bits = F.transform(  # through a lambda, so that the words are split once
        F.array(counted),
        lambda c: F.when(c["all"] < 200, 1).otherwise(0) + F.when(100 * c["distinct"].cast("bigint") < 50 * c["all"].cast("bigint"), 2).otherwise(0),
    )[0]
    return bits + F.when(100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


FACTS = ["text_key", "mask", "least", "first", "part", "good", "toxic"]


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: of each text a batch's least id with its rows, and how many others there are, by part and labels. A hot text sends few rows."""
    for rows in batches:
        if len(rows):
            rows = rows.assign(least=rows.groupby("text_key")["id"].transform("min"))
            rows["first"] = rows["id"] == rows["least"]
            yield rows.groupby(["bucket", *FACTS], sort=False).size().rename("n").reset_index()


COMBINED = "bucket int, text_key binary, mask int, least bigint, first boolean, part string, good int, toxic int, n bigint"
HELD = "texts binary"
OUT = ["part", "mask", "good", "toxic"]


def merged(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket holds after new rows, and the changes to the counters.

    Held is one row for each text's least id, part and labels (repeated rows share an id) with their count. Where a smaller id is new, what was held
    is taken back as an original and counted as a copy; new rows count as originals if theirs is the least id, else as copies.
    """
    rows = pd.concat([held.assign(first=True, old=True), new.assign(old=False)], ignore_index=True)
    least = rows.groupby("text_key")["least"].transform("min")
    stays = rows["first"] & (rows["least"] == least)
    fresh, lost = rows[~rows["old"]], rows[rows["old"] & ~stays]
    fresh = fresh.assign(mask=fresh["mask"] | (~stays[~rows["old"]]).astype("int64") * COPY)
    changes = pd.concat([fresh, lost.assign(n=-lost["n"]), lost.assign(mask=lost["mask"] | COPY)])
    kept = rows[stays].groupby(["text_key", "mask", "least", "part", "good", "toxic"], sort=False)["n"].sum().reset_index()
    return kept, changes.groupby(OUT, sort=False)["n"].sum().reset_index()


def retracting(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes to the counters that new rows of a bucket of texts make; the state is the bucket's texts with their least ids, as an Arrow table."""
    new = pd.concat(list(batches), ignore_index=True).drop(columns="bucket")
    if len(new):
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0].drop(columns="first")
        kept, changes = merged(held, new)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(kept, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        yield changes[changes["n"] != 0]


def changes(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Changes to the counters of (part, failed filters, labels), from a stream of documents (doc_id, text, source) and a table of labels (doc_id, quality, toxic)."""
    key = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))
    flags = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(
        F.col("doc_id").alias("__doc"),
        F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("id"),
        F.coalesce("source", F.lit("")).alias("part"),
        key.alias("text_key"),
        failures(F.col("text")).cast("int").alias("mask"),
    )
    labelled = rows.join(flags, F.col("__doc") == F.col("__id"), "left").select(
        F.pmod(F.xxhash64("text_key"), F.lit(buckets)).cast("int").alias("bucket"),
        "text_key", "mask", "id", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    return (
        labelled.mapInPandas(combined, COMBINED)
        .groupBy("bucket")
        .applyInPandasWithState(retracting, CELL, HELD, "update", GroupStateTimeout.NoTimeout)
    )


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows of each (part, failed filters, labels) once all files of ``path`` have been read as micro-batches.

    The session's state store keeps the state, about 30 bytes a text; for billions of texts set its RocksDB provider
    (``spark.sql.streaming.stateStore.providerClass``). A batch's changes go to a folder of its number, so one that is repeated after a failure counts once; the state lies in the
    query's checkpoint in the shared folder and is deleted at the end.
    """
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    files, buckets = len(table.inputFiles()), max(1, table.count() // BUCKET_ROWS)  # the count comes from the files' footers
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path}*")

    def store(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = changes(stream, labels, buckets).writeStream.outputMode("update").foreachBatch(store)
    running = query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    spark.createDataFrame([], CELL).write.parquet(f"{folder}/changes/batch=-1")  # a table without files has no batch
    deleted(spark, f"{folder}/checkpoint")
    return spark.read.schema(CELL).parquet(f"{folder}/changes/batch=*").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def by_order(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step) with what the step's filter does there, from the counters: a part's are one row of at most 32 cells."""
    masks = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = part.select("*", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = steps.withColumn("bits", F.expr("transform(sequence(1, 5), i -> shiftleft(1, ascii(substring(filter_order, i, 1)) - 65))"))
    at = bits.withColumn("bit", F.expr("element_at(bits, step)")).withColumn("earlier", F.expr("aggregate(slice(bits, 1, step - 1), 0, (a, b) -> a | b)"))

    def total(test: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {test}), 0L, (a, c) -> a + {value})")

    here = "c.mask & bit <> 0 and c.mask & earlier = 0"
    return at.select(
        "part",
        "filter_order",
        "step",
        total("c.mask & (bit | earlier) = 0").alias("kept"),
        total(here).alias("removed"),
        total("c.mask & bit <> 0 and c.mask & earlier <> 0").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"),
        total(here, "c.toxic").alias("toxic_lost"),
        total("c.mask & bit <> 0", f"c.n * ({len(ORDERS)} div bit_count(c.mask))").alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each part (the source), each of the 120 orders of the filters and each step, from the Parquet table of documents at ``path``.

    Failures are those of A: under 200 words; B: under half of the words distinct; C: over 2 % capitals A-Z; D: one of ``#$%&*|``;
    E: a smaller id has the same text. ``kept`` pass this and the earlier steps, ``removed`` fail here first, ``redundant`` had failed before,
    ``unique_fails`` fail this filter alone, ``good_lost`` and ``toxic_lost`` are removed rows with that label, ``shapley`` sums
    ``removed`` of the filter over all orders.

    * a null text is empty, a null source the part '', a null id comes after all others; a row repeated with its id is no copy of itself;
    * of several labels of one id any 1 counts, a null label is none; other columns are not read; an empty table gives an empty result.
    """
    return by_order(counters(spark, path, labels, batches))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


OP12_SQL = r"""
with recursive
flags as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, coalesce(doc_id, 9223372036854775807) as id,
        [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] as words
    from documents
),
failed as (
    select doc_id, part,
        (len(words) < 200)::int + 2 * (100 * list_unique(words) < 50 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * (min(id) over (partition by text) < id)::int as mask
    from texts
),
cells as (
    select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
    from failed left join flags using (doc_id) group by part, mask
),
orders(filter_order) as (
    select '' union all select filter_order || letter from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as letter) l
    where not contains(filter_order, letter)
),
steps as (
    select filter_order, step::int as step, (1 << (ascii(filter_order[step]) - 65)) as bit,
        list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)])::int as earlier
    from orders, range(1, 6) r(step) where length(filter_order) = 5
),
joined as (select part, filter_order, step, mask, n, good, toxic, bit, coalesce(earlier, 0) as earlier from cells, steps)
select part, filter_order, step,
    sum(case when mask & (bit | earlier) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit <> 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & bit <> 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost,
    sum(case when mask & bit <> 0 then n * (120 // bit_count(mask)) else 0 end)::bigint as shapley
from joined group by part, filter_order, step
"""
