"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import cut, rank_buckets, read, seeded, spread_rank, ties, without

#: Rows of a block, sum that default weights are scaled to at least, and the power of its row count that a source weighs by default.
BLOCK, SLOTS, TEMPER, SEED = 16, 1000, 0.7, 911
#: The weight that the smallest source has at least, so that no default weight is rounded by more than a 32nd.
LEAST = 16
#: Given weights are exact up to this common denominator; beyond it they are whole parts of it.
EXACT = 1 << 20
#: A plan of up to this many slots and sources is broadcast; beyond it the join is dealt by source and salt. Slots of a step of the schedule.
BROADCAST_SOURCES, SALTS, STEP = 100_000, 32, 1000
ADDED = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_pos"]


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the given decimals (0.97, 0.02, 0.01: 97, 2, 1); weights of 0 or less are 0.

    Only weights without a common denominator of EXACT or less are rounded, to parts of EXACT (one at least).
    """
    exact = {k: max(Fraction(str(w)), Fraction(0)) for k, w in weights.items()}
    scale = lcm(*[f.denominator for f in exact.values()]) if exact else 1
    whole = {k: int(f * scale) for k, f in exact.items()}
    shared = gcd(*whole.values()) or 1
    whole = {k: w // shared for k, w in whole.items()}
    total = sum(whole.values())
    return whole if total <= EXACT else {k: w and max(1, round(w * EXACT / total)) for k, w in whole.items()}


def source_weights(counts: DataFrame, weights: Mapping[str, float] | None, slots: int) -> DataFrame:
    """(s, n, w): the whole weight of each source; by default the power TEMPER of its row count, scaled to a sum of about ``slots``.

    Where a source would so weigh less than LEAST, the sum is larger: the smallest weighs LEAST, and all keep their proportions to a 32nd, however many there are.
    """
    if weights is None:
        own = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
        total = counts.agg(F.sum(own).alias("total"), F.greatest(F.lit(float(slots)), F.ceil(F.lit(LEAST) * F.sum(own) / F.min(own))).alias("slots"))
        w = F.greatest(F.lit(1), F.round(F.col("slots") * own / F.col("total"))).cast("int")
        return counts.crossJoin(F.broadcast(total)).select("s", "n", w.alias("w"))  # one row
    whole = whole_weights(weights)
    given = F.create_map(*[F.lit(x) for k, w in whole.items() for x in ("s" + k, w)]) if whole else F.create_map().cast("map<string,int>")
    return counts.select("s", "n", F.coalesce(F.element_at(given, F.col("s")), F.lit(0)).alias("w"))


def deal(classes: DataFrame) -> DataFrame:
    """(w, m, period, j, slot): earliest deadline first over one period, for classes (w, m) of m sources of weight w each.

    The period is the sum of all weights. Block k of a source of weight w may start at floor(k period / w) and is due by
    ceil((k + 1) period / w); each slot goes to the released block that is due first, among equals to the heavier source. Sources of
    one weight have the same releases and deadlines, so a class takes its sources in turn: its j-th slot is block j div m of source
    j mod m. One row is folded, but its work is slots times different weights (at most the root of twice the period), not times sources.
    """
    one = classes.agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), F.col("w").cast("bigint").alias("w"), F.col("m").cast("bigint").alias("m")))).alias("q"))
    one = one.where("size(q) > 0").withColumn("period", F.expr("aggregate(q, 0L, (a, c) -> a + c.w * c.m)"))
    block = "(st.j[i] div q[i].m)"
    due = f"struct((({block} + 1) * period + q[i].w - 1) div q[i].w as due, i as i)"
    pick = f"array_min(filter(transform(sequence(0, size(q) - 1), i -> if(({block} * period) div q[i].w <= t, {due}, null)), x -> x is not null)).i"
    turn = f"transform(array({pick}), p -> struct(transform(st.j, (v, i) -> if(i = p, v + 1, v)) as j, array_append(st.line, p) as line))[0]"
    start = "cast(array() as array<int>)"
    step = f"aggregate(sequence(t0, least(t0 + {STEP}L, period) - 1), struct(big.j as j, {start} as line), (st, t) -> {turn})"
    steps = f"transform(array({step}), r -> struct(r.j as j, array_append(big.lines, r.line) as lines))[0]"
    line = f"aggregate(sequence(0L, period - 1, {STEP}L), struct(array_repeat(0L, size(q)) as j, cast(array() as array<array<int>>) as lines), (big, t0) -> {steps}, big -> flatten(big.lines))"
    slots = one.select("period", "q", F.posexplode(F.expr(line)).alias("slot", "i"))
    mine = slots.groupBy("period", F.col("q")[F.col("i")]["w"].cast("int").alias("w"), F.col("q")[F.col("i")]["m"].alias("m")).agg(F.sort_array(F.collect_list("slot")).alias("line"))
    return mine.select("w", "m", "period", F.posexplode("line").alias("j", "slot"))


def schedule(quota: DataFrame) -> DataFrame:
    """(s, quota, period, slots) of sources (s, quota): for each the slots of one period (the sum of all quotas) that are its own.

    After t slots a source is less than one block away from its weight's part of t, and every block is on time. Weights are whole
    numbers, so the period repeats for ever without an error that adds up.
    """
    hashed = quota.select("s", F.col("quota").cast("int").alias("w")).withColumn("h", seeded(SEED, "s"))
    named = cut(spread_rank(hashed, ["w"], F.col("h") / F.lit(float(2**52)), [F.col("h"), F.col("s")], "i", "m").select("s", "w", "m", "i"))
    dealt = deal(named.select("w", "m").distinct())
    own = dealt.groupBy("w", "period", F.expr("j % m").alias("i")).agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return named.join(own, ["w", "i"]).select("s", F.col("w").alias("quota"), F.col("period").cast("int").alias("period"), "slots")


def plan_of(sources: DataFrame, block: int) -> DataFrame:
    """(s, quota, period, slots, base): the schedule of sources (s, n, w) with a weight, and the turns of those without one.

    The latter come after the last block of all others (``base``), one block each in turn.
    """
    weighed = cut(schedule(sources.where("w > 0").select("s", F.col("w").alias("quota"))))
    last = F.expr(f"((n - 1) div {block} div quota) * cast(period as bigint) + slots[cast((n - 1) div {block} % quota as int)] + 1")
    base = sources.join(weighed, "s").agg(F.coalesce(F.max(last), F.lit(0)).alias("base"))
    rest = sources.where("w = 0").withColumn("h", seeded(SEED, "s")).withColumn("one", F.lit(1))
    rest = spread_rank(rest, ["one"], F.col("h") / F.lit(float(2**52)), [F.col("h"), F.col("s")], "i", "m").crossJoin(F.broadcast(base))  # one row
    rest = rest.select("s", F.lit(1).alias("quota"), F.col("m").cast("int").alias("period"), F.array(F.col("i").cast("int")).alias("slots"), "base")
    return weighed.select("s", "quota", "period", "slots", F.lit(0).cast("bigint").alias("base")).unionByName(rest)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add each row's place in the mixed stream: its source's block, that block's release, deadline and slot, and ``mix_pos``.

    A source's rows are shuffled by seed and cut into blocks of ``block`` rows; blocks take the
    slots of ``schedule``. Every row is in the stream once: nothing is dropped or repeated. Up to
    the slot where the first source ends, each source is less than one block off its weight, however long the stream; from
    there on its slots stay empty and the others keep their proportions.

    * weights are the given decimals, exactly (see ``whole_weights``), or else whole numbers in proportion to the power TEMPER of the row counts;
      sources that ``weights`` leaves out or gives 0 or less follow after all others, in turn;
    * a null source is a source of its own (it has no weight in ``weights``); rows with null or equal keys are ordered by
      their other columns, and which of two wholly equal rows comes first makes no difference;
    * an empty input gives an empty result; input columns named like added ones are replaced.
    """
    kept = without(docs, *ADDED)
    rows = kept.withColumns({"__h": seeded(seed, key), "__s": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))})
    counts = cut(rows.groupBy(F.col("__s").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    plan = cut(plan_of(cut(source_weights(counts, weights, slots)), block).toDF("__p", "__quota", "__period", "__slots", "__base"))
    facts = plan.agg(F.coalesce(F.sum(F.size("__slots") + 4), F.lit(0)).alias("size")).first()
    order = [F.col("__h"), F.col(f"`{key}`"), *ties(kept, key, source)]
    buckets = rank_buckets(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    ranked = spread_rank(rows, ["__s"], F.col("__h") / F.lit(float(2**52)), order, "__rank", "__rows", buckets)
    if facts.size <= BROADCAST_SOURCES:
        placed = ranked.join(F.broadcast(plan), F.col("__s") == F.col("__p"))
    else:
        salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = ranked.join(salted, (F.col("__s") == F.col("__p")) & (F.pmod("__h", F.lit(SALTS)) == F.col("__salt"))).drop("__salt")
    placed = placed.withColumns({"mix_block": F.expr(f"__rank div {block}"), "__period": F.col("__period").cast("bigint")})
    return placed.withColumns(
        {
            "mix_release": F.expr("(mix_block * __period) div __quota + __base"),
            "mix_deadline": F.expr("((mix_block + 1) * __period + __quota - 1) div __quota + __base"),
            "mix_slot": F.expr("(mix_block div __quota) * __period + __slots[cast(mix_block % __quota as int)] + __base"),
        }
    ).withColumn("mix_pos", F.expr(f"mix_slot * {block} + __rank % {block}")).select(*kept.columns, *ADDED)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows laid out in stream order: part files follow each other, and so do the rows in each. Every row has its own ``mix_pos``."""
    return mixed.repartitionByRange("mix_pos").sortWithinPartitions("mix_pos")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the stream, by default weights."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


#: The schedule slot by slot, as a recursion over one period, for one list of the classes of equal weight.
OP9_SQL = f"""
with recursive hashed as (
  select doc_id, source, coalesce('s' || source, 'n') as s, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT as h from documents),
counts as (select s, count(*) as n, ('0x' || substr(md5('{SEED}|' || s), 1, 13))::BIGINT as sh from hashed group by s),
powers as (select s, sh, pow(n::DOUBLE, {TEMPER}::DOUBLE) as own from counts),
scaled as (select *, sum(own) over () as total, greatest({SLOTS}::DOUBLE, ceil({LEAST} * sum(own) over () / min(own) over ())) as slots from powers),
weights as (select s, sh, greatest(1, round(slots * own / total))::BIGINT as w from scaled),
sources as (select s, w, row_number() over (partition by w order by sh, s) - 1 as i, count(*) over (partition by w) as m, sum(w) over ()::BIGINT as period from weights),
fixed as (select list({{'w': w, 'm': m}} order by w desc) as q, any_value(period) as period from (select distinct w, m, period from sources)),
edf as (
  select 0::BIGINT as t, list_transform(q, lambda x: 0::BIGINT) as j, null::BIGINT as pick, q, period from fixed
  union all
  select t + 1, list_transform(j, lambda v, i: case when i = p.i then v + 1 else v end), p.i, q, period from (
    select *, list_min(list_filter(list_transform(q, lambda a, i: case when (j[i] // a.m * period) // a.w <= t
      then {{'due': ((j[i] // a.m + 1) * period + a.w - 1) // a.w, 'i': i::BIGINT}} end), lambda x: x is not null)) as p from edf where t < period)),
slots as (select q[pick].w as w, q[pick].m as m, t - 1 as slot, row_number() over (partition by pick order by t) - 1 as j from edf where pick is not null),
ranked as (select *, row_number() over (partition by s order by h, doc_id) - 1 as r from hashed),
blocks as (select r.*, r.r // {BLOCK} as b, x.w, x.period, x.i from ranked r join sources x on x.s = r.s)
select doc_id, source, b::BIGINT as mix_block, (b * period // blocks.w)::BIGINT as mix_release, (((b + 1) * period + blocks.w - 1) // blocks.w)::BIGINT as mix_deadline,
  ((b // blocks.w) * period + slot)::BIGINT as mix_slot, (((b // blocks.w) * period + slot) * {BLOCK} + r % {BLOCK})::BIGINT as mix_pos
from blocks join slots on slots.w = blocks.w and slots.j % slots.m = blocks.i and slots.j // slots.m = b % blocks.w
"""
