import hashlib
import math
from collections import Counter

from stintline.llm import sharding


def h(key, seed=sharding.SEED):
    return int(hashlib.md5(f"{seed}|{'' if key is None else key}".encode()).hexdigest()[:13], 16)


def brute_phases(sizes):
    """Strata of one size stand at equal distances, in seeded order, the whole comb turned by a seeded part of a step."""
    out = {}
    for n in set(sizes.values()):
        same = sorted((s for s in sizes if sizes[s] == n), key=lambda s: (h(s, sharding.SEED + 1), s))
        for i, s in enumerate(same):
            turned = (i + 0.5) / len(same) + h(n, sharding.SEED + 2) / 2**52
            out[s] = turned - math.floor(turned)
    return out


def test_brute_force(spark, make):
    rows = [(i, "t", "en", ["a", "a", "a", "b", None, "c"][i % 6] if i != 7 else "one") for i in range(500)]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(make(rows), 24).collect()}
    strata = {}
    for r in rows:
        strata.setdefault("n" if r[3] is None else "s" + r[3], []).append((h(r[0]), r[0]))
    phases = brute_phases({s: len(v) for s, v in strata.items()})
    line = sorted(((k + phase) / len(v), s, *x) for s, v in strata.items() for phase in [phases[s]] for k, x in enumerate(sorted(v)))
    start = {}
    for pos, x in enumerate(line):
        shard = pos * 24 // len(line)
        start.setdefault(shard, pos)
        assert got[x[3]] == (shard, pos - start[shard])
    sizes = Counter(s for s, _ in got.values())
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for name in "ab":
        share = Counter(got[r[0]][0] for r in rows if r[3] == name)
        weight = sum(share.values()) / len(rows)  # each of a shard's two ends is off by 1/2 + weight * strata / 2 rows at most
        assert all(abs(share[s] - sum(share.values()) / 24) <= 1 + weight * len(strata) for s in range(24))


def test_awkward(spark, awkward):
    got = sharding.interleave(awkward, 3).collect()
    assert len(got) == awkward.count()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_empty(spark, make):
    assert sharding.interleave(make([])).count() == 0


def test_one_row_sources_have_the_mixture_in_every_shard(spark):
    from pyspark.sql import functions as F

    docs = spark.range(48_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 24_000, "big").otherwise(F.concat(F.lit("one"), F.col("id").cast("string"))).alias("source"))
    shares = sharding.interleave(docs).groupBy("shard").agg(F.avg((F.col("source") == "big").cast("int")).alias("big"), F.count(F.lit(1)).alias("n")).collect()
    assert len(shares) == 24 and all(r.n == 2000 and abs(r.big - 0.5) < 0.005 for r in shares)


def test_many_small_sources_of_every_size(spark):
    from pyspark.sql import functions as F

    sizes = [(f"{n}x{k}", n) for n in range(1, 60) for k in range(9)] + [("big", 16_000)]
    docs = spark.createDataFrame(sizes, "source string, n int").select("source", F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumn("doc_id", F.monotonically_increasing_id())
    shares = sharding.interleave(docs).groupBy("shard").agg(F.avg((F.col("source") == "big").cast("int")).alias("big"), F.count(F.lit(1)).alias("n")).collect()
    whole = 16_000 / docs.count()
    assert max(r.n for r in shares) - min(r.n for r in shares) <= 1 and all(abs(r.big - whole) < 0.02 for r in shares)


def test_rows_with_equal_keys_are_ordered_by_their_other_columns(spark):
    rows = [(1, "a", f"text {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first, again = (sorted((r.shard, r.slot, r.text) for r in sharding.interleave(f, 4).collect()) for f in (frame, frame.repartition(7).sort("text", ascending=False)))
    assert first == again and [t for _, _, t in first] == sorted(t for _, _, t in rows)
