"""The deviation from exact weights over long streams, and many sources."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stintline.llm import mixing


def line_of(frame):
    """Sources in slot order over one period, by schedule()."""
    line = {}
    for r in frame.collect():
        for t in r.slots:
            assert t not in line
            line[t] = r.s
    return [line[t] for t in range(len(line))]


def farthest(line, weights, slots):
    """Greatest distance of any source from its share after each of so many slots of the repeated line."""
    total, done, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t in range(slots):
        done[line[t % len(line)]] += 1
        worst = max(worst, *(abs(Fraction(done[s]) - Fraction(w * (t + 1), total)) for s, w in weights.items()))
    return worst


@pytest.mark.parametrize("given", [{"a": 0.9, "b": 0.1}, {"a": 0.97, "b": 0.02, "c": 0.01}, {"a": 0.333, "b": 0.667}])
def test_less_than_one_block_off_for_ever(spark, given):
    whole = mixing.whole_weights(given)
    assert all(Fraction(w, sum(whole.values())) == Fraction(str(given[s])) for s, w in whole.items())
    line = line_of(mixing.schedule(spark.createDataFrame(list(whole.items()), "s string, quota int")))
    assert len(line) == sum(whole.values()) and farthest(line, whole, 50_000) < 1


def test_ten_thousand_sources(spark):
    rng = random.Random(3)
    weights = {f"x{i}": rng.choice((1, 1, 1, 2, 3)) for i in range(10_000)} | {"big": 9_000}
    line = line_of(mixing.schedule(spark.createDataFrame(list(weights.items()), "s string, quota int")))
    total, at = sum(weights.values()), {s: [] for s in weights}
    assert len(line) == total
    for t, s in enumerate(line):
        at[s].append(t)
    for s, w in weights.items():  # every block within its window is the same as being less than a block off at any time
        assert len(at[s]) == w and all(k * total // w <= t < -(-(k + 1) * total // w) for k, t in enumerate(at[s]))


def test_rows_of_a_long_stream(spark):
    """10,000 rows at 0.9 and 0.1 in blocks of one: the case that a rounded period loses ten blocks on."""
    docs = spark.range(11_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 9_900, "big").otherwise("small").alias("source"))
    got = sorted((r.mix_pos, r.source) for r in mixing.mix(docs, {"big": 0.9, "small": 0.1}, block=1).collect())
    assert [p for p, _ in got] == list(range(11_000))
    small = 0
    for t, (_, s) in enumerate(got):
        small += s == "small"
        assert abs(Fraction(small) - Fraction(t + 1, 10)) < 1


def test_sources_without_a_weight_follow_in_turn(spark, make):
    rows = [(i, "t", "en", s) for i, s in enumerate(["a"] * 40 + ["b"] * 10 + ["c"] * 9 + [None] * 7)]
    got = sorted(mixing.mix(make(rows), {"a": 4, "b": 1, "c": 0}, block=2).collect(), key=lambda r: r.mix_pos)
    assert [r.source for r in got[:50]].count("b") == 10 and {r.source for r in got[50:]} == {"c", None}
    assert len({r.mix_pos for r in got}) == 66 and len({r.source for r in got[50:54]}) == 2


def test_equal_keys_are_ordered_by_their_other_columns(spark, make):
    rows = [(1, f"text {i}", "en", "a") for i in range(50)]
    one, two = (sorted((r.mix_pos, r.text) for r in mixing.mix(f).collect()) for f in (make(rows), make(rows[::-1]).repartition(5)))
    assert one == two


def test_default_weights_follow_their_powers_among_many_sources(spark):
    """One source of a million rows beside 9999 of 100, and sources of every size: no share is off by more than a 32nd."""
    for sizes in ([1_000_000] + [100] * 9999, [3**k for k in range(12)], [5], [1, 1]):
        counts = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "s string, n long")
        weights = {r.s: r.w for r in mixing.source_weights(counts, None, mixing.SLOTS).collect()}
        powers, total = [n**0.7 for n in sizes], sum(weights.values())
        for i, p in enumerate(powers):
            assert weights[f"s{i}"] / total == pytest.approx(p / sum(powers), rel=1 / 30)


def test_many_unequal_sources(spark):
    """1500 sources of three sizes by default weights: every row once, every block within its window."""
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4_000, "big").when(F.col("id") < 7_500, F.concat(F.lit("m"), F.col("id") % 500)).otherwise(F.concat(F.lit("s"), F.col("id") % 1000)).alias("source"))
    got = mixing.mix(docs, block=2).collect()
    assert len({r.mix_pos for r in got}) == 9_000 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    early = [r.source for r in got if r.mix_slot < 2_000]
    powers = {"big": 4_000**0.7, "m": 500 * 7**0.7, "s": sum(n**0.7 for n in (1, 2) for _ in range(500))}
    assert early.count("big") / len(early) == pytest.approx(powers["big"] / sum(powers.values()), rel=0.1)
