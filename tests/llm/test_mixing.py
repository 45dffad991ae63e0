import hashlib
import math

from stintline.llm import mixing


def brute_schedule(quota, period):
    given, line = [0] * len(quota), []
    for t in range(period):
        ready = [(math.ceil((given[i] + 1) * period / q), i) for i, q in enumerate(quota) if given[i] * period // q <= t]
        i = min(ready)[1]
        given[i] += 1
        line.append(i)
    return line


def test_schedule_is_earliest_deadline_first_and_less_than_a_block_off(spark):
    quota = [500, 333, 100, 60, 7]
    frame = spark.createDataFrame([(f"s{i}", q, 1000) for i, q in enumerate(quota)], "s string, quota int, period int")
    got = {r.s: list(r.slots) for r in mixing.schedule(frame).collect()}
    line = brute_schedule(quota, 1000)
    assert got == {f"s{i}": [t for t, x in enumerate(line) if x == i] for i in range(len(quota))}
    for i, q in enumerate(quota):
        done = 0
        for t in range(1000):
            done += line[t] == i
            assert abs(done - q * (t + 1) / 1000) < 1
        for k, t in enumerate(got[f"s{i}"]):
            assert k * 1000 // q <= t < math.ceil((k + 1) * 1000 / q)


def test_rows_take_their_blocks_slots(spark, make):
    rows = [(i, "t", "en", "big" if i % 4 else "small") for i in range(400)]
    got = mixing.mix(make(rows), {"big": 3, "small": 1}, block=4, slots=8).collect()
    assert len(got) == 400 and len({r.mix_pos for r in got}) == 400
    h = lambda k: int(hashlib.md5(f"{mixing.SEED}|{k}".encode()).hexdigest()[:13], 16)
    for name in ("big", "small"):
        own = sorted((r for r in got if r.source == name), key=lambda r: r.mix_pos)
        assert [r.doc_id for r in own] == sorted((r.doc_id for r in own), key=lambda k: (h(k), k))
        assert [r.mix_block for r in own] == [k // 4 for k in range(len(own))]
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in own)
    for n in (40, 200, 360):  # any prefix has three of the large to one of the small
        first = sorted(got, key=lambda r: r.mix_pos)[:n]
        assert abs(sum(r.source == "big" for r in first) - n * 0.75) <= 4
    ordered = mixing.in_order(mixing.mix(make(rows), {"big": 3, "small": 1}, block=4, slots=8)).collect()
    assert [r.mix_pos for r in ordered] == sorted(r.mix_pos for r in got)


def test_awkward(spark, awkward, monkeypatch):
    got = mixing.mix(awkward, block=2).collect()
    assert len(got) == awkward.count() == len({r.mix_pos for r in got})
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    again = mixing.mix(awkward, block=2).collect()
    assert sorted(r.mix_pos for r in again) == sorted(r.mix_pos for r in got)


def test_empty(spark, make):
    assert mixing.mix(make([])).count() == 0
