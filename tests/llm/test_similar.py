"""Near copies by five-word similarity, against brute force and with planted edits."""

import random

import corpus_pipeline as cp
import pytest

from stintline.llm import similar, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                of[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(rows))]


def edited():
    """Texts of 12 to 900 words with copies that have one to many words replaced, so that similarities lie on both sides of 0.8."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for base in range(60):
        words = [word() for _ in range(rng.choice([12, 30, 60, 150, 400, 900]))]
        rows.append((base * 100, " ".join(words)))
        for copy in range(rng.randint(0, 5)):
            other = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 30))):
                other[rng.randrange(len(other))] = word()
            rows.append((base * 100 + copy + 1, " ".join(other)))
    return rows


@pytest.mark.parametrize("tile", [3, 256])
def test_components_equal_brute_force(spark, make, tile, monkeypatch):
    monkeypatch.setattr(similar, "TILE", tile)
    rows = [*edited(), (None, "a b c"), (9001, None), (9002, " "), (9003, "A  b c"), (9004, "one two")]
    want = brute(rows)
    got = {(r.doc_id, r.component_id) for r in similar.near_copies(make([(k, t, "en", "s") for k, t in rows])).collect()}
    assert got == {(k, c) for (k, _), c in zip(rows, want)}
    assert len(set(want)) < len(rows) - 40


def test_stage_removes_planted_copies_and_keeps_the_rest(spark, make):
    rows = edited()
    docs = make([(k, t, "en", "s") for k, t in rows])
    kept = {r.doc_id for r in cp.one_of_each(spark, docs, "").collect()}
    assert kept == set(brute(rows))
    by_id = dict(rows)
    pairs = [(a, b) for a in by_id for b in by_id if a < b and a // 100 == b // 100 and jaccard(shingles(by_id[a]), shingles(by_id[b])) >= 0.8]
    far = [p for p in pairs if bin(simhash.fingerprint(by_id[p[0]]) ^ simhash.fingerprint(by_id[p[1]])).count("1") > 2]
    assert len(far) > 20 and not any(a in kept and b in kept for a, b in far)


def test_awkward_and_empty(spark, make, awkward):
    kept = similar.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(brute([(r.doc_id, r.text) for r in awkward.collect()])))
    assert similar.keep_first(make([])).count() == 0


@pytest.mark.parametrize("tile", [7, 65536])
def test_simhash_tiles_propose_the_groups(spark, tile, monkeypatch):
    """The groups are the chains of fingerprints within the radius, of sizes that allow the similarity, however the table is tiled."""
    monkeypatch.setattr(similar, "PRINTS", tile)
    texts = sorted({t for _, t in edited()})
    sets = [similar.shingle_set(t) for t in texts]
    prints = [similar.print_of(s) for s in sets]
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            words = [bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(prints[i], prints[j])]
            fit = 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j]))
            if fit and sum(words[:2]) <= similar.RADIUS[0] and sum(words) <= similar.RADIUS[1]:
                of[root(i)] = root(j)
    want = {}
    for i in range(len(sets)):
        want.setdefault(root(i), set()).add(i)
    frame = spark.createDataFrame([(i, len(s), p.tolist()) for i, (s, p) in enumerate(zip(sets, prints))], "node long, size int, prints array<long>")
    got = {}
    for r in similar.proposed(frame).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1) and len(got) > 20


def test_bits_apart_stay_within_the_radius():
    """Pairs at 0.8 of every shape stay well within both bounds, unrelated sets beyond them; the first word is the plain SimHash."""
    import numpy as np

    rng = np.random.default_rng(8)
    for common, one, two in [(4, 0, 1), (12, 1, 2), (12, 0, 3), (80, 10, 10), (400, 0, 100)]:
        for _ in range(400):
            h = rng.integers(0, 2**63, common + one + two, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, common + one + two, dtype=np.uint64)
            a, b = h[: common + one], np.concatenate([h[:common], h[common + one :]])
            p, q = (similar.print_of(np.sort(s)).view(np.uint64)[None] for s in (a, b))
            assert similar.near(p, q).all()
            assert not similar.near(p, similar.print_of(~a * np.uint64(7)).view(np.uint64)[None]).any() or common < 80
            assert int(p[0, 0]) == int(np.packbits(2 * np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) > len(a), bitorder="little").view(np.uint64)[0])
