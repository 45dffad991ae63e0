import random

import numpy as np
import pytest
import xxhash

from stintline.llm import simhash


def brute_fingerprint(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=2):
    of = list(range(len(ids)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                of[root(i)] = root(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c d", "ÄB aÉ x\x0by\x85z q", "the cat " * 500, " lead  and\ttrail \n"])
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("tile", [4, 4096])
def test_components_equal_brute_force(spark, make, tile, monkeypatch):
    rng = random.Random(5)
    fps, rows = [], []
    for _ in range(40):  # chains and clouds around a few centres
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            at ^= rng.choice([0, 1 << rng.randrange(64), (1 << rng.randrange(64)) | (1 << rng.randrange(64))])
            fps.append(at)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    edges = simhash.links(frame, 2, tile)
    parts = simhash.components(frame.withColumnRenamed("fp", "node"), edges).collect()
    uniq = [np.int64(r.node).astype(np.uint64).item() for r in parts]
    expect = brute_components(list(range(len(uniq))), uniq)
    got = {}
    for r, e in zip(parts, expect):
        assert got.setdefault(r.root, e) == e
    assert len(got) == len(set(expect))
    assert edges.count() < 3 * len(uniq) * (6 if tile == 4 else 1)


def chains(rng, n):
    """Edges of paths, a ring and stars over shuffled nodes, with repeated edges, both ways, and edges to themselves; the least node of each one's component."""
    names = random.Random(rng).sample(range(-10 * n, 10 * n), n)
    cuts = [0, n // 2, n // 2 + n // 4, n]
    path, ring, stars = (names[a:b] for a, b in zip(cuts, cuts[1:]))
    edges = [*zip(path, path[1:]), *zip(ring, [*ring[1:], ring[0]])]
    groups = [path, ring]
    for at in range(0, len(stars), 20):
        edges += [(stars[at], x) for x in stars[at + 1 : at + 20]]
        groups.append(stars[at : at + 20])
    edges += [(b, a) for a, b in edges[::3]] + edges[::5] + [(path[0], path[0])]
    return edges, {frozenset(g) for g in groups}


@pytest.mark.parametrize("rest", [0, 40, 4096])
def test_components_of_long_chains(spark, rest, monkeypatch):
    """Rounds alone, rounds and a rest that one task unites, and that alone give the same sets; nodes without edges are their own."""
    monkeypatch.setattr(simhash, "REST", rest)
    edges, want = chains(5, 400)
    frame = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(x,) for g in want for x in g] + [(9001,)], "node long")
    for given, extra in ((nodes, {frozenset([9001])}), (None, set())):
        got = {}
        for r in simhash.components(given, frame).collect():
            got.setdefault(r.root, []).append(r.node)
        assert all(root in found and len(found) == len(set(found)) for root, found in got.items())
        assert {frozenset(x) for x in got.values()} == want | extra
    assert simhash.components(None, frame.where("a = b")).count() == 0


def test_components_take_few_jobs(spark):
    """The driver keeps what each job leaves: four queries and a count a round (162 jobs here) took more than its memory."""
    edges, _ = chains(6, 3000)
    frame = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few-jobs", "components")
    try:
        assert simhash.components(None, frame).count() == 3000
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 12
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_every_pair_of_tiles_is_compared():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    bits = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64))])
    bits = np.unique(bits)
    bits = bits[np.bitwise_count(bits).argsort(kind="stable")]
    a, b = simhash.link_tiles(bits, None, 2)
    assert len(a) >= 690 and (np.bitwise_count(a ^ b) <= 64).all()
    x, y = simhash.link_tiles(bits[::2], bits[1::2], 2)
    assert len(x) > 300


def test_near_duplicates_on_documents(spark, awkward):
    rows = awkward.collect()
    got = simhash.near_duplicates(awkward).collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    expect = sorted(zip([r.doc_id for r in rows], fps, brute_components([r.doc_id for r in rows], fps)), key=str)
    assert sorted(((r.doc_id, np.int64(r.fp).astype(np.uint64).item(), r.component_id) for r in got), key=str) == expect


def test_keep_first_leaves_one_row_of_each_component(spark, awkward):
    kept = simhash.keep_first(awkward).collect()
    keys = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept)
    # wordless texts are one group (least key 2), the repeated row stays once
    assert keys.count(1) == 1 and 2 in keys and 3 not in keys and 4 not in keys
    assert kept[0].asDict().keys() == awkward.limit(1).collect()[0].asDict().keys()


def test_empty(spark, make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.keep_first(make([])).count() == 0


def test_a_hot_fingerprint_is_not_dealt_by_its_value(spark, make, monkeypatch):
    rows = [(i, "the same words in all of these", "en", "s") for i in range(60)] + [(100 + i, f"other words number {i} stand here", "en", "s") for i in range(20)]
    want = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(make(rows)).collect())
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    assert sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()) == want


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, folder).collect()) == want
