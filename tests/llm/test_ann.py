import numpy as np
import pytest

from stintline.llm import ann


def exact(rows, k):
    """Brute force over (id, vector) rows that take part."""
    rows = {i: v for i, v in rows}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    out = {}
    for n, q in enumerate(ids):
        if q % 20 == 0:
            score = x @ x[n]
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
            out[q] = [(ids[i], score[i]) for i in order]
    return out


def run(spark, rows, k=20, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.search(frame, ann.F.col("vec_id") % 20 == 0, k, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 400)
    monkeypatch.setattr(ann, "QUERIES", 20)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 30)).astype(np.float32)
    x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    got = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    want = exact([(i, v.astype(float)) for i, v in enumerate(x)], 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert hits >= 0.9
    for q, near in got.items():
        assert all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for i, s in near)
        assert near == sorted(near, key=lambda y: (-y[1], y[0]))


def test_the_parallel_residual_costs_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    plain, aware = ann.Codebook(ann.train(x).words, 1.0, 16), ann.train(x)
    assert aware.eta == 1.0 or aware.eta > 0
    book = ann.Codebook(aware.words, 6.0, 16)

    def along(b):
        codes = ann.encode(b, x)
        r = x - np.concatenate([b.words[s][codes[:, s]] for s in range(codes.shape[1])], 1)
        return np.mean((r * x).sum(1) ** 2 / (x * x).sum(1))

    assert along(book) < along(plain)


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same, 0) for i in range(60)] + [(i, [0.5, 0.1, float(i % 3)], 1) for i in range(60, 75)]
    bad = [(100, None, 0), (120, [0.0, 0.0, 0.0], 0), (140, [1.0, None, 2.0], 0), (160, [1.0, float("nan"), 2.0], 0), (180, [1.0, float("inf"), 2.0], 0), (200, [1.0, 2.0], 0), (None, same, 0), (220, [], 0)]
    got = run(spark, [*rows, *bad, rows[3]])
    want = exact([(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]) == {0: [(1, 0.0)]}
    assert run(spark, []) == {} and run(spark, [(0, None, 0)]) == {}


def test_registered_query_by_cells_at_two_sizes(spark, monkeypatch):
    """Recall of the whole query with many cells, and rows sent to blocks that follow the vectors, not their square."""
    monkeypatch.setattr(ann, "CANDIDATES", 300)
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding]
        rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
        want, got = exact(rows, 20), {}
        for r in ann.op8_ann(spark, folder).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got.keys() == want.keys() and all(len(v) == min(20, len(rows) - 1) for v in got.values())
        hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
        assert hits >= 0.9


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 24)) * 3
    x = middles[rng.integers(40, size=6000)] + rng.normal(size=(6000, 24)) * 0.3
    index = ann.learn(x, 40, float(np.abs(x).max()), 20)
    assert 1 <= index.visits <= 10
    asked = x[:50]
    near = np.argsort(-(asked @ x.T), axis=1)[:, :20]
    home = index.home(x)
    assert np.mean([home[i] in index.tour(asked)[n] for n in range(50) for i in near[n]]) >= 0.9


def test_very_large_and_very_small_vectors(spark):
    for factor in (1e150, 1e-150):
        rng = np.random.default_rng(4)
        x = rng.normal(size=(60, 6)) * factor
        frame = spark.createDataFrame([(i, v.tolist(), "other") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
        got = {}
        for r in ann.search(frame, ann.F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = exact(list(enumerate(x)), 20)
        assert got == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("shape", ["tight clusters", "few strong directions", "common mean", "heavy norms"])
def test_every_query_of_other_shapes(spark, monkeypatch, shape):
    """Vectors that the codes hardly tell apart, or that lie far from their cell's centre: each query finds its neighbours, not only most queries."""
    monkeypatch.setattr(ann, "CANDIDATES", 1200)
    monkeypatch.setattr(ann, "QUERIES", 100)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 32))
    if shape == "tight clusters":
        x = rng.normal(size=(5, 32))[rng.integers(5, size=4000)] + 0.02 * x
    elif shape == "few strong directions":
        x *= np.arange(1, 33) ** -1.5
    elif shape == "common mean":
        x = 3 + 0.05 * x
    else:
        x *= np.exp(2 * rng.normal(size=(4000, 1)))
    x = x.astype(np.float32)
    got = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    want = exact([(i, v.astype(float)) for i, v in enumerate(x)], 20)
    assert got.keys() == want.keys()
    assert min(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 18
