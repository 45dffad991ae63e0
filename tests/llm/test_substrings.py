"""Repeated byte strings against brute force, the suffix sort, hot minimizers and awkward rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stintline.llm import substrings as sub

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, text) rows to (bytes, removed, spans, kept)."""
    least = {}
    raws = [(sub.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - 49):
            g = raw[k : k + 50]
            least[g] = min(i, least.get(g, i))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        flags = bytes(gone)
        out.append((i, len(raw), sum(flags), sum(1 for f in flags.split(b"\0") if f), bytes(c for c, f in zip(raw, flags) if not f)))
    return sorted(out)


def got(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "spans", "kept").collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed
    return sorted((sub.LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=400))
def test_suffix_sort(x):
    data = np.array(x, np.uint8)
    padded = bytes(x) + b"\0" * sub.DEPTH
    for groups in (np.zeros(len(x), np.int64), np.arange(len(x)) % 3, np.arange(len(x)) // 7 * np.array([1, 5])[np.arange(len(x)) // 60 % 2]):
        order = sub.Suffixes(data).sort(np.arange(len(x)), groups)
        cut = [(groups[i], padded[i : i + sub.DEPTH - 1]) for i in order]
        assert sorted(order.tolist()) == list(range(len(x))) and all(a <= b for a, b in zip(cut, cut[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=120, max_size=300), st.lists(st.tuples(st.integers(0, 60), st.integers(50, 113)), min_size=1, max_size=40))
def test_equal_classes(x, cuts):
    data = np.array(x, np.uint8)
    cuts = [(min(s, len(x) - 113 if len(x) > 113 else 0), n) for s, n in cuts]
    found = sub.equal_classes(data, np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts]), np.zeros(len(cuts), np.int64))
    strings = [bytes(x[s : s + n]) for s, n in cuts]
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            assert (a == b) == (found[i] == found[j])


def test_false_hashes_are_seen(monkeypatch):
    """With hashes that are all equal neighbours seem to share everything; the bytes are compared and the next seed is right."""
    seeds = []
    init = sub.Suffixes.__init__

    def noted(self, data, seed=0):
        seeds.append(seed)
        init(self, data, seed)
        if seed == 0:
            self.sums[:] = 0

    monkeypatch.setattr(sub.Suffixes, "__init__", noted)
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    assert len(set(sub.equal_classes(data, np.arange(100), np.full(100, 50), np.zeros(100)).tolist())) == 100
    assert seeds == [0, 1]


def test_pieces_cover_every_string_once():
    rng = random.Random(3)
    texts = [rng.randbytes(n) for n in (0, 49, 50, 51, 700)] + [b"a" * 400, b"ab" * 300]
    number, start, strings, key = sub.pieces_of(texts)
    seen = sorted((int(n), int(s) + k) for n, s, c in zip(number, start, strings) for k in range(int(c)))
    assert seen == [(n, k) for n, t in enumerate(texts) for k in range(max(0, len(t) - 49))]
    assert strings.max() <= sub.LONGEST


def test_long_texts_in_parts(monkeypatch):
    texts = [random.Random(5).randbytes(1000), b"x" * 60]
    whole = sub.pieces_of(texts)
    monkeypatch.setattr(sub, "SLICE_BYTES", 130)
    number, start, strings, _ = sub.pieces_of(texts)
    cover = lambda n, s, c: sorted((int(a), int(b) + k) for a, b, d in zip(n, s, c) for k in range(int(d)))
    assert cover(number, start, strings) == cover(*whole[:3])


def shared_rows(seed, docs=60):
    """Random texts with passages of 40 to 200 bytes that many share, near copies and exact copies."""
    rng = random.Random(seed)
    alphabet = "abcdé fgh"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randint(40, 200)) for _ in range(5)]
    rows = []
    for _ in range(docs):
        text = word(rng.randint(0, 120)).join(rng.sample(passages, rng.randint(0, 3)) + [word(rng.randint(0, 90)), word(rng.randint(0, 90))])
        rows.append((rng.randint(0, 2 * docs), text))
        if rng.random() < 0.3:
            rows.append((rng.randint(0, 2 * docs), text if rng.random() < 0.5 else text[:60] + "#" + text[60:]))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "bucket_bytes": 4000}, {"block_bytes": 1500, "bucket_bytes": 3000, "hot_pieces": 3}])
def test_against_brute_force(spark, sizes):
    rows = shared_rows(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = brute(rows)
    assert any(0 < w[2] < w[1] for w in wanted)
    assert got(sub.remove_repeats(df, **sizes)) == wanted


def test_tasks_by_themselves(monkeypatch):
    """Blocks, buckets and slices of a few strings, without Spark: the same result for many sizes."""
    for seed in range(6):
        rows = shared_rows(seed, 25)
        wanted = brute(rows)
        for blocks, buckets, hot, size in ((1, 1, 10**9, 1 << 20), (3, 2, 10**9, 700), (4, 3, 2, 1 << 20)):
            monkeypatch.setattr(sub, "SLICE_BYTES", size)
            tables = [pa.table({"doc_id": [i for i, _ in part], "text": [t for _, t in part], sub.HOME: [b] * len(part)}) for b in range(blocks) if (part := rows[b::blocks])]
            names = {"doc_id": "doc_id", "text": "text"}
            pick = lambda t, c, v: t.filter(pa.compute.equal(t.column(c), v))
            keys = pa.concat_tables([sub.send_keys(t, **names, buckets=buckets) for t in tables])
            flags = pa.concat_tables([sub.shared_keys(pick(keys, "bucket", b), hot) for b in range(buckets) if b in keys.column("bucket").to_pylist()])
            pieces = pa.concat_tables([sub.send_pieces(t, pick(flags, "block", t.column(sub.HOME)[0].as_py()), **names, buckets=buckets) for t in tables])
            spans = pa.concat_tables([sub.sort_bucket(pick(pieces, "bucket", b)) for b in set(pieces.column("bucket").to_pylist())])
            out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
            kept = [r for t in tables for r in sub.remove_spans(t, pick(spans, "block", t.column(sub.HOME)[0].as_py()), **names, schema=out).to_pylist()]
            assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in kept) == wanted


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute(rows)]
    assert sorted(tuple(r) for r in sub.op13_substrings(spark, SF).collect()) == wanted
    assert sum(w[2] for w in wanted) > 0


def test_awkward_rows(spark, awkward):
    copies = awkward.unionByName(awkward.where("doc_id in (5, 6)").selectExpr("doc_id + 100 as doc_id", *[f"`{c}`" for c in awkward.columns if c != "doc_id"]))
    result = sub.remove_repeats(copies.withColumnRenamed("n", "spans"))
    rows = [(r.doc_id, r.text) for r in copies.select("doc_id", "text").collect()]
    assert got(result) == brute(rows)
    assert result.columns.count("spans") == 1 and result.where("block <> 'own'").count() == 0
    assert sub.remove_repeats(copies.limit(0)).count() == 0
