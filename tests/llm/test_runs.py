"""Periodic runs against brute force, planted tails, and awkward rows."""

import hashlib
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stintline.llm import runs

SF = "/root/testdata/sf0.001"


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(words, shortest):
    """Maximal stretches for each period, kept where that is the smallest period."""
    found = set()
    n = len(words)
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            if length >= max(shortest, 2 * q) and smallest_period(words[i : i + min(length, 2 * q)]) == q:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def longest_lyndon(x, i):
    best = 1
    for j in range(i + 1, len(x) + 1):
        w = x[i:j]
        if all(w < w[k:] for k in range(1, len(w))):
            best = j - i
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=24))
def test_lyndon_lengths_under_both_orders(x):
    assert runs.lyndon_lengths(x) == [longest_lyndon(x, i) for i in range(len(x))]
    y = [2 - c for c in x]
    assert runs.lyndon_lengths(y) == [longest_lyndon(y, i) for i in range(len(y))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=4), st.sampled_from([2, 5, 12, 13]))
def test_runs_of_many_lists(lists, shortest):
    docs = [[b"w%d" % c for c in x] for x in lists]
    assert runs.runs_of(docs, shortest) == [brute(x, shortest) for x in lists]


def test_nested_and_long_runs():
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for x in (list(fib[-1]), list("ab" * 100 + "c" + "ab" * 90), list("x" * 500), list(("abcabd" * 9 + "abd" * 7) * 3)):
        docs = [[c.encode() for c in x]]
        assert runs.runs_of(docs) == [brute(x, 12)]


def test_false_hashes_are_seen(monkeypatch):
    """With hashes that are all equal every extension is too long; the check sees it and the next seed is right."""
    real = runs.Extensions._hash
    seeds = []
    init = runs.Extensions.__init__

    def noted(self, codes, seed):
        seeds.append(seed)
        init(self, codes, seed)

    monkeypatch.setattr(runs.Extensions, "__init__", noted)
    monkeypatch.setattr(runs.Extensions, "_hash", lambda self, at, size: real(self, at, size) * np.uint64(len(seeds) > 1))
    x = list("abcd" * 6 + "efghij" * 4)
    assert runs.runs_of([[c.encode() for c in x]]) == [brute(x, 12)]
    assert seeds == [0, 1]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        len(found),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in runs.op11_runs(spark, SF).collect()}
    small = [r for r in rows if len((r.text or "").split()) < 250]
    assert len(got) == len(rows) and len(small) > 80
    assert any(got[r.doc_id][0] for r in small)
    for r in small:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_awkward_rows(spark, awkward):
    got = runs.periodic_runs(awkward)
    rows = got.select("doc_id", "text", "n_words", "runs", "collapsed", "n", "kept").collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[(None, None)].runs == [] and by[(None, None)].collapsed == "" and by[(3, "")].n_words == 0
    long = by[(5, "wort " * 20000)]
    assert [tuple(x) for x in long.runs] == [(0, 20000, 1)] and long.collapsed == "wort"
    assert all(r.n == "own" and r.kept == "own" for r in rows)
    assert runs.periodic_runs(awkward.limit(0)).count() == 0
    assert runs.periodic_runs(awkward.withColumnRenamed("n", "runs")).columns.count("runs") == 1


@pytest.mark.parametrize("text", ["", " ", "one", "a b " * 5, "a b " * 6, "a " * 11, "a " * 12])
def test_bounds(text):
    words = text.split()
    assert runs.runs_of([[w.encode() for w in words]]) == [brute(words, 12)]
