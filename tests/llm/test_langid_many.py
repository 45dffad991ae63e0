"""Seventy languages against a brute-force version in plain Python: filters, masks, counts, correction and verdict."""

from collections import Counter

import numpy as np
import pytest

from stintline.llm import langid

MOD = 2**64


def brute_grams(text):
    """N-grams of a text as strings: letters stay, every run of other ASCII characters is one blank."""
    marks = [c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()]
    kept = [c for i, c in enumerate(marks) if not (c == " " and i and marks[i - 1] == " ")]
    line = " " + "".join(kept) + " "
    return [line[i : i + n] for n in langid.SIZES for i in range(len(line) - n + 1)]


def brute_slots(gram):
    mix = [int(m) for m in langid._MIX]
    key = len(gram)
    for c in gram:
        key = (key ^ ord(c)) * mix[0] % MOD
        key ^= key >> 29
    out = []
    for m in mix[1 : 1 + langid.HASHES]:
        h = key * m % MOD
        out.append((h ^ (h >> 32)) % langid.SLOTS)
    return out


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for k in range(70):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyzäöüßéèçñ"))[:9]
        words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(25)]
        for _ in range(9):
            rows.append((n, " ".join(rng.choice(words, 30)) + ", 12!", f"l{k:02d}", "s"))
            n += 1
    schema = "doc_id long, text string, lang string, source string"
    return rows, spark.createDataFrame(rows, schema)


def test_brute_force(many):
    rows, docs = many
    filters = langid.fit(docs, ~langid.held_out())
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    assert filters.languages == tuple(f"l{k:02d}" for k in range(70)) and filters.table.shape[1] == 2
    table = {}
    for i, name in enumerate(filters.languages):
        counts = Counter(g for d, t, lang, _ in rows if lang == name and d not in held for g in brute_grams(t))
        total = sum(counts.values())
        for g, n in counts.items():
            if n >= max(2.0, langid.MIN_SHARE * total):
                for s in brute_slots(g):
                    table.setdefault(s, set()).add(i)
    got = {int(s): {i for i in range(70) if int(filters.table[s, i // 64]) >> (i % 64) & 1} for s in np.flatnonzero(filters.table.any(axis=1))}
    assert got == table
    fill = [sum(i in x for x in table.values()) / langid.SLOTS for i in range(70)]
    assert np.allclose(filters.noise, np.array(fill) ** langid.HASHES)
    found = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    for d, t, lang, _ in rows[::7]:
        grams = brute_grams(t)
        hits = [0] * 70
        for g in grams:
            for i in set.intersection(*[table.get(s, set()) for s in brute_slots(g)]):
                hits[i] += 1
        fixed = [max(h - len(grams) * p, 0) / (1 - p) for h, p in zip(hits, filters.noise)]
        own = [f - min(fixed) for f in fixed]
        best = own.index(max(own))
        assert found[d].lang_pred == filters.languages[best] and found[d].score == pytest.approx(own[best] / sum(own))
    assert np.mean([found[d].lang_pred == lang for d, _, lang, _ in rows if d in held]) > 0.95
    assert {found[d].lang_pred for d, *_ in rows} == set(filters.languages)


def test_counting_by_pieces_changes_nothing(many, monkeypatch):
    _, docs = many
    whole = langid.fit(docs, langid.F.lit(True))
    monkeypatch.setattr(langid, "COUNTED", 50)
    parts = langid.fit(docs, langid.F.lit(True))
    assert np.array_equal(whole.table, parts.table)


def test_registered_query(spark):
    got = langid.op2_langid(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.doc_id for r in rows) == sorted(lang)
    known = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.95 * len(known) > 0
