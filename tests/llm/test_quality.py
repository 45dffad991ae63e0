import math
import re
from collections import Counter

import numpy as np
import xxhash

from stintline.llm import quality

MASK = quality.BUCKETS - 1


def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), seed)
    return seed


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def grams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x & MASK for x in h] + [hash_longs(p) & MASK for p in zip(h, h[1:])]


def corpus(make, spark):
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}#" for i in range(60)]
    rows = []
    for i in range(90):
        words = rng.choice(bad if i % 3 == 0 else good, rng.integers(40, 120))
        rows.append((i, " ".join(words) + "\nsame line\nsame line" * (i % 2), "en", "s"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(70)], "doc_id long, quality int, toxic int")
    return make(rows), rows, labels


def test_counts_score_and_verdict_equal_brute_force(spark, make):
    docs, rows, labels = corpus(make, spark)
    model = quality.fit(docs, labels)
    learns = {i for i in range(70) if i % 3 and _learns(spark, i)}
    raw = Counter(g for r in rows for g in grams(r[1]))
    target = Counter(g for r in rows if r[0] in learns for g in grams(r[1]))
    share = sum(target.values()) / sum(raw.values())
    ratio = [round(quality.STEPS * math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))) for b in range(quality.BUCKETS)]
    assert list(model.ratios) == ratio
    for r in quality.judge(docs, model).collect():
        expect = brute(r.text)
        score = sum(ratio[g] for g in grams(r.text)) // len(grams(r.text))
        assert {k: r[k] for k in expect} == expect and round(r.score * quality.STEPS) == score
        assert r.kept == (not r.base_failed and score >= model.threshold)
        assert r.base_failed or r.kept == (r.doc_id % 3 != 0)
    assert quality.keep_good(docs, labels).columns == docs.columns


def _learns(spark, key):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast("long"), F.lit("half")), F.lit(2)) == 0).first()[0]


def test_awkward_texts(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward, none)
    assert model.threshold is None and set(model.ratios) == {0}
    got = quality.judge(awkward, model).collect()
    assert len(got) == awkward.count()
    for r in got:
        expect = brute(r.text)
        assert {k: r[k] for k in expect} == expect and r.kept == (not r.base_failed)


def test_repeats_next_to_each_other(spark, make):
    texts = ["a b c a b c", "a a a a", "a a a", "a b a b a", "x y z w x y z", "p q r s t", " ".join("abcab" * 30), "a b"]
    for r in quality.judge(make([(i, t, "en", "s") for i, t in enumerate(texts)]), quality.Model((0,) * quality.BUCKETS, None)).collect():
        assert r.n_repeat_words == brute(r.text)["n_repeat_words"], r.text


def test_threshold():
    assert quality.best_threshold([(0, 0, 5), (10, 1, 5)], 1.0) == 5
    assert quality.best_threshold([(3, 1, 5)], 1.0) is None and quality.best_threshold([], 1.0) is None


def test_empty(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(make([]), none).count() == 0


def test_long_texts_count_repeats_the_slow_way(spark, make, monkeypatch):
    monkeypatch.setattr(quality, "PACKED", 3)
    texts = ["a b c a b c", "a a a a", "a a a", "a b a b a", "x y z w x y z", "p q r s t", " ".join("abcab" * 30), "a b", " ".join(str(i % 97) for i in range(500))]
    for r in quality.judge(make([(i, t, "en", "s") for i, t in enumerate(texts)]), quality.Model((0,) * quality.BUCKETS, None)).collect():
        assert r.n_repeat_words == brute(r.text)["n_repeat_words"], r.text


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = quality.op3_quality(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        expect = brute(texts[r.doc_id])
        assert {k: r[k] for k in expect} == expect and not (r.base_failed and r.kept)
