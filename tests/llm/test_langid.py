import numpy as np

from stintline.llm import langid

WORDS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["straße", "über", "wohl", "und"], "cc": ["été", "leçon", "où", "quoi"]}


def corpus(make, n=240):
    rng = np.random.default_rng(1)
    return make([(i, " ".join(rng.choice(WORDS[k], 40)), k, "s") for i in range(n) for k in [list(WORDS)[i % 3]]])


def test_held_out_accuracy(spark, make):
    docs = corpus(make)
    filters = langid.fit(docs, ~langid.held_out())
    got = langid.predict(docs.withColumn("held_out", langid.held_out()), filters).collect()
    assert sum(r.held_out for r in got) > 20
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)


def test_masks_name_every_language_that_holds_an_ngram(spark, make):
    filters = langid.fit(corpus(make), langid.F.lit(True))
    for i, name in enumerate(filters.languages):
        keys = langid.ngram_keys(" ".join(WORDS[name]))
        assert np.mean(langid.masks(keys, filters.table) >> np.uint64(i) & np.uint64(1)) > 0.8
    noise = langid.masks(np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64), filters.table)
    for i in range(3):
        seen = np.mean(noise >> np.uint64(i) & np.uint64(1))
        assert abs(seen - filters.noise[i]) < 0.001


def test_awkward(spark, make, awkward):
    filters = langid.fit(corpus(make), langid.F.lit(True))
    got = langid.predict(awkward, filters).collect()
    assert len(got) == awkward.count()
    for r in got:
        blank = not (r.text and any(c.isalpha() for c in r.text))
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1 and (not blank or r.score == 0)
    none = langid.fit(awkward, langid.F.lit(False))
    assert {r.lang_pred for r in langid.predict(awkward, none).collect()} == {"und"}


def test_empty(spark, make):
    assert langid.predict(make([]), langid.fit(make([]), langid.F.lit(True))).count() == 0
