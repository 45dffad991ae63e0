"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import read, without

#: Buckets of the two multinomials (a power of two), labelled rows of each class that are used at most, steps of a score.
BUCKETS, LABELLED, STEPS = 1 << 15, 8192, 1000
#: Counts of prior evidence that a bucket is as frequent in the target as in the raw corpus.
PRIOR = 8.0
#: What losing a trusted document weighs against keeping a rejected one when the threshold is set.
TRUST = 4.0
MIN_WORDS, MAX_REPEAT_PERCENT, PACKED = 50, 50, 4096
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket in 1/STEPS nats, and the least score (in the same steps) that is kept; None keeps all."""

    ratios: tuple[int, ...]
    threshold: int | None


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name in ``body``, wherever the optimizer moves the whole."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: SQL for the hashes of a text's words in order (a null text has none).
_WORDS = "transform(array_remove(split(coalesce({text}, ''), '[" + _SPACE + "]+', -1), ''), w -> xxhash64(w))"
#: SQL for the buckets of a text's words and word pairs, from its words' hashes ``h``.
_GRAMS = (
    f"concat(transform(h, x -> cast(x & {BUCKETS - 1}L as int)), "
    f"transform(slice(h, 1, greatest(size(h) - 1, 0)), (x, i) -> cast(xxhash64(x, h[i + 1]) & {BUCKETS - 1}L as int)))"
)


def _repeat_words() -> str:
    """SQL for the number of words in 3-word windows that occur twice or more, from ``h``.

    A window's hash stands above its position in one number; sorted, equal windows are neighbours
    (the full hashes are compared). The positions found, each covering three words, are then
    merged. In a text of more than PACKED words the position would leave too few bits to the hash, so another window could come
    between equal ones: there pairs of hash and position are sorted, which is slower.
    """
    windows = "transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))"
    keys = "sort_array(transform(w, (x, i) -> shiftleft(x, b) | cast(i as bigint)))"
    place = "cast({} & (shiftleft(1L, b) - 1) as int)"
    same = "(shiftrightunsigned(v, b) = shiftrightunsigned({o}, b) and w[" + place.format("v") + "] = w[" + place.format("{o}") + "])"
    found = "sort_array(transform(filter(k, (v, j) -> " + " or ".join(same.format(o=o) for o in ("get(k, j - 1)", "get(k, j + 1)")) + "), v -> " + place.format("v") + "))"
    merged = "aggregate({}, struct(0L as c, -3 as p), (a, v) -> struct(a.c + least(3, v - a.p) as c, v as p), a -> a.c)"
    packed = _let("k", keys, merged.format(found))
    pairs = "sort_array(transform(w, (x, i) -> struct(x, i)))"
    twice = "sort_array(transform(filter(k, (v, j) -> get(k, j - 1).x = v.x or get(k, j + 1).x = v.x), v -> v.i))"
    return _let("b", "length(bin(size(h)))", _let("w", windows, f"if(size(h) > {PACKED}, {_let('k', pairs, merged.format(twice))}, {packed})"))


def _measured(text: str, model: Model) -> Column:
    """A struct of the base counts, ``base_failed``, ``s`` (the mean log ratio of a text's n-grams in steps) and ``kept``."""
    t, chars = f"coalesce({text}, '')", "length(translate({t}, '{c}', ''))"
    lines = _let("y", f"filter(split({t}, '\\n', -1), y -> y rlike '[^{_SPACE}]')", "size(y) - size(array_distinct(y))")
    ratios = f"from_json('{json.dumps(model.ratios, separators=(',', ':'))}', 'array<int>')"
    total = f"aggregate({_GRAMS}, 0L, (a, g) -> a + {ratios}[g])"
    counts = (
        f"struct(cast(size(h) as bigint) as n_words, cast({chars.format(t=t, c=_SPACE)} as bigint) as word_chars, "
        f"cast(length({t}) - {chars.format(t=t, c=_SYMBOLS)} as bigint) as n_symbols, cast({lines} as bigint) as n_dup_lines, "
        f"{_repeat_words()} as n_repeat_words, if(size(h) = 0, 0L, cast(floor({total} / (2 * size(h) - 1)) as bigint)) as s)"
    )
    failed = f"(m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words)"
    passed = "true" if model.threshold is None else f"m.s >= {model.threshold}"
    verdict = f"struct({', '.join('m.' + c for c in BASE)}, {failed} as base_failed, m.s, not {failed} and {passed} as kept)"
    return F.expr(_let("h", _WORDS.format(text=text), _let("m", counts, verdict)))


def _labelled(labels: DataFrame, key: str) -> DataFrame:
    """(key, good): at most LABELLED trusted and LABELLED rejected keys, the first by hash.

    Trusted: quality 1 and not toxic. Rejected: quality 0. A key labelled both ways counts as neither.
    """
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality") == 0, 0)
    known = labels.select(F.col(key).alias("__key"), good.alias("__good")).where("__key is not null and __good is not null")
    known = known.groupBy("__key").agg(F.min("__good").alias("__good"), F.max("__good").alias("__most")).where("__good = __most")
    parts = [known.where(f"__good = {g}").orderBy(F.xxhash64("__key"), "__key").limit(LABELLED) for g in (0, 1)]
    return parts[0].union(parts[1]).select("__key", "__good")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The two multinomials and the threshold.

    The raw multinomial counts the words and word pairs of every document; the target multinomial
    those of trusted labelled ones (at most LABELLED, a fixed bound, so their keys are broadcast),
    smoothed towards the raw one by PRIOR counts a bucket. Every other trusted document is kept out
    of the target, and the threshold is the score that best parts those from the rejected ones (of
    both, the texts that pass the base rules),
    a lost trusted document counting TRUST times: what is learned is judged on unseen text. Only
    BUCKETS pairs of counts and at most 2 * LABELLED scores come to the driver. Without
    trusted or without rejected documents there is no threshold.
    """
    known = F.broadcast(_labelled(labels, key))
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t")).join(known, F.col("__id") == F.col("__key"), "left")
    learns = (F.coalesce("__good", F.lit(0)) == 1) & (F.pmod(F.xxhash64("__key", F.lit("half")), F.lit(2)) == 0)
    rows = rows.withColumn("__learns", F.coalesce(learns, F.lit(False)))
    grams = F.expr(_let("h", _WORDS.format(text="__t"), _GRAMS))
    grams = rows.select(F.col("__learns").cast("bigint").alias("t"), F.explode(grams).alias("b"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect():
        raw[r.b], target[r.b] = r.n, r.t
    share = sum(target) / max(1, sum(raw))
    ratios = tuple(round(STEPS * math.log((t + PRIOR) / (n * share + PRIOR))) for t, n in zip(target, raw))
    model = Model(ratios, None)
    known = rows.where(F.col("__good").isNotNull() & ~F.col("__learns")).select("__good", _measured("__t", model).alias("m"))
    # no filter on the measures here: the optimizer would move it, and with it the measuring, before the join
    seen = known.groupBy("__good", "m.kept", "m.s").agg(F.count(F.lit(1)).alias("n")).collect()
    passing = [(r.s, r["__good"], r.n) for r in seen if r.kept]  # without a threshold: all that pass the base rules
    return Model(ratios, best_threshold(passing, TRUST))


def best_threshold(seen: list[tuple[int, int, int]], trust: float) -> int | None:
    """Of (score, good, count) rows, the least score to keep: it maximises trust * kept good + dropped bad.

    Of several the lowest; it lies midway between the scores it parts.
    """
    good, bad = (sum(n for _, g, n in seen if g == k) for k in (1, 0))
    if not good or not bad:
        return None
    best, kept, dropped, at, last = (-1.0, None), good, 0, {}, None
    for s, g, n in seen:
        at.setdefault(s, [0, 0])[g] += n
    for s in sorted(at):
        worth = trust * kept / good + dropped / bad
        if worth > best[0] + 1e-12:
            best = (worth, s if last is None else s - (s - last) // 2)
        last = s
        dropped += at[s][0]
        kept -= at[s][1]
    return best[1]


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add the base counts, ``base_failed``, ``score`` (nats a gram) and ``kept`` to every row.

    * a null text has no words and fails the base rules, as does every text under MIN_WORDS words;
    * a text passes the base rules and is kept if its score reaches the threshold;
    * the verdict depends on the text and the model alone, so repeated rows get the same one;
    * input columns with the names of result columns are replaced; an empty input gives an empty result.
    """
    added = [*BASE, "base_failed", "score", "kept"]
    rows = without(docs, *[c for c in added if c != text]).withColumn("__m", _measured(f"`{text}`", model))
    new = {c: F.col(f"__m.{c}") for c in (*BASE, "base_failed", "kept")} | {"score": F.col("__m.s") / F.lit(float(STEPS))}
    return rows.withColumns(new).drop("__m")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with.

    A null text does not pass; repeated rows all stay or all go; without labels the base rules alone decide; an empty input gives an empty result.
    """
    return docs.where(_measured(f"`{text}`", fit(docs, labels, key, text))["kept"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", *BASE, "base_failed", "kept", "score")
