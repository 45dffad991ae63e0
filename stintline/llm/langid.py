"""Language ID with language-bitmask n-gram filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import read, without

#: N-gram lengths in characters; slots of the filter table; hash functions of an n-gram.
SIZES, SLOTS, HASHES = (3, 4), 1 << 18, 3
#: Documents of each language that filters are fitted on at most (in expectation), share of a language's n-grams
#: that an n-gram must have to enter its filter, and n-grams that a task counts at once.
FIT_DOCS, MIN_SHARE, COUNTED = 4000, 2e-5, 1 << 21
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Filters:
    """``table[slot, l // 64]`` has bit l % 64 set if some n-gram of language l hashes there; ``noise[l]`` is the chance that a foreign n-gram passes.

    A slot has as many 64-bit words as the languages need, so their number is not limited.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    noise: np.ndarray


def ngram_keys(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """64-bit keys of a text's n-grams; letters only, lower case, each run of other characters one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ~((points - 97 < 26) | (points > 127))
    points = np.where(blank, np.uint32(32), points)
    double = blank[1:] & blank[:-1]
    points = np.concatenate([points[:1], points[1:][~double]])
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint64)
    keys = []
    for size in sizes:
        n = len(points) - size + 1
        if n > 0:
            key = np.full(n, np.uint64(size))
            for i in range(size):
                key = (key ^ points[i : i + n]) * _MIX[0]
                key ^= key >> np.uint64(29)
            keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def slots_of(keys: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    """The slots of each key, one array for each hash function."""
    out = []
    for m in _MIX[1 : 1 + HASHES]:
        h = keys * m
        out.append(((h ^ (h >> np.uint64(32))) % np.uint64(slots)).astype(np.int64))
    return out


def masks(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each key the bitmask (a row of 64-bit words) of all languages whose filter holds it."""
    first, *rest = slots_of(keys, len(table))
    mask = table[first]
    for s in rest:
        mask = mask & table[s]
    return mask


def popcounts(found: np.ndarray, languages: int) -> np.ndarray:
    """For each language the number of masks that have its bit."""
    return np.array([np.count_nonzero(found[:, i // 64] & np.uint64(1 << i % 64)) for i in range(languages)], float)


def classify(text: str | None, filters: Filters) -> tuple[str, float]:
    """(language, score): most n-grams of its own after correction; score is its part of all languages' corrected counts."""
    if not text or not filters.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    hits, n = np.zeros(len(filters.languages)), 0
    for at in range(0, len(text), 1 << 20):  # a very long text by pieces; a piece's last n-grams are in the next one too
        keys = ngram_keys(text[max(0, at - max(SIZES)) : at + (1 << 20)])
        hits += popcounts(masks(keys, filters.table), len(hits))
        n += len(keys)
    fixed = np.maximum(hits - n * filters.noise, 0) / (1 - filters.noise)
    # n-grams of every language say nothing: what the least one has is common to all
    own = fixed - fixed.min() if len(fixed) > 1 else fixed
    best = int(np.argmax(own))
    return filters.languages[best], float(own[best] / own.sum()) if own.sum() > 0 else 0.0


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the labelled documents where ``train`` holds.

    An n-gram enters a language's filter if it is there twice and makes up MIN_SHARE of the language's n-grams, so a mask names the languages that have the
    n-gram more often than that; rarer ones would fill the filters and say little.
    Each language takes part with about FIT_DOCS documents, chosen by hash of the key (all of
    them, if there are fewer): a fixed bound on what the classifier is fitted on. Spark
    counts their n-grams and ORs the slots; SLOTS bitmasks come to the driver.

    * documents with a null text or language teach nothing, an empty text has one n-gram of blanks; a null key is hashed like any other;
    * a very long text is counted by pieces; without labelled documents there are no languages, and every text is ``und``.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = tuple(sorted(sizes))
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Filters((), np.zeros((SLOTS, words), np.uint64), np.zeros(0))
    part = F.pmod(F.xxhash64(F.col("key"), F.lit("fit")), F.lit(1_000_000)) / F.lit(1e6)
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, FIT_DOCS / n)]), F.col("lang"))
    chosen = rows.where(part < bound).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                held, size = [], 0
                for t in texts:
                    for at in range(0, max(len(t), 1), 1 << 20):
                        held.append(ngram_keys(t[max(0, at - max(SIZES)) : at + (1 << 20)]))
                        size += len(held[-1])
                        if size >= COUNTED:
                            yield counted(name, held)
                            held, size = [], 0
                if held:
                    yield counted(name, held)

    def counted(name: str, held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"lang": name, "key": keys.view(np.int64), "n": n})

    grams = chosen.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, max(2.0, MIN_SHARE * totals.get(k, 0)))]), F.col("lang"))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)]), F.col("lang"))

    def slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["bit"].to_numpy(np.int64)
            mask = (np.uint64(1) << (own % 64).astype(np.uint64)).view(np.int64)
            for s in slots_of(pdf["key"].to_numpy(np.int64).view(np.uint64)):
                yield pd.DataFrame({"slot": s, "word": own // 64, "mask": mask})

    held = grams.where(F.col("n") >= least).select("key", bit.alias("bit"))
    table = np.zeros((SLOTS, words), np.uint64)
    for r in held.mapInPandas(slot, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        table[r.slot, r.word] = np.int64(r["mask"]).view(np.uint64)
    return Filters(languages, table, (popcounts(table, len(languages)) / SLOTS) ** HASHES)


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; only the text is looked at.

    * a null text and a text without a letter are ``und`` with score 0, as is every text if nothing was learned;
    * a text with letters and no known n-gram gets the first language and score 0;
    * equal texts get equal results, and a very long text is read whole, by pieces; an empty input gives an empty result;
    * input columns of these names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS bitmasks, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, shipped.value) for t in texts], columns=["lang_pred", "score"])

    rows = without(docs, "lang_pred", "score").withColumn("__l", of(F.col(text)))
    return rows.withColumns({"lang_pred": F.col("__l.lang_pred"), "score": F.col("__l.score")}).drop("__l")


def held_out(key: str = "doc_id") -> Column:
    """One fifth of the documents, by crc32 of the key as text; a null key is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = read(spark, sf_dir, "documents")
    filters = fit(docs, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
