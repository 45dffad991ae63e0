"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter under both orders, Lyndon roots extended into runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import read, without

#: Words of the shortest run reported; a run also repeats its period twice or more.
SHORTEST = 12
RUN = "struct<start: bigint, length: bigint, period: bigint>"
Words = Callable[[int | None, bytes], list[bytes]]


def split_words(_: int | None, text: bytes) -> list[bytes]:
    """Words of a text, apart by ASCII white space (so does ``bytes.split``)."""
    return text.split()


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by grouping suffixes as Baier's phase one does.

    Suffixes lie in groups with a shared context, ordered; the groups are done from the highest down. Each member of a group points
    at the nearest suffix to its left in a group still to be done, whose context it continues: suffixes pointed at l times move
    into a new group right above their own, with their context and l times the one just done. A suffix's context, when its
    group's turn comes, is its longest Lyndon prefix. Places already done are skipped by linking them to their left neighbour.
    """
    n = len(codes)
    order = sorted(range(n), key=codes.__getitem__)
    where, group, stop, context = [0] * n, [0] * n, {}, {}
    first = 0
    for place, i in enumerate(order):
        if place and codes[i] != codes[order[place - 1]]:
            stop[first] = first = place
        where[i], group[i] = place, first
        context[first] = 1
    stop[first] = n
    left, lengths = list(range(n + 1)), [0] * n  # left[i + 1] leads to the nearest place up to i that is still to be done, as place + 1
    high = n
    while high:
        low = group[order[high - 1]]
        members, length = order[low:high], context[low]
        for i in members:
            left[i + 1] = i
            lengths[i] = length
        pointed: dict[int, int] = {}
        for i in members:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            if j:
                pointed[j - 1] = pointed.get(j - 1, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, times in pointed.items():
            by_count[times][group[j]].append(j)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                end = stop[old]
                new = end - len(moved)
                for j in moved:  # to the end of what is left of its group
                    end -= 1
                    other, place = order[end], where[j]
                    order[place], where[other] = other, place
                    order[end], where[j] = j, end
                    group[j] = new
                context[new] = context[old] + times * length
                if new > old:  # else the whole group has moved, and keeps its place
                    stop[new], stop[old] = stop[old], new
        high = low
    return lengths


class Extensions:
    """Common extensions of many pairs of places at once: prefix hashes, and a binary search over lengths."""

    def __init__(self, codes: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        base = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        n = len(codes)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        back = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        back[0] = 1
        values = rng.integers(1 << 63, size=int(codes.max(initial=0)) + 1, dtype=np.uint64)
        self.n, self.back = n, np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[codes] * np.multiply.accumulate(powers)[:n], dtype=np.uint64)])

    def _hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places from a and from b (a < b) on are equal."""
        found = np.zeros(len(a), np.int64)
        for bit in reversed(range(max(1, self.n).bit_length())):
            size = 1 << bit
            open_ = np.flatnonzero(b + found + size <= self.n)
            x, y = (a + found)[open_], (b + found)[open_]
            found[open_[self._hash(x, size) == self._hash(y, size)]] += size
        return found

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places before a and before b (a < b) are equal."""
        found = np.zeros(len(a), np.int64)
        for bit in reversed(range(max(1, self.n).bit_length())):
            size = 1 << bit
            open_ = np.flatnonzero(a - found - size >= 0)
            x, y = (a - found - size)[open_], (b - found - size)[open_]
            found[open_[self._hash(x, size) == self._hash(y, size)]] += size
        return found


def find_runs(codes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of a sequence as rows (start, length, period), ordered: every run has a longest Lyndon word of one of the two orders as a root.

    Extensions come from hashes, so each run is compared word by word afterwards; if one fails, all are done again with other hashes.
    """
    n = len(codes)
    if n < shortest:
        return np.zeros((0, 3), np.int64)
    codes = np.unique(codes, return_inverse=True)[1]
    at = np.tile(np.arange(n), 2)
    period = np.array(lyndon_lengths(codes.tolist()) + lyndon_lengths((codes.max() - codes).tolist()), np.int64)
    seed = 0
    while True:
        ext = Extensions(codes, seed)
        before, after = ext.left(at, at + period), ext.right(at, at + period)
        length = before + period + after
        long = length >= np.maximum(shortest, 2 * period)
        found = np.unique(np.stack([at - before, length, period], axis=1)[long], axis=0)
        if all(_is_run(codes, *row) for row in found.tolist()):
            return found[np.lexsort((found[:, 2], found[:, 0]))]
        seed += 1


def _is_run(codes: np.ndarray, start: int, length: int, period: int) -> bool:
    end = start + length
    return (
        np.array_equal(codes[start : end - period], codes[start + period : end])
        and (start == 0 or codes[start - 1] != codes[start - 1 + period])
        and (end == len(codes) or codes[end] != codes[end - period])
    )


def repeated(codes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """True where a word lies in a window of ``size`` words that its owner has twice or more (by hash, so now and then where it does not)."""
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(codes) < size:
        return covered[:-1] > 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = len(codes) - size + 1
    hashes = owner[:windows].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(size):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + windows]
    inside = np.flatnonzero(owner[:windows] == owner[size - 1 :])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order][1:] == hashes[order][:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + size, -1)
    return np.cumsum(covered[:-1]) > 0


def runs_of(docs: list[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Runs of each word list. A run's word lies in a window of half the shortest length that is there twice, so only such stretches are sorted.

    The stretches of all lists form one sequence with a separator of its own after each, which no run can cross.
    """
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for words in docs for w in words], np.int64)
    sizes = np.array([len(words) for words in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    first = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    places = np.flatnonzero(repeated(codes, owner, shortest // 2))
    if not len(places):
        return out
    breaks = np.flatnonzero((np.diff(places) > 1) | (np.diff(owner[places]) > 0)) + 1
    sequence = np.insert(codes[places], breaks, len(number) + np.arange(len(breaks)))
    origin = np.insert(places, breaks, -1)
    for start, length, period in find_runs(sequence, shortest).tolist():
        word = int(origin[start])
        doc = int(owner[word])
        out[doc].append((word - int(first[doc]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces; of each run only the first period stays."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0))


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = SHORTEST, words: Words = split_words) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed`` (the text, each run cut to one period).

    ``words`` makes the words of a text (it also gets the id). Every row is worked on by itself, whole, in its task: nothing is
    shuffled, and memory follows the Arrow batch or the longest text.

    * a null or empty text has no words, no runs and an empty ``collapsed``; repeated rows get equal results, a null id is a row like any;
    * runs of equal length are all reported; input columns with the names of result columns are replaced; an empty input gives an empty result.
    """
    rows = without(docs, "n_words", "runs", "collapsed")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(doc_id).to_pylist()
            split = [words(i, t or b"") for i, t in zip(ids, batch.column(text).cast(pa.binary()).to_pylist())]
            runs = runs_of(split, shortest)
            made = [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind),
                pa.array([collapse(w, r) for w, r in zip(split, runs)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, f"{fields}, n_words bigint, runs array<{RUN}>, collapsed string")


def with_planted_tails(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words of a text, in one document of ten with its tail made periodic, by the CRC-32 of the decimal id (a null id: of the empty string)."""
    words = text.split()
    chance = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), chance // 10
    if chance % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * ((n - start) // period + 1))[: n - start]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with its planted tail: their number, the longest, and digests of all runs and of the collapsed text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, words=with_planted_tails).drop("text")
    best = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] > b["length"], -1).when(a["length"] < b["length"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.signum(a["period"] - b["period"]).cast("int"))), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
