"""SimHash near-dedup: fingerprints, tiled exact comparison, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.llm.common import counted, cut, read, without

RADIUS, SHINGLE, HUB_ROUNDS = 2, 3, 2
#: Rows of a tile. A pair of tiles is compared in blocks of BLOCK rows, so a task holds BLOCK * 2 * TILE bits at once.
TILE, BLOCK = 4096, 64
#: Table of hot groups up to this many rows is broadcast; beyond it the join is dealt by key. Rows of one fingerprint beyond HOT_ROWS are not dealt by it.
BROADCAST_ROWS, HOT_ROWS = 100_000, 100_000
#: Edges between sets that one task unites: what rounds leave, of a table of any size. As many as a tile has rows.
REST = TILE
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of the word shingles, repeats included; a text of at most ``shingle`` words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, 42)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; zero for a text without words."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Add the column ``fp`` (long, the fingerprint's bits; an input column of that name gives way). A null text has fingerprint zero, equal texts have equal ones."""
    column = f"`{text}`"

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series([np.uint64(fingerprint(t, shingle)).astype(np.int64) for t in texts], dtype="int64")

    return without(docs, "fp").withColumn("fp", of(F.col(column)))


class _Sets:
    """Union by smallest position within one pair of tiles."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.of, high, low)
            a, b = low, high

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.of[x]
            if np.array_equal(up, x):
                return x
            x = self.of[up]


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` between two tiles (or within one), as pairs of fingerprints.

    Both are sorted by population count; a block meets only the run of rows whose count is within
    the radius of its own. Of all links found only those that join two sets are returned, so
    the result has fewer rows than the tiles.
    """
    other = left if right is None else right
    every = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    left_n, other_n = np.bitwise_count(left).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    sets = _Sets(len(every))
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        lo = np.searchsorted(other_n, left_n[at] - radius)
        hi = np.searchsorted(other_n, left_n[min(at + BLOCK, len(left)) - 1] + radius, side="right")
        if right is None:
            lo = max(lo, at)
        if lo >= hi:
            continue
        near = np.bitwise_count(rows[:, None] ^ other[None, lo:hi]) <= radius
        own, their = sets.root(np.arange(at, at + len(rows))), sets.root(np.arange(lo, hi) + shift)
        near &= own[:, None] != their[None, :]  # in a cloud of near copies few links are left after the first block
        i, j = np.nonzero(near)
        sets.join(own[i], their[j])
    root = sets.root(np.arange(len(every)))
    moved = root != np.arange(len(every))
    return every[moved], every[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, side, fp), sorted; each run of one key is a group of at most 2 * TILE rows."""
    rest: list[np.ndarray] = []

    def columns(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])

    def links(rows: np.ndarray) -> pa.RecordBatch:
        k1, k2, side, fp = rows
        change = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(k1)]])
        sizes = ends - starts
        bits = fp.view(np.uint64)
        a, b = [], []
        small = sizes <= 16  # many small groups at once: each row against the s-th after it
        group = np.repeat(np.arange(len(sizes)), sizes)
        of_small = small[group]
        for s in range(1, int(sizes[small].max(initial=1))):
            near = (group[s:] == group[:-s]) & of_small[s:] & ((side[:-s] == 2) | (side[s:] != side[:-s]))
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(bits[at] ^ bits[at + s]) <= radius]
            a.append(bits[at])
            b.append(bits[at + s])
        for g in np.flatnonzero(~small):
            part, own = bits[starts[g] : ends[g]], side[starts[g] : ends[g]]
            by = np.bitwise_count(part).argsort(kind="stable")
            part, own = part[by], own[by]
            x, y = link_tiles(part, None, radius) if own[0] == 2 else link_tiles(part[own == 0], part[own == 1], radius)
            a.append(x)
            b.append(y)
        a, b = (np.concatenate(z or [np.zeros(0, np.uint64)]).view(np.int64) for z in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(columns(batch))
        rows = np.concatenate(rest, axis=1)
        last = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
        if len(last):
            done = last[-1] + 1
            yield links(rows[:, :done])
            rows = rows[:, done:]
        rest = [rows]
    if rest and rest[0].size:
        yield links(np.concatenate(rest, axis=1))


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, each within ``radius`` bits, that connect whatever the full set of links connects.

    ``fps`` has one row per fingerprint. Fingerprints within the radius agree on at least one of
    radius + 1 bit fields, so only rows with an equal field meet. A field value with more than
    ``tile`` rows is split into tiles by population count and hash, and only pairs of tiles
    whose counts are within the radius are dealt out; no task sees more than two tiles at once. Null fingerprints link to nothing;
    without rows there are no links.
    """
    fields = radius + 1
    edges = [64 * i // fields for i in range(fields + 1)]
    value = [F.expr(f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L)") for a, b in zip(edges, edges[1:])]
    rows = fps.select(
        "fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*value)).alias("field", "value")
    ).withColumn("k1", F.col("value") * fields + F.col("field"))
    counts = rows.groupBy("k1", "pop").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(
        counts.groupBy("k1")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("m")))).alias("tiles"))
        .where(F.col("n") > tile)
        .select("k1", "tiles")
    )
    n_hot = hot.count()
    small = F.broadcast if n_hot <= BROADCAST_ROWS else (lambda x: x)
    cold = rows if not n_hot else rows.join(small(hot.select("k1")), "k1", "left_anti")
    dealt = cold.select("k1", F.lit(0).cast("bigint").alias("k2"), F.lit(2).alias("side"), "fp", "pop")
    if n_hot:
        own = F.expr("cast(pmod(xxhash64(fp), tiles[pop]) as int)")
        other = F.expr(
            f"explode(flatten(transform(filter(map_keys(tiles), p -> abs(p - pop) <= {radius}),"
            " p -> transform(sequence(0, tiles[p] - 1), t -> struct(p as p, t as t)))))"
        )
        pairs = rows.join(small(hot), "k1").withColumn("own", own).select("k1", "fp", "pop", "own", other.alias("o"))
        first = (F.col("pop") < F.col("o.p")) | ((F.col("pop") == F.col("o.p")) & (F.col("own") <= F.col("o.t")))
        same = (F.col("pop") == F.col("o.p")) & (F.col("own") == F.col("o.t"))
        mine, theirs = F.struct(F.col("pop").alias("p"), F.col("own").alias("t")), F.col("o")
        pair = F.xxhash64(F.when(first, mine).otherwise(theirs), F.when(first, theirs).otherwise(mine))
        dealt = dealt.unionByName(
            pairs.select("k1", pair.alias("k2"), F.when(same, 2).when(first, 0).otherwise(1).alias("side"), "fp", "pop")
        )
    dealt = dealt.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "side", "pop").select("k1", "k2", "side", "fp")
    return dealt.mapInArrow(lambda it: _compare(it, radius), "a long, b long").distinct()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b), at most REST: each node with the least node that it is connected to."""
    columns = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
    if columns:
        a, b = (np.concatenate(x) for x in zip(*columns))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = _Sets(len(nodes))
        sets.join(at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[sets.root(np.arange(len(nodes)))])], names=["a", "to"])


def components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root): the connected component of every node, named by one of its nodes.

    Each round moves every set to the neighbour of least seeded hash (itself included) and
    keeps only edges between different sets. That at least halves, in expectation, the number of
    sets that still have edges, so the rounds grow with the logarithm of the number of edges. In the first HUB_ROUNDS the neighbour with
    most edges comes first: the stars that tiles and bands give then collapse at once. What is left once REST edges or fewer are, one task unites.
    Rounds are cut through the checkpoint folder; nothing but an edge count comes to the driver. Where a set went in each round is put together once, from the
    last round to the first, over fewer rows each: the driver keeps what every job leaves, so jobs are its memory. Repeated edges and edges from a node
    to itself change nothing; a node without edges is its own root, or has no row where ``nodes`` is None; without nodes there are no rows.
    """
    steps: list[DataFrame] = []
    edges, left = counted(edges.select("a", "b").where("a <> b").distinct())
    while left > REST:
        turn = len(steps) + 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, d: F.struct((-d).alias("d"), F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
        if turn <= HUB_ROUNDS:
            degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
            both = both.join(degrees.select(F.col("a").alias("b"), "d"), "b")
        else:
            both = both.withColumn("d", F.lit(0).cast("bigint"))
        own = F.count(F.lit(1)) if turn <= HUB_ROUNDS else F.lit(0).cast("bigint")
        step = both.groupBy("a").agg(F.min(rank("b", F.col("d"))).alias("m"), own.alias("d")).select("a", F.least(F.col("m"), rank("a", F.col("d")))["v"].alias("to"))
        step = cut(step)
        steps.append(step)
        at = step.select(F.col("a").alias("x"), "to")
        edges, left = counted(
            edges.join(at, F.col("a") == F.col("x")).select(F.col("to").alias("a"), "b")
            .join(at, F.col("b") == F.col("x")).select("a", F.col("to").alias("b"))
            .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    if left:
        steps.append(cut(edges.coalesce(1).mapInArrow(_unite, "a long, to long")))
    moved = None
    for step in reversed(steps):
        own = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        if moved is not None:
            later = moved.select(F.col("node").alias("x"), F.col("root").alias("then"))
            own = own.join(later, F.col("root") == F.col("x"), "left").select("node", F.coalesce("then", "root").alias("root"))
        moved = own
    if moved is None:
        moved = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))  # no rows
    if len(steps) > 1:
        moved = cut(moved)
    if nodes is None:
        return moved
    return nodes.select("node").join(moved, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _classes(docs: DataFrame, key: str, text: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every row, and (node, root, component_id) of every distinct fingerprint."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = cut(fingerprints(rows, "text", shingle).select("key", "fp"))
    least = marked.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    parts = components(least.select(F.col("fp").alias("node")), links(least.select("fp"), radius))
    named = least.join(parts, F.col("fp") == F.col("node")).select("node", "n", "least", "root")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, cut(named.join(ids, "root").select("node", "n", "root", "component_id"))


def named_rows(marked: DataFrame, named: DataFrame) -> DataFrame:
    """Every row (key, fp) with its node's class.

    A text may be copied to a third of the rows: nodes of more than HOT_ROWS rows, of which there are rows / HOT_ROWS at most,
    are sent to all tasks (if that is a small table), so that no task takes all rows of one.
    """
    named = named.select("node", "n", "root", "component_id")
    hot = named.where(F.col("n") > HOT_ROWS)
    n_hot = hot.count()
    same = F.col("fp") == F.col("node")
    if not n_hot or n_hot > BROADCAST_ROWS:
        return marked.join(named, same)
    cold = marked.join(F.broadcast(hot.select("node")), same, "left_anti").join(named.where(F.col("n") <= HOT_ROWS), same)
    return cold.unionByName(marked.join(F.broadcast(hot), same))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id): every row with its fingerprint and the least key of its component.

    * a null or wordless text has fingerprint zero and is linked like any other;
    * repeated rows keep one result row each; a null key gets a row and is never a least key
      unless all keys of its component are null (then component_id is null);
    * other columns are not looked at; an empty input gives an empty result.
    """
    marked, named = _classes(docs, key, text, radius, shingle)
    return named_rows(marked, named).select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with the least key; the columns stay as they are.

    Of rows that repeat that key within the component (and of rows without a key, where no row of
    the component has one) the first by text stays.
    """
    marked, named = _classes(docs, key, text, radius, shingle)
    return first_of_each(docs, key, text, marked, named, lambda rows: fingerprints(rows, "text", shingle))


def first_of_each(docs: DataFrame, key: str, text: str, marked: DataFrame, named: DataFrame, mark: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The document ``keep_first`` leaves of each component, given ``_classes`` of the rows and what adds ``fp`` to them."""
    own = named_rows(marked, named).withColumn("own", F.col("key").eqNullSafe(F.col("component_id")))
    keys = cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("own").select(F.col("key").alias("__key"), "n"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    once = docs.join(keys.where("n = 1 and __key is not null").select("__key"), F.col(key) == F.col("__key"), "left_semi")
    if not keys.where("n > 1 or __key is null").limit(1).count():
        return once
    # a key with several rows says not yet which of them is meant: their own fingerprints do
    again = docs.join(keys.where("n > 1 or __key is null").select("__key"), same, "left_semi")
    again = mark(again.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text")))
    again = again.join(named, F.col("fp") == F.col("node")).where(F.col("key").eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("root").orderBy("text")
    again = again.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
    return once.unionByName(again)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    near = near_duplicates(read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
