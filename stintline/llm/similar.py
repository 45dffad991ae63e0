"""SimHash near-dedup at a similarity: what ``simhash`` is for a small radius, for texts that share at least four fifths of their shingles.

Such texts differ in so many of 64 bits that no bit field is sure to agree and unrelated ones come as near. So fingerprints are four
words of 64 bits long, and tiles of fingerprints, of sets whose sizes allow the similarity, are compared by exclusive-or and bit
counts. Within the groups that this links, pairs are confirmed by the exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import counted, cut
from stintline.llm.simhash import _Sets, components, first_of_each, named_rows, shingle_hashes

#: Words of a shingle, and the least similarity of a link as a fraction (4 / 5).
SHINGLE, SIMILAR = 5, (4, 5)
#: Words of a fingerprint, 64 bits each.
PRINT = 4
#: Bits in which the first two words, and all four, may differ. A bit of two sets at SIMILAR differs with probability 0.15 (long texts) to 0.1875 (4 of 5
#: shingles), so a pair is missed with probability 5e-8 at most; of unrelated pairs 0.8 % pass the first bound and 2e-8 both.
RADIUS = (50, 84)
#: Sets of fewer shingles are at SIMILAR to none but their equals.
LEAST = 4
#: A class of sizes: sets at SIMILAR are in one class or in neighbouring ones.
CLASS = 1.2501
#: Fingerprints of a tile at most, tiles the table is dealt into at least (unless that makes tiles of under 256), and fingerprints and columns compared at once.
PRINTS, SPLIT, BLOCK, COLUMNS = 65_536, 64, 64, 4096
#: Tasks that compare tiles of fingerprints, at most.
TASKS = 4096
#: Documents of a tile whose shingles are compared; a task compares two tiles at once.
TILE = 256
#: Keys of the documents to confirm are broadcast up to this many.
BROADCAST_KEYS = 1_000_000
_TIMES = np.random.default_rng(42).integers(0, 2**63, (PRINT, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def digest(shingles: np.ndarray) -> int:
    """One signed number for a set; equal sets are one node."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) - 2**63


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, PRINT signed words; the first is of the hashes as they are, the others of hashes of them. All are 0 for an empty set."""
    total = np.zeros(64 * PRINT, np.int64)
    for at in range(0, len(shingles), 255):
        part = shingles[at : at + 255]
        words = part * _TIMES
        words ^= words >> np.uint64(29)
        words *= _TIMES[::-1]
        words ^= words >> np.uint64(32)
        words[0] = part
        bits = np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8), bitorder="little").reshape(len(part), -1)
        total += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles), bitorder="little").view(np.int64)


def _mark(docs: DataFrame) -> DataFrame:
    """Add ``fp``, the node of each row's ``text``."""

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series([digest(shingle_set(t)) for t in texts], dtype="int64")

    return docs.withColumn("fp", of("text"))


def _sketch(docs: DataFrame) -> DataFrame:
    """(key, fp, size, prints) of every row (key, text): its node, how many shingles it has and their SimHash."""

    @F.pandas_udf("fp long, size int, prints array<long>")
    def of(texts):
        import pandas as pd

        sets = [shingle_set(t) for t in texts]
        fp = pd.Series([digest(s) for s in sets], dtype="int64")
        return pd.DataFrame({"fp": fp, "size": pd.Series([len(s) for s in sets], dtype="int32"), "prints": [print_of(s) for s in sets]})

    return docs.select("key", of("text").alias("s")).select("key", "s.fp", "s.size", "s.prints")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of every row (text)."""

    @F.pandas_udf("node long, shingles array<long>")
    def of(texts):
        import pandas as pd

        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"node": pd.Series([digest(s) for s in sets], dtype="int64"), "shingles": [s.view(np.int64) for s in sets]})

    # nondeterministic to the optimizer: else a join on the node puts a null check, and with it a second call for every row, before the rows are chosen
    return docs.select(of.asNondeterministic()("text").alias("s")).select("s.node", "s.shingles")


def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which fingerprints (rows of PRINT unsigned words) lie within RADIUS of each other, as a matrix."""
    apart = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    apart += np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    close = apart <= RADIUS[0]
    i, j = np.nonzero(close)
    whole = apart[i, j].astype(np.int64)
    for word in range(2, PRINT):
        whole += np.bitwise_count(left[i, word] ^ right[j, word])
    close[i, j] = whole <= RADIUS[1]
    return close


def link_prints(prints: np.ndarray, sizes: np.ndarray, n_left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one tile of fingerprints, or (``n_left`` are of the first) between two, as positions.

    A link is a pair within RADIUS whose sizes allow SIMILAR. Each tile is sorted by size, so a block meets only the run of rows whose sizes fit.
    """
    up, down = SIMILAR
    sets = _Sets(len(prints))
    shift = n_left or 0
    other, their_sizes = prints[shift:], sizes[shift:]
    for at in range(0, len(prints) if n_left is None else n_left, BLOCK):
        stop = min(at + BLOCK, len(prints) if n_left is None else n_left)
        rows, own_sizes = prints[at:stop], sizes[at:stop]
        lo = np.searchsorted(their_sizes, -(-up * own_sizes[0] // down))
        hi = np.searchsorted(their_sizes, down * own_sizes[-1] // up, side="right")
        for a in range(max(lo, at) if n_left is None else lo, hi, COLUMNS):
            b = min(a + COLUMNS, hi)
            i, j = np.nonzero(near(rows, other[a:b]))
            x, y = sets.root(i + at), sets.root(j + a + shift)
            p, q = own_sizes[i], their_sizes[j + a]
            keep = (x != y) & (up * np.maximum(p, q) <= down * np.minimum(p, q))
            sets.join(x[keep], y[keep])
    root = sets.root(np.arange(len(prints)))
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return moved, root[moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, side, size, node, prints), sorted; each run of one k is one tile (side 2) or two."""
    at, parts = None, []

    def links() -> pa.RecordBatch:
        side, sizes, nodes, prints = (np.concatenate(x) for x in zip(*parts))
        n_left = None if side[0] == 2 else int((side == 0).sum())
        a, b = link_prints(prints.view(np.uint64), sizes, n_left) if n_left not in (0, len(side)) else (side[:0], side[:0])
        return pa.RecordBatch.from_arrays([pa.array(nodes[a.astype(np.int64)], pa.int64()), pa.array(nodes[b.astype(np.int64)], pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, side, sizes, nodes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        prints = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 4 + PRINT)], 1).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for x, y in zip(edges, edges[1:]):
            if at != k[x]:
                if parts:
                    yield links()
                at, parts = k[x], []
            parts.append((side[x:y], sizes[x:y], nodes[x:y], prints[x:y]))
    if parts:
        yield links()


def proposed(nodes: DataFrame) -> DataFrame:
    """(node, root): the nodes (node, size, prints) whose fingerprint is within RADIUS of another one's, grouped by the chains of such links.

    Tiles of one class of sizes meet each other and those of the next class, so every pair of fingerprints whose sizes allow SIMILAR
    is compared in one task. No task sees more than two tiles, and a pair of tiles returns a spanning forest.
    """
    words = [F.col("prints")[i].alias(f"w{i}") for i in range(PRINT)]
    kind = F.floor(F.log("size") / F.log(F.lit(CLASS))).cast("int")
    rows = nodes.where(F.col("size") >= LEAST).select("node", "size", kind.alias("kind"), *words)
    counts = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a class for each quarter more shingles: about a hundred at most
    tile = min(PRINTS, max(256, -(-sum(counts.values()) // SPLIT)))
    tiles, first = {}, 0
    for c in sorted(counts):
        tiles[c] = (first, -(-counts[c] // tile))
        first += tiles[c][1]
    facts = []
    for c, own in tiles.items():
        below, above = tiles.get(c - 1, own), tiles.get(c + 1, own)
        facts.append((c, *own, below[0], sum(above)))
    classes = F.broadcast(nodes.sparkSession.createDataFrame(facts, "kind int, start int, tiles int, low int, high int"))
    rows = rows.join(classes, "kind").withColumn("own", F.col("start") + F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    k = F.least("own", "other").cast("bigint") * first + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = rows.select(k.alias("k"), side.alias("side"), "size", "node", *[f"w{i}" for i in range(PRINT)])
    pairs = sum(n * (n + 1) // 2 + n * tiles.get(c + 1, (0, 0))[1] for c, (_, n) in tiles.items())
    dealt = dealt.repartition(max(1, min(TASKS, pairs // 4)), "k").sortWithinPartitions("k", "side", "size")
    return components(None, dealt.mapInArrow(_compare, "a long, b long"))


def link_sets(sets: list[np.ndarray], n_left: int | None = None) -> list[tuple[int, int]]:
    """Pairs of positions at SIMILAR or more that connect whatever all such pairs connect.

    Each set meets all after it; with ``n_left`` only the first n_left sets meet the ones after those.
    Sizes too far apart and sets already joined are left out; for the
    rest the intersections are counted through the positions that hold each shingle.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(value, kind="stable")
    holders, held = owner[by], np.bincount(value)
    first = np.cumsum(held) - held
    start = np.cumsum(sizes) - sizes
    joined, out = _Sets(len(sets)), []
    up, down = SIMILAR
    for i in range(len(sets) if n_left is None else n_left):
        close = up * np.maximum(sizes, sizes[i]) <= down * np.minimum(sizes, sizes[i])
        close[: i + 1 if n_left is None else n_left] = False
        j = np.flatnonzero(close)
        j = j[joined.root(j) != joined.root(np.array([i]))[0]] if len(j) else j
        if not len(j):
            continue
        own = value[start[i] : start[i] + sizes[i]]
        own = own[held[own] > 1]
        n = held[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holders[at], minlength=len(sets))[j]
        # common / (size + size - common) >= up / down
        j = j[common * (up + down) >= up * (sizes[i] + sizes[j])]
        if len(j):
            _, which = np.unique(joined.root(j), return_index=True)
            j = j[which]
            joined.join(np.full(len(j), i), j)
            out += [(i, x) for x in j.tolist()]
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, side, node, shingles), sorted; each run of one key is a group of one tile (side 2) or of two."""
    key, nodes, sides, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        found = []
        n_left = None if sides[0] == 2 else sides.count(0)
        if len(sets) > 1 and n_left not in (0, len(sets)):
            found = link_sets(sets, n_left)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        k1, k2, side, node = (batch.column(i).to_pylist() for i in range(4))
        lists = batch.column(4)
        for r in range(batch.num_rows):
            if (k1[r], k2[r]) != key:
                if key is not None:
                    yield links()
                key, nodes, sides, sets = (k1[r], k2[r]), [], [], []
            nodes.append(node[r])
            sides.append(side[r])
            sets.append(np.array(lists[r].values.to_numpy(zero_copy_only=False)))
    if key is not None:
        yield links()


def links(groups: DataFrame, sets: DataFrame, tile: int | None = None) -> DataFrame:
    """(a, b): confirmed links that connect whatever all pairs of a group at SIMILAR or more connect.

    A group of more than ``tile`` nodes is split by hash, and every pair of its tiles is compared.
    """
    tile = tile or TILE
    tiles = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("m"))
    rows = sets.join(groups.join(tiles, "root"), "node").withColumn("own", F.expr("cast(pmod(xxhash64(node), m) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
    low, high = F.least("own", "other").cast("bigint"), F.greatest("own", "other").cast("bigint")
    dealt = rows.select(
        F.col("root").alias("k1"),
        (low * F.col("m") + high).alias("k2"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "node",
        "shingles",
    )
    dealt = dealt.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "side")
    return dealt.mapInArrow(_confirm, "a long, b long").distinct()


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every row, and (node, root, component_id) of every distinct shingle set."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = cut(_sketch(rows))
    facts = [F.first("size").alias("size"), F.first("prints").alias("prints"), F.min("key").alias("least"), F.count(F.lit(1)).alias("n")]
    nodes = cut(marked.groupBy(F.col("fp").alias("node")).agg(*facts))
    groups = proposed(nodes)
    wanted, n_wanted = counted(groups.join(nodes, "node").select(F.col("least").alias("__key")).distinct())
    small = F.broadcast if n_wanted <= BROADCAST_KEYS else (lambda x: x)
    sets = _sets(rows.join(small(wanted), F.col("key").eqNullSafe(F.col("__key")), "left_semi"))
    sets = sets.join(groups.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    parts = components(nodes.select("node"), links(groups, sets))
    named = nodes.join(parts, "node").select("node", "n", "least", "root")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("key", "fp"), cut(named.join(ids, "root").select("node", "n", "root", "component_id"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): every row with the least key of its component. Null and wordless texts are copies of each other."""
    marked, named = _classes(docs, key, text)
    return named_rows(marked, named).select(F.col("key").alias(key), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, chosen as ``simhash.keep_first`` chooses; the columns stay as they are.

    * null and wordless texts are one component; repeated rows and rows with equal keys leave one; a null key goes if any of its component's is not null;
    * a very long text is one set of shingles; an empty input gives an empty result.
    """
    marked, named = _classes(docs, key, text)
    return first_of_each(docs, key, text, marked, named, _mark)
