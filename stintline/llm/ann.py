"""Approximate nearest neighbours by inner product: anisotropic four-bit quantisation, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintline.llm.common import cut, read

#: Dimensions of a subspace and its codewords (four bits), vectors that codebooks are fitted on at most, rounds of fitting.
SUB, WORDS, FIT_VECTORS, ROUNDS = 2, 16, 20_000, 6
#: Cosine above which a pair matters; it sets how much more a residual along the vector costs than one across it.
THRESHOLD = 0.2
#: Candidates a cell holds on average and a block at most, cells at most, turns of fitting them.
CANDIDATES, CELLS, TURNS = 8192, 1024, 10
#: Vectors of the sample that set how many cells a query visits, and the share of their near neighbours that must lie in those.
QUERIES, VISITED = 512, 0.98
#: Numbers of the sample that every task holds, to know a score that a query's k-th neighbour reaches at least.
KNOWN = 1 << 20
#: Queries scanned at once, vectors reranked for each query and block at least, tasks of the scan at most.
SCAN, RERANK, TASKS = 64, 160, 4096
#: Spreads of the tables' error within which a vector is reranked. One vector beyond four is lost with probability 3e-5.
SPREADS = 4.0
SALTS = 64


@dataclass(frozen=True)
class Codebook:
    """Codewords (subspaces, WORDS, SUB); ``eta`` is the weight of the parallel residual; ``dim`` the vectors' length."""

    words: np.ndarray
    eta: float
    dim: int

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, pairs of subspaces, 256): inner products with every pair of codewords, by two four-bit codes, each query's to a scale of its own; and the scales."""
        q = _split(queries, self.dim)
        each = np.einsum("qsd,swd->qsw", q, self.words)
        most = np.maximum(np.abs(each).max((1, 2), keepdims=True), 1e-300)
        each = (each / most).astype(np.float32)
        return (each[:, ::2, :, None] + each[:, 1::2, None, :]).reshape(len(q), -1, WORDS * WORDS), most[:, 0, 0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.words[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dim]


@lru_cache(4)
def _turn(dim: int) -> np.ndarray:
    """A seeded rotation. Vectors are coded after it, so that what the codes leave out has no direction that queries share."""
    return np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))[0]


def _split(x: np.ndarray, dim: int) -> np.ndarray:
    """(rows, subspaces, SUB), an even number of subspaces; missing dimensions are zero."""
    whole = -(-dim // (2 * SUB)) * 2 * SUB
    return np.pad(np.asarray(x, np.float64), ((0, 0), (0, whole - dim))).reshape(len(x), whole // SUB, SUB)


def encode(book: Codebook, x: np.ndarray, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """Codes (rows, subspaces): least |r|^2 + (eta - 1) (r.x)^2 / |x|^2 over the residual r, one subspace after the other."""
    parts = _split(x, book.dim)
    weight = (book.eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-300)
    if codes is None:
        codes = np.stack([((parts[:, s, None, :] - book.words[s]) ** 2).sum(2).argmin(1) for s in range(parts.shape[1])], 1)
    codes = codes.copy()
    along = sum(((parts[:, s] - book.words[s][codes[:, s]]) * parts[:, s]).sum(1) for s in range(parts.shape[1]))
    for _ in range(rounds):
        for s in range(parts.shape[1]):
            gap = parts[:, s, None, :] - book.words[s]
            inner = (gap * parts[:, s, None, :]).sum(2)
            rest = along - np.take_along_axis(inner, codes[:, s, None], 1)[:, 0]
            cost = (gap**2).sum(2) + weight[:, None] * (rest[:, None] + inner) ** 2
            codes[:, s] = cost.argmin(1)
            along = rest + np.take_along_axis(inner, codes[:, s, None], 1)[:, 0]
    return codes


def train(x: np.ndarray, seed: int = 3) -> Codebook:
    """Codebooks by turns: codes for the codewords, then each codeword's weighted least squares for its codes."""
    dim = x.shape[1]
    parts = _split(x, dim)
    rng = np.random.default_rng(seed)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    words = np.stack([parts[rng.choice(len(x), WORDS, replace=len(x) < WORDS), s] for s in range(parts.shape[1])])
    book = Codebook(words, 1.0, dim)
    codes = None
    for turn in range(ROUNDS * 2):  # first without, then with the weight of the parallel residual
        if turn == ROUNDS:
            book = Codebook(words, eta, dim)
        codes = encode(book, x, codes if turn > ROUNDS else None, 1 if turn >= ROUNDS else 0)
        weight = (book.eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-300)
        along = sum(((parts[:, s] - words[s][codes[:, s]]) * parts[:, s]).sum(1) for s in range(parts.shape[1]))
        for s in range(parts.shape[1]):
            own = parts[:, s]
            rest = along - ((own - words[s][codes[:, s]]) * own).sum(1)
            for k in range(WORDS):
                at = codes[:, s] == k
                if not at.any():
                    words[s, k] = own[rng.integers(len(own))]
                    continue
                v, w = own[at], weight[at]
                left = at.sum() * np.eye(SUB) + np.einsum("n,nd,ne->de", w, v, v)
                right = (v * (1 + w * (rest[at] + (v**2).sum(1)))[:, None]).sum(0)
                words[s, k] = np.linalg.solve(left, right)
            along = rest + ((own - words[s][codes[:, s]]) * own).sum(1)
    return Codebook(words, eta, dim)


@dataclass(frozen=True)
class Index:
    """What a bounded sample teaches: the codebook, the cells' centres, how many cells hold most near neighbours, the scale of components, and a part of the sample."""

    book: Codebook
    centres: np.ndarray
    visits: int
    scale: float
    known: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest centre."""
        return _nearest(self.centres, x / self.scale)

    def tour(self, queries: np.ndarray) -> np.ndarray:
        """(queries, visits): the cells whose centres have the largest inner products."""
        return np.argsort(-(_unit(queries) @ self.centres.T), axis=1, kind="stable")[:, : self.visits]

    def floor(self, queries: np.ndarray, k: int) -> np.ndarray:
        """A score each query's k-th neighbour reaches at least: the (k + 1)-th of the known vectors in the cells it tours (the query itself may be one)."""
        home, tour = _nearest(self.centres, self.known), self.tour(queries)
        by = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[by], np.arange(len(self.centres) + 1))
        score = np.full((len(queries), len(self.known)), -np.inf)
        for cell in np.unique(tour):
            rows, columns = np.flatnonzero((tour == cell).any(1)), by[ends[cell] : ends[cell + 1]]
            score[np.ix_(rows, columns)] = _unit(queries[rows]) @ self.known[columns].T
        if score.shape[1] <= k:
            return np.full(len(queries), -np.inf)
        return np.partition(score, -k - 1, axis=1)[:, -k - 1]

    def may_hold(self, queries: np.ndarray, floor: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(queries, cells): whether a vector within ``reach`` of the cell's centre can have that score. A cell without vectors has the reach -inf."""
        u = _unit(queries)
        length = np.linalg.norm(u, axis=1)[:, None]
        slack = 1e-9 * length * (np.sqrt(self.book.dim) + np.linalg.norm(self.centres, axis=1))
        return u @ self.centres.T + length * reach + slack >= floor[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row divided by its largest component, so that no product overflows."""
    return x / np.abs(x).max(1, keepdims=True)


def _nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def learn(x: np.ndarray, n_cells: int, scale: float, near: int) -> Index:
    """Codebook (of the turned vectors) and cells (k-means) of a sample; the visits are the fewest that reach a share VISITED of the ``near`` neighbours within it.

    The vectors that set the visits take no part in the k-means. Neighbours within a sample are
    farther than those within the whole table, so the share there is no smaller as a rule.
    """
    x = x / scale
    book = train(x @ _turn(x.shape[1]))
    asked, rest, known = x[:QUERIES], x[QUERIES:], x[: max(1, KNOWN // x.shape[1])]
    if n_cells == 1 or len(rest) <= n_cells:
        return Index(book, x[:1], 1, scale, known)
    rng = np.random.default_rng(5)
    centres = rest[rng.choice(len(rest), n_cells, replace=False)]
    for _ in range(TURNS):
        home = _nearest(centres, rest)
        counts = np.bincount(home, minlength=n_cells)
        total = np.zeros_like(centres)
        np.add.at(total, home, rest)
        centres = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres)
    home = _nearest(centres, rest)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    near = min(near, len(rest))
    best = np.argpartition(-(asked @ rest.T), near - 1, axis=1)[:, :near]
    needed = np.sort(place[np.arange(len(asked))[:, None], home[best]].ravel())
    return Index(book, centres, int(needed[int(np.ceil(VISITED * len(needed))) - 1]) + 1, scale, known)


def usable(vector: str) -> Column:
    """Not null, not all zero, every component finite."""
    v = f"`{vector}`"
    return F.expr(
        f"coalesce(size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0), false)"
    )


def _bytes(vectors: DataFrame, keep: str) -> DataFrame:
    """Replace the array column ``v`` by ``b``, its doubles as bytes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["b"] = [np.asarray(v, np.float64).tobytes() for v in pdf.pop("v")]
            yield pdf

    return vectors.mapInPandas(work, keep + ", b binary")


def _rows(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, key, score): for each row where ``queries`` holds its k nearest other rows, nearest first.

    Nearness is the inner product in double precision, ties go to the smaller key. Equal vectors
    are indexed once with their k + 1 least keys (no more can be among the k nearest), so groups
    of copies cost nothing and hide nobody. A vector goes to the cell of its nearest centre, large
    cells are dealt into blocks by hash, and a query goes to all blocks of the cells that can hold one of
    its k nearest: those where the centre's product and the cell's reach come up to the score that
    k sampled vectors have. So a vector is shuffled and encoded once; a task holds one block, scans
    its four-bit tables for the queries that stream past, and reranks by the original vectors the best
    and all that the tables' error could lift among the k nearest. The blocks' results meet
    in one window by query. Cells and codebook come from FIT_VECTORS vectors at most.

    * vectors that are null, zero, hold a null or a non-finite component, or differ in length
      from most of the table, and rows without a key, take no part;
    * rows repeated with key and vector count once; a query's own key is never its neighbour;
    * with fewer than k candidates all are returned; an empty input gives an empty result; other
      columns are not looked at.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")
    )
    size = F.max(F.array_max(F.transform("v", F.abs)))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), size.alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"query_id bigint, rank int, `{key}` bigint, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = length.d
    rows = rows.where(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    nth = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))
    few = few.withColumn("r", nth("v", "salt")).where(F.col("r") <= k + 1).withColumn("r", nth("v")).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    distinct = cut(_bytes(distinct.select("ids", "v"), "ids array<bigint>"))
    sample = distinct.select(F.xxhash64("b").alias("h"), "b").orderBy("h", "b").limit(FIT_VECTORS)

    n_cells = min(CELLS, -(-distinct.count() // CANDIDATES))
    scale = length.most

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_rows(pdf["b"], np.float64) for pdf in batches if len(pdf)]
        if parts:
            found = learn(np.concatenate(parts), n_cells, scale, k)
            yield pd.DataFrame({
                "w": [found.book.words.ravel().tolist()], "eta": [found.book.eta], "c": [found.centres.ravel().tolist()],
                "visits": [found.visits], "known": [found.known.tobytes()],
            })

    got = sample.coalesce(1).mapInPandas(fit, "w array<double>, eta double, c array<double>, visits int, known binary").first()
    book = Codebook(np.array(got.w).reshape(-1, WORDS, SUB), got.eta, dim)
    index = Index(book, np.array(got.c).reshape(-1, dim), got.visits, scale, np.frombuffer(got.known).reshape(-1, dim))
    shipped = vectors.sparkSession.sparkContext.broadcast(index)  # dim * (WORDS + CELLS) + KNOWN doubles at most

    def house(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf["b"], np.float64)
                cell = shipped.value.home(x)
                yield pdf.assign(cell=cell, reach=np.linalg.norm(x / scale - shipped.value.centres[cell], axis=1))

    housed = distinct.mapInPandas(house, "ids array<bigint>, b binary, cell int, reach double")
    facts, blocks, reach = [], 0, np.full(len(index.centres), -np.inf)
    counts = housed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()  # CELLS rows at most
    for r in sorted(counts):
        reach[r.cell] = r.reach
        facts.append((r.cell, blocks, -(-r.n // CANDIDATES)))
        blocks += facts[-1][2]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), SCAN):
                part = pdf[at : at + SCAN]
                q = np.array(part["v"].tolist(), np.float64)
                floor = shipped.value.floor(q, k)
                cells = [np.flatnonzero(c).tolist() for c in shipped.value.may_hold(q, floor, reach)]
                yield pd.DataFrame({"ids": [[i] for i in part["id"]], "b": [v.tobytes() for v in q], "cell": cells, "floor": floor})

    asked = rows.where("q").select("id", "v").distinct().mapInPandas(route, "ids array<bigint>, b binary, cell array<int>, floor double")
    cells = F.broadcast(vectors.sparkSession.createDataFrame(facts, "cell int, start int, blocks int"))
    own = F.col("start") + F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1))
    held = housed.join(cells, "cell").select(own.alias("block"), F.lit(0).alias("kind"), "ids", "b", F.lit(0.0).alias("floor"))
    sent = asked.withColumn("cell", F.explode("cell")).join(cells, "cell").select(every.alias("block"), F.lit(1).alias("kind"), "ids", "b", "floor")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, some, block = None, [], None
        for pdf in batches:
            for (number, kind), part in pdf.groupby(["block", "kind"], sort=True):
                if number != at:
                    at, some, block = number, [], None
                if kind == 0:
                    some.append(part)
                elif some or block is not None:
                    if block is None:
                        block, some = Block(shipped.value, pd.concat(some)), []
                    yield block.nearest(_rows(part["b"], np.float64), np.array([i[0] for i in part["ids"]]), k, rerank, part["floor"].to_numpy())

    dealt = held.unionByName(sent).repartition(min(TASKS, 4 * blocks), "block").sortWithinPartitions("block", "kind")
    near = dealt.mapInPandas(scan, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


class Block:
    """At most about CANDIDATES vectors with their codes."""

    def __init__(self, index: Index, rows: pd.DataFrame):
        self.book, self.scale, self.x, self.ids = index.book, index.scale, _rows(rows["b"], np.float64), rows["ids"].tolist()
        x = self.x / index.scale @ _turn(self.book.dim)
        codes = encode(index.book, x)
        self.code = (codes[:, ::2] * WORDS + codes[:, 1::2]).astype(np.intp)
        self.least = np.array([i[0] for i in self.ids])
        near = self.book.vectors(codes)
        self.size = np.linalg.norm(x, axis=1)
        along = (near * x).sum(1)
        # stretched to its vector's own projection, what the codes stand for leaves a rest across the vector
        across = along > self.size**2 / 4
        self.stretch = np.where(across, self.size**2 / np.where(across, along, 1), 1)
        self.rest = np.linalg.norm(x - self.stretch[:, None] * near, axis=1) * min(1, SPREADS / np.sqrt(max(1, self.book.dim - 1)))
        self.inverse = np.where(across, 1 / np.where(across, self.size, 1), 0)

    def _in_reach(self, rough: np.ndarray, lengths: np.ndarray, slack: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(queries, vectors): whether the score can be ``least`` or more. The rest meets only the query's part across the vector, which a large score leaves small."""
        part = np.maximum(least, 0)[:, None] * self.inverse
        across = np.sqrt(np.maximum(lengths[:, None] ** 2 - part**2, 0))
        return (rough + self.rest * across + slack[:, None] >= least[:, None]) & (self.size * lengths[:, None] + slack[:, None] >= least[:, None])

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, k: int, rerank: int, floor: np.ndarray) -> pd.DataFrame:
        """The k nearest of the block for each query, as (query_id, id, score), but for those below ``floor`` at will."""
        x, ids, code = self.x, self.ids, self.code
        keep = min(max(rerank, 2 * k + 2), len(x))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), SCAN):
            q = queries[at : at + SCAN]
            unit = _unit(q)
            table, scales = self.book.tables(unit @ _turn(self.book.dim))
            rough = np.zeros((len(q), len(x)), np.float32)
            for s in range(code.shape[1]):
                rough += np.take(table[:, s], code[:, s], axis=1)
            rough = rough * (scales[:, None] * self.stretch)
            best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
            exact = np.einsum("qrd,qd->qr", x[best], q)
            if keep < len(x):
                reached = np.partition(exact, -k - 1, axis=1)[:, -k - 1] / self.scale / np.abs(q).max(1)
                slack = scales * code.shape[1] ** 2 * 1e-6 + 1e-9 * np.abs(reached)  # single precision of the tables
                more = self._in_reach(rough, np.linalg.norm(unit, axis=1), slack, np.maximum(reached, floor[at : at + SCAN]))
                np.put_along_axis(more, best, False, axis=1)
            for n in range(len(q)):
                own, held, score = query_ids[at + n], best[n], exact[n]
                if keep < len(x) and more[n].any():
                    rest = np.flatnonzero(more[n])
                    held, score = np.concatenate([held, rest]), np.concatenate([score, np.einsum("qrd,qd->qr", x[rest][None], q[n : n + 1])[0]])
                first = np.lexsort((self.least[held], -score))[: k + 1]
                got = [(i, s) for i, s in ((i, score[f]) for f in first for i in ids[held[f]]) if i != own]
                got.sort(key=lambda y: (-y[1], y[0]))
                out.append((np.full(len(got[:k]), own), np.array([i for i, _ in got[:k]], np.int64), np.array([s for _, s in got[:k]], np.float64)))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "id": b, "score": c})


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
