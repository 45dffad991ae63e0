"""Byte-level BPE by merge replay over the distinct words of a chunk of the corpus."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import read, without

#: Characters of text, over Arrow batches, that a task holds at once, bytes of their new words replayed together, and bytes of words and ids that it remembers between chunks.
#: An executor holds a worker a core beside its heap, so these are the bounds of a worker. ALONE_BYTES are for a query that only encodes, whose heap stays small.
CHUNK_CHARS, REPLAY_BYTES, MEMORY_BYTES, ALONE_BYTES = 2_000_000, 512 << 10, 48 << 20, 128 << 20
#: Bytes that Python needs for a remembered word besides its characters and ids.
OVERHEAD = 200


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class MergeReplay:
    """Merges of a vocabulary, applied to many words at once.

    All words lie in one array of token ids with links to the left and right neighbour. An
    inverted index leads from the rank of a pair to the positions where the pair stands. Ranks
    leave a heap in order; a rank's positions are merged together, and only the pairs with the
    touched neighbours are looked up and entered again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.forget()
        self.shown = {i: str(i) for i in self.bytes_of}

    def forget(self, limit: int = 0) -> None:
        """Words are numbered as they first occur; ``pieces`` holds the ids of word number n as bytes, ``uses`` how often it came since words were last forgotten.

        With a limit, words that came more than once are remembered, if they take no more than half of it.
        """
        kept = [(w, self.pieces[n]) for w, n in self.number.items() if self.uses[n] > 1] if limit else []
        held = sum(len(w.encode("utf-8", "surrogatepass")) + len(ids) + OVERHEAD for w, ids in kept)
        if 2 * held > limit:
            kept, held = [], 0
        self.number: defaultdict[str, int] = defaultdict(count(len(kept)).__next__, ((w, n) for n, (w, _) in enumerate(kept)))
        self.pieces: list[bytes] = [ids for _, ids in kept]
        self.uses, self.held = np.zeros(len(kept), np.int32), held

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1) if len(self.keys) else np.full(len(key), -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ids = np.append(self.byte_ids[raw], -1)
        word = np.repeat(np.arange(len(words)), sizes)
        right = np.arange(1, n + 2)
        left = np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        right[ends - 1] = n
        starts = ends - sizes[sizes > 0]
        left[starts] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> np.ndarray:
            """Index the pairs that begin at these positions; their ranks (-1: none)."""
            rank = np.full(len(at), -1)
            ok = (at < n) & (right[np.minimum(at, n)] < n)
            rank[ok] = self.pair_ranks(ids[at[ok]], ids[right[at[ok]]])
            has = np.flatnonzero(rank >= 0)
            has = has[np.argsort(rank[has], kind="stable")]
            found = rank[has]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for some, r in zip(np.split(at[has], cuts), found[np.concatenate([[0], cuts])].tolist() if len(found) else []):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(some)
            return rank

        enter(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = _distinct(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[alive[at]]
            at = at[right[at] < n]
            at = at[self.pair_ranks(ids[at], ids[right[at]]) == rank]
            if not len(at):
                continue
            overlap = np.zeros(len(at), bool)  # a a a: the first of a run takes its right neighbour from the next
            overlap[1:] = right[at[:-1]] == at[1:]
            if overlap.any():
                run = np.cumsum(~overlap)
                first = np.flatnonzero(~overlap)
                at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            merged = ids.dtype.type(rank)
            # all at once only if no new pair comes before this rank; else the first of each word
            l, r = left[at], right[right[at]]
            same = np.full(len(at), rank)
            soon = [self.pair_ranks(np.where(l < n, ids[l], -1), same), self.pair_ranks(same, np.where(r < n, ids[r], -1)), self.pair_ranks(same[:1], same[:1])]
            early = (soon[0] >= 0) & (soon[0] < rank) | (soon[1] >= 0) & (soon[1] < rank)
            if 0 <= soon[2][0] < rank:
                early[:] = True
            if early.any():
                wait = np.isin(word[at], word[at[early]])
                wait[np.unique(word[at], return_index=True)[1]] = False
                if wait.any():
                    index[rank] = [at[wait]]
                    heapq.heappush(heap, rank)
                    at = at[~wait]
            gone = right[at]
            after = right[gone]
            ids[at] = merged
            alive[gone] = False
            right[at] = after
            left[after] = at
            before = left[at]
            enter(_distinct(np.concatenate([at, before[before < n]])))
        kept = np.flatnonzero(alive[:n])
        tokens = ids[kept].tolist()
        bounds = np.searchsorted(word[kept], np.arange(len(words) + 1)).tolist()
        return [tokens[a:b] for a, b in zip(bounds, bounds[1:])]

    def in_slices(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of each word, as ``replay`` gives them; its arrays never hold more than REPLAY_BYTES of words, or one longer word."""
        start, size = 0, 0
        for stop, word in enumerate(words):
            if size and size + len(word) > REPLAY_BYTES:
                yield from self.replay(words[start:stop])
                start, size = stop, 0
            size += len(word)
        if start < len(words):
            yield from self.replay(words[start:])

    def encode_ids(self, texts: list[str], pattern: regex.Pattern, memory: int | None = None) -> Iterator[np.ndarray]:
        """Ids (32 bits each) of each text; the words new to this chunk are replayed in slices. ``memory``: instead of MEMORY_BYTES."""
        limit = MEMORY_BYTES if memory is None else memory
        if self.held > limit:
            self.forget(limit)
        number, pieces, ranks = self.number, self.pieces, self.ranks
        split = [array("i", map(number.__getitem__, pattern.findall(t))) for t in texts]
        raw = [w.encode("utf-8", "surrogatepass") for w in islice(number, len(pieces), None)]
        whole = [ranks.get(b) for b in raw]
        replayed = self.in_slices([b for b, i in zip(raw, whole) if i is None])
        for b, i in zip(raw, whole):
            ids = array("i", [i] if i is not None else next(replayed)).tobytes()
            pieces.append(ids)
            self.held += len(b) + len(ids) + OVERHEAD
        self.uses = np.concatenate([self.uses, np.zeros(len(raw), np.int32)])
        for words in split:
            np.add.at(self.uses, np.frombuffer(words, np.intc), 1)
        del raw, whole, replayed
        for words in split:
            yield np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.intc)

    def encode(self, texts: list[str], pattern: regex.Pattern) -> Iterator[list[int]]:
        return (ids.tolist() for ids in self.encode_ids(texts, pattern))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, rank_lines: bytes, pattern: str, text: str = "text", digests: bool = False, decoded: bool = True, memory: int | None = None) -> DataFrame:
    """Add ``n_tokens``, ``token_ids`` (array of int) and, unless ``decoded`` is false, ``decoded`` (binary), or with ``digests`` their counts and hashes.

    A task reads its rows in chunks of about CHUNK_CHARS characters and replays the merges over the
    chunk's distinct words, so no occurrence of a word is shuffled and memory is bounded by the chunk, by REPLAY_BYTES, by ``memory`` (MEMORY_BYTES)
    and by the longest text. ``rank_lines`` are the bytes of a rank file, shipped once to each
    executor (they do not grow with the corpus).

    * a null or empty text has no tokens; repeated rows are encoded alike;
    * input columns with the names of result columns are replaced; an empty input gives an empty result.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(rank_lines)
    new = (
        [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
        if digests
        else [("n_tokens", "bigint"), ("token_ids", "array<int>"), *([("decoded", "binary")] if decoded else [])]
    )
    rows = without(docs, *[n for n, _ in new])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = ", ".join(x for x in (fields, *[f"{n} {t}" for n, t in new]) if x)
    at = rows.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(shipped.value)
        splitter = regex.compile(pattern)
        for held in _chunks(batches, at):
            pa.default_memory_pool().release_unused()
            texts = [t or "" for batch in held for t in batch.column(at).to_pylist()]
            results = engine.encode_ids(texts, splitter, memory)
            for batch in held:
                counts, ids_out, decoded_out = [], [], []
                for ids in islice(results, batch.num_rows):
                    counts.append(len(ids))
                    if decoded or digests:
                        listed = ids.tolist()
                        back = engine.decode(listed)
                        decoded_out.append(hashlib.sha256(back).hexdigest() if digests else back)
                    ids_out.append(hashlib.sha256(" ".join(map(engine.shown.__getitem__, listed)).encode()).hexdigest() if digests else ids)
                if digests:
                    made = [pa.array(counts, pa.int64()), pa.array(ids_out, pa.string()), pa.array(decoded_out, pa.string())]
                else:
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids_out), pa.int32()))
                    made = [pa.array(counts, pa.int64()), lists, *([pa.array(decoded_out, pa.binary())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[n for n, _ in new]])

    return rows.mapInArrow(work, schema)


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of batches, about CHUNK_CHARS characters of text (UTF-8 bytes count) together, and one text at least."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for stop, length in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 1):
            size += length
            if size >= CHUNK_CHARS:
                yield [*held, batch.slice(start, stop - start)]
                held, size, start = [], 0, stop
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held


_ENGINES: dict[int, MergeReplay] = {}


def _engine(lines: bytes) -> MergeReplay:
    """One engine a worker process, kept between its tasks."""
    key = hash(lines)
    if key not in _ENGINES:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        _ENGINES.clear()
        _ENGINES[key] = MergeReplay(ranks)
    return _ENGINES[key]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Rank lines and split pattern of the installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests of every document's token ids, and the digest of what they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    lines, pattern = public_vocabulary()
    return encode(docs, lines, pattern, digests=True, memory=ALONE_BYTES).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
