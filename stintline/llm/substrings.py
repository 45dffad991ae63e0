"""Removal of byte strings that an earlier document holds too, by suffix sorting in buckets.

Every string of WINDOW bytes is dealt to a bucket by its minimizer (the least hash of its PROBE-byte strings), so equal strings meet. Strings
that follow each other with one minimizer travel as one piece of text. Only pieces whose minimizer another document has too are
sent. A bucket's suffixes are sorted by mergesort; two suffixes are compared through prefix polynomial hashes and a binary search
for their common extension; what neighbours are said to share is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stintline.llm.common import read, without

#: Shorter probes make longer pieces, but more of them are shared by chance: at 12 bytes twice as many as at 20.
WINDOW, PROBE = 50, 20
#: Bytes of text in a block of documents and in a bucket, about; bytes of pieces that are sorted at once; strings in a piece at most.
BLOCK_BYTES, BUCKET_BYTES, SLICE_BYTES, LONGEST = 8 << 20, 16 << 20, 1 << 20, 64
#: Pieces of one minimizer beyond which its strings are dealt one by one, by a hash of the whole string.
HOT_PIECES = 1 << 17
#: A null id comes after all others.
LAST = (1 << 63) - 1
#: Suffixes are compared to this depth, at least the longest piece.
DEPTH = 128
SEGMENT = 16
C1, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * C3
    return h ^ (h >> np.uint64(32))


class Suffixes:
    """Order and equality of suffixes of a byte sequence, to DEPTH bytes."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62)) * 2 + 1
        self.data = np.concatenate([data, np.zeros(DEPTH, np.uint8)])
        n = len(self.data)
        powers, back = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
        powers[0] = back[0] = 1
        values = rng.integers(1 << 63, size=256, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.data] * np.multiply.accumulate(powers), dtype=np.uint64)])
        self.back = np.multiply.accumulate(back)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """The hash of ``size`` bytes from each place on, from the prefix hashes."""
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes from a and b have in common, DEPTH - 1 at most, by binary search over the length."""
        a, b, start = a.copy(), b.copy(), a
        size = DEPTH // 2
        while size:
            step = (self.hashes(a, size) == self.hashes(b, size)) * size
            a += step
            b += step
            size //= 2
        return a - start

    def not_above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.common(a, b)
        return self.data[a + same] <= self.data[b + same]

    def sort(self, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Numbers of the starts by group, and in a group by suffix: a mergesort of each group, whose merges run in step, cut into segments of equal output.

        Where a segment begins in its two runs is found by binary search, so all segments of a level, of all groups, are merged at once.
        """
        order = np.argsort(groups, kind="stable")
        new = np.concatenate([[True], np.diff(groups[order]) != 0]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        first, size = np.repeat(first, size), np.repeat(size, size)
        local, stop, width = np.arange(len(order)) - first, first + size, 1
        while width < size.max(initial=0):
            piece = min(2 * width, SEGMENT)
            begin = np.flatnonzero((local % piece == 0) & (size > width))
            low = begin - local[begin] % (2 * width)
            middle, high = np.minimum(low + width, stop[begin]), np.minimum(low + 2 * width, stop[begin])
            x, y, out = np.maximum(0, begin - low - (high - middle)), np.minimum(begin - low, middle - low), order.copy()
            while len(open_ := np.flatnonzero(x < y)):
                half = (x[open_] + y[open_]) // 2
                before = self.not_above(starts[order[low[open_] + half]], starts[order[(middle + begin - low)[open_] - 1 - half]])
                x[open_] = np.where(before, half + 1, x[open_])
                y[open_] = np.where(before, y[open_], half)
            a, b = low + x, middle + begin - low - x
            for step in range(piece):
                alive = begin + step < high
                if not alive.all():
                    begin, middle, high, a, b = (v[alive] for v in (begin, middle, high, a, b))
                one, other = order[np.minimum(a, middle - 1)], order[np.minimum(b, len(order) - 1)]
                both = np.flatnonzero((a < middle) & (b < high))
                take = b >= high
                take[both] = self.not_above(starts[one[both]], starts[other[both]])
                out[begin + step] = np.where(take, one, other)
                a += take
                b += ~take
            order, width = out, 2 * width
        return order


def equal_classes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A number for each (start, size), equal where the strings are: neighbours in suffix order whose common extension reaches the size.

    Equal strings are in one group. Strings that only their hashes hold to be equal are seen when the bytes are compared; then all
    is done again with other hashes.
    """
    classes = np.zeros(len(starts), np.int64)
    seed = 0
    while len(starts):
        suffixes = Suffixes(data, seed)
        order = suffixes.sort(starts, groups)
        order = order[np.lexsort((sizes[order], groups[order]))]  # stable, so strings of one size stay in suffix order
        a, b, size = starts[order[:-1]], starts[order[1:]], sizes[order[1:]]
        same = (sizes[order[:-1]] == size) & (groups[order[:-1]] == groups[order[1:]])
        near = np.flatnonzero(same)
        same[near] = suffixes.common(a[near], b[near]) >= size[near]
        a, b, size = a[same], b[same], size[same]
        longest = int(sizes.max())
        shared = np.lib.stride_tricks.sliding_window_view(suffixes.data, longest)
        if not np.any((shared[a] != shared[b]) & (np.arange(longest) < size[:, None])):
            classes[order] = np.cumsum(np.concatenate([[0], ~same]))
            break
        seed += 1
    return classes


def least_of(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each element the least value in its class."""
    order = np.argsort(classes, kind="stable")
    if not len(order):
        return values
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(classes[order]) != 0]))
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], cuts), np.diff(np.append(cuts, len(order))))
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each start, in one array."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each place the least hash of a PROBE-byte string within the WINDOW bytes from there on."""
    n = len(data) - PROBE + 1
    padded, hashes = np.ascontiguousarray(data), np.zeros(n, np.uint64)
    for offset in range(0, PROBE, 4):
        hashes = (hashes ^ np.ndarray((n,), "<u4", padded, offset=offset, strides=(1,))) * C1
        hashes ^= hashes >> np.uint64(31)
    least = mixed(hashes)
    span, wanted = 1, WINDOW - PROBE + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :]) if wanted > span else least


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, strings, key) of each piece: strings of WINDOW bytes that follow each other with one minimizer, LONGEST at most."""
    found = []
    for numbers, offsets, data in _chunks(texts):
        bounds = np.append(np.cumsum([len(d) for d in data]), 0)
        joined = np.frombuffer(b"".join(data), np.uint8)
        least = minimizers(joined)
        part = np.repeat(np.arange(len(data)), [len(d) for d in data])[: len(least)]
        valid = np.arange(len(least)) + WINDOW <= bounds[part]
        cut = np.concatenate([[True], (np.diff(least.view(np.int64)) != 0) | (np.diff(part) != 0)])
        begin = np.flatnonzero(cut)
        since = np.arange(len(least)) - np.repeat(begin, np.diff(np.append(begin, len(least))))
        begin = np.flatnonzero((since % LONGEST == 0) & valid)
        # a piece ends where the next begins, or with the valid strings of its text
        last = np.minimum(np.append(begin[1:], len(least)), bounds[part[begin]] - WINDOW + 1)
        first = np.concatenate([[0], bounds[:-2]])
        found.append((np.array(numbers)[part[begin]], np.array(offsets)[part[begin]] + begin - first[part[begin]], last - begin, mixed(least[begin])))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of WINDOW bytes or more, about SLICE_BYTES at once; a longer one comes in parts that overlap by a string less one byte."""
    numbers, offsets, data, held = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - WINDOW + 1), SLICE_BYTES):
            part = text[at : at + SLICE_BYTES + WINDOW - 1]
            numbers.append(number)
            offsets.append(at)
            data.append(part)
            held += len(part)
            if held >= SLICE_BYTES:
                yield numbers, offsets, data
                numbers, offsets, data, held = [], [], [], 0
    if data:
        yield numbers, offsets, data


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length class each, compressed into one value."""
    raw = b"".join(len(a).to_bytes(4, "little") + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    arrays, at = [], 0
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "little"), np.dtype(raw[at + 4 : at + 8].decode().strip())
        arrays.append(np.frombuffer(raw, kind, size, at + 8))
        at += 8 + size * kind.itemsize
    return arrays


class Block:
    """The documents of one block in a fixed order, and their pieces; made anew in each pass from the same rows."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        ids = [LAST if i is None else i for i in table.column(doc_id).to_pylist()]
        texts = [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]
        self.places = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.places], np.int64)
        self.texts = [texts[i] for i in self.places]

    def pieces(self) -> None:
        self.number, self.start, self.strings, self.key = pieces_of(self.texts)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by (bucket, key), the bucket of each, where each piece's key is, and which keys two documents have."""
        keys, inverse = np.unique(self.key, return_inverse=True)
        bucket = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        place = back[inverse]
        low, high = np.full(len(keys), LAST), np.full(len(keys), -LAST - 1)
        np.minimum.at(low, place, self.ids[self.number])
        np.maximum.at(high, place, self.ids[self.number])
        return keys[order], bucket[order], place, low < high


#: The column that names a document's block.
HOME = "__block"
KEYS, FLAGS = "bucket int, block int, keys binary", "block int, bucket int, flags binary"
PIECES, SPANS = "bucket int, block int, done boolean, pieces binary", "block int, spans binary"


def send_keys(table: pa.Table, doc_id: str, text: str, buckets: int) -> pa.Table:
    """The distinct keys of a block for each bucket: 32 bits of each, and in a byte how many pieces have it (as a power of two) and whether two documents do."""
    number = table.column(HOME)[0].as_py()
    block = Block(table, doc_id, text)
    block.pieces()
    keys, bucket, place, several = block.keys(buckets)
    counts = np.bincount(place, minlength=len(keys))
    facts = (np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8) | (several.astype(np.uint8) << 7)).astype(np.uint8)
    short = (keys >> np.uint64(32)).astype(np.uint32)
    rows = [(b, packed(short[x:y], facts[x:y])) for b, x, y in _groups(bucket)]
    return _table(KEYS, [r[0] for r in rows], [number] * len(rows), [r[1] for r in rows])


def shared_keys(table: pa.Table, hot_pieces: int) -> pa.Table:
    """For each block's keys of a bucket, two bits a key: whether another document has it, and whether its pieces are too many for one bucket."""
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    sent = [unpacked(k) for k in table.column("keys").to_pylist()]
    keys = np.concatenate([s[0] for s in sent])
    facts = np.concatenate([s[1] for s in sent])
    distinct, inverse, owners = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.zeros(len(distinct), bool)
    several[inverse[facts >= 128]] = True
    pieces = np.bincount(inverse, np.exp2(facts & 127), len(distinct))
    shared = ((owners > 1) | several)[inverse]
    hot = shared & (pieces > hot_pieces)[inverse]
    ends = np.cumsum([len(s[0]) for s in sent])
    flags = [packed(np.packbits(shared[e - len(s[0]) : e]), np.packbits(hot[e - len(s[0]) : e])) for e, s in zip(ends.tolist(), sent)]
    return _table(FLAGS, blocks, [bucket] * len(blocks), flags)


def send_pieces(docs: pa.Table, flags: pa.Table, doc_id: str, text: str, buckets: int) -> pa.Table:
    """The block's pieces with shared keys, for each bucket; strings of hot keys as pieces of their own, dealt by their own hash.

    Of equal pieces in a block only those of the least document go on; all strings of the others are known to come later.
    """
    if not docs.num_rows or not flags.num_rows:
        return _table(PIECES, [], [], [], [])
    home = docs.column(HOME)[0].as_py()
    block = Block(docs, doc_id, text)
    block.pieces()
    keys, bucket, place, several = block.keys(buckets)
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    of_bucket = dict(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
    for b, x, y in _groups(bucket):
        bits = unpacked(of_bucket[b])
        shared[x:y], hot[x:y] = (np.unpackbits(v, count=y - x).astype(bool) for v in bits)
    size = np.array([len(t) for t in block.texts], np.int64)
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(block.texts), np.uint8)
    whole, single = np.flatnonzero(shared[place] & ~hot[place]), np.flatnonzero(hot[place])
    number = np.concatenate([block.number[whole], np.repeat(block.number[single], block.strings[single])])
    start = np.concatenate([block.start[whole], ragged(block.start[single], block.strings[single])])
    strings = np.concatenate([block.strings[whole], np.ones(len(number) - len(whole), np.int64)])
    key = np.concatenate([block.key[whole], np.repeat(block.key[single], block.strings[single])])
    at, length, ids = first[number] + start, strings + WINDOW - 1, block.ids[number]
    later = np.zeros(len(at), bool)
    here = np.flatnonzero(np.concatenate([several[place[whole]], np.repeat(several[place[single]], block.strings[single])]))
    for part in _slices(key[here], length[here]):
        part = here[part]
        ends = np.cumsum(length[part])
        classes = equal_classes(data[ragged(at[part], length[part])], ends - length[part], length[part], key[part])
        later[part] = ids[part] > least_of(classes, ids[part])
    by_self = mixed(_string_hashes(data, at[len(whole) :])) % np.uint64(buckets)
    to = np.concatenate([bucket[place[whole]], by_self.astype(np.int64)])
    stay, gone, out = np.flatnonzero(~later), np.flatnonzero(later), []
    order = stay[np.lexsort((start[stay], number[stay], to[stay]))]
    for b, x, y in _groups(to[order]):
        here = order[x:y]
        text_here = data[ragged(at[here], length[here])]
        out.append((b, False, packed(number[here].astype(np.uint32), ids[here], start[here].astype(np.uint32), strings[here].astype(np.uint8), text_here)))
    if len(gone):
        out.append((home % buckets, True, packed(number[gone].astype(np.uint32), start[gone].astype(np.uint32), strings[gone].astype(np.uint32))))
    return _table(PIECES, [r[0] for r in out], [home] * len(out), [r[1] for r in out], [r[2] for r in out])


def _string_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes at each place, from those bytes alone."""
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        h = h * C1 + data[at + k] + np.uint64(1)
    return h


def _slices(key: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Piece numbers ordered by key, in slices of about SLICE_BYTES that no key crosses."""
    order = np.argsort(key, kind="stable")
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order].view(np.int64)) != 0])) if len(order) else order
    cuts = new[np.concatenate([[True], np.diff(begin[new] // SLICE_BYTES) > 0])] if len(new) else new
    for x, y in zip(cuts, np.append(cuts[1:], len(order))):
        yield order[x:y]


def _of_two(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places whose value stands with two different ids."""
    order = np.argsort(values)
    if not len(order):
        return order
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    ordered = ids[order]
    several = np.minimum.reduceat(ordered, cuts) < np.maximum.reduceat(ordered, cuts)
    return np.sort(order[np.repeat(several, np.diff(np.append(cuts, len(order))))])


def later_strings(data: np.ndarray, starts: np.ndarray, strings: np.ndarray, ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first string, strings) of the stretches whose every string a piece with a smaller id has too.

    Equal pieces first: of those only the least document's are looked at further. Then the strings of different pieces: those whose hash
    two documents have are suffix sorted.
    """
    sizes = strings + WINDOW - 1
    piece = np.arange(len(starts))
    classes = equal_classes(data, starts, sizes, key)
    least = least_of(classes, ids)
    late = ids > least
    _, stand_in = np.unique(np.where(late, -1, classes), return_index=True)
    stand_in = stand_in[~late[stand_in]]
    at = ragged(starts[stand_in], strings[stand_in])
    owner = np.repeat(stand_in, strings[stand_in])
    asked = _of_two(Suffixes(data).hashes(at, WINDOW), ids[owner])
    same = equal_classes(data, at[asked], np.full(len(asked), WINDOW), key[owner[asked]])
    taken = np.zeros(len(at), bool)
    taken[asked] = ids[owner[asked]] > least_of(same, ids[owner[asked]])
    edge = np.diff(np.concatenate([[0], taken.astype(np.int8), [0]]))
    inner = np.flatnonzero(np.diff(owner)) + 1  # stretches end with their piece
    begin = np.union1d(np.flatnonzero(edge == 1), inner[taken[inner]])
    end = np.union1d(np.flatnonzero(edge == -1), inner[taken[inner - 1]])
    found_class, found_from, found_size = classes[owner[begin]], at[begin] - starts[owner[begin]], end - begin
    # what holds for the piece looked at holds for its equals in the same document
    early = piece[~late]
    order = np.argsort(classes[early], kind="stable")
    early, of = early[order], classes[early][order]
    x, y = np.searchsorted(of, found_class, "left"), np.searchsorted(of, found_class, "right")
    twins = early[ragged(x, y - x)]
    return (
        np.concatenate([piece[late], twins]),
        np.concatenate([np.zeros(int(late.sum()), np.int64), np.repeat(found_from, y - x)]),
        np.concatenate([strings[late], np.repeat(found_size, y - x)]),
    )


def _keys(strings: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The minimizer of each piece of a blob, from its first string."""
    sizes = strings.astype(np.int64) + WINDOW - 1
    return minimizers(data)[np.cumsum(sizes) - sizes]


def sort_bucket(table: pa.Table) -> pa.Table:
    """Stretches of later strings for each block, from the pieces of a bucket."""
    blocks, done, blobs = (table.column(c).to_pylist() for c in ("block", "done", "pieces"))
    out = [(b, p) for b, d, p in zip(blocks, done, blobs) if d]
    sent = [(b, unpacked(p)) for b, d, p in zip(blocks, done, blobs) if not d]
    if sent:
        home = np.repeat([b for b, _ in sent], [len(s[0]) for _, s in sent])
        number, ids, start, strings, data = (np.concatenate([s[k] for _, s in sent]) for k in range(5))
        start, strings = start.astype(np.int64), strings.astype(np.int64)
        sizes = strings + WINDOW - 1
        at = np.cumsum(sizes) - sizes
        key = np.concatenate([_keys(s[3], s[4]) for _, s in sent])
        found = []
        for part in _slices(key, sizes):
            ends = np.cumsum(sizes[part])
            piece, first, count = later_strings(data[ragged(at[part], sizes[part])], ends - sizes[part], strings[part], ids[part], key[part])
            found.append((part[piece], first, count))
        piece, first, count = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(home[piece], kind="stable")
        for b, x, y in _groups(home[piece[order]]):
            p = piece[order[x:y]]
            out.append((b, packed(number[p].astype(np.uint32), (start[p] + first[order[x:y]]).astype(np.uint32), count[order[x:y]].astype(np.uint32))))
    return _table(SPANS, [b for b, _ in out], [s for _, s in out])


def remove_spans(docs: pa.Table, spans: pa.Table, doc_id: str, text: str, schema: pa.Schema) -> pa.Table:
    """The block's rows with what stays of each text."""
    if not docs.num_rows:
        return schema.empty_table()
    block = Block(docs, doc_id, text)
    parts = [unpacked(s) for s in spans.column("spans").to_pylist()]
    number, start, count = (np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(number, kind="stable")
    number, start, count = number[order], start[order], count[order]
    sizes, removed, listed, kept = ([None] * docs.num_rows for _ in range(4))
    for n, place in enumerate(block.places):
        raw = block.texts[n]
        x, y = np.searchsorted(number, [n, n + 1])
        sizes[place], removed[place], listed[place], kept[place] = len(raw), 0, [], raw
        if x < y:
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, start[x:y], 1)
            np.add.at(cover, start[x:y] + count[x:y] + WINDOW - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            removed[place] = int(gone.sum())
            listed[place] = [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
            kept[place] = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    made = [pa.array(v, schema.field(c).type) for c, v in zip(("n_bytes", "n_removed", "spans", "kept"), (sizes, removed, listed, kept))]
    return pa.Table.from_arrays([*docs.drop_columns([HOME]).columns, *made], schema=schema)


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each stretch of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    for x, y in zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(values)).tolist()):
        if x < y:
            yield int(values[x]), x, y


ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _table(schema: str, *columns: list) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.table([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], names=list(names))


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``spans`` (array of start and length of what is removed, in bytes) and ``kept`` (the bytes left).

    Each byte goes that a string of WINDOW bytes covers which also starts in a document with a smaller id. Documents are dealt into blocks,
    the text once (all passes read that one exchange): a first pass sends 32 bits of each minimizer to its bucket, a second the pieces of text whose minimizers
    two documents have, a third gets the stretches back. Blocks and buckets follow the corpus in number, not in size; a hot minimizer is
    dealt string by string, and equal pieces are reduced in their block first. The input must have the same rows and partitions each time it is
    computed, as a stored table has; a pass that meets other rows in a block fails.

    * a null or empty text has nothing to remove, nor has one under WINDOW bytes; matches never cross documents;
    * a null id comes after all others; rows with one id are not earlier than each other, so a repeated row loses what its twin loses;
    * input columns with the names of result columns are replaced; an empty input gives an empty result.
    """
    rows = without(docs, "n_bytes", "n_removed", "spans", "kept")
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    salt = F.xxhash64(F.col(doc_id), F.col(text), F.spark_partition_id())  # rows repeated in full do not meet in one block
    dealt = rows.withColumn(HOME, F.pmod(salt, F.lit(blocks)).cast("int"))
    keys = dealt.groupBy(HOME).applyInArrow(lambda t: send_keys(t, doc_id, text, buckets), KEYS)
    flags = keys.groupBy("bucket").applyInArrow(lambda t: shared_keys(t, hot_pieces), FLAGS)
    pieces = dealt.groupBy(HOME).cogroup(flags.groupBy("block")).applyInArrow(lambda d, f: send_pieces(d, f, doc_id, text, buckets), PIECES)
    spans = pieces.groupBy("bucket").applyInArrow(lambda t: sort_bucket(t), SPANS)
    new = "n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>, kept binary"
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), new])
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    out = pa.schema([*to_arrow_schema(rows.schema), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())])
    return dealt.groupBy(HOME).cogroup(spans.groupBy("block")).applyInArrow(lambda d, s: remove_spans(d, s, doc_id, text, out), fields)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and maximal runs removed from every document, and the digest of what stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string by itself: the least id that has it, the places of later ones, their spans, and what lies between these.
OP13_SQL = f"""
with texts as (select row_number() over () as r, doc_id, coalesce(doc_id, {LAST}) as id, encode(coalesce(text, '')) as b from documents),
starts as (select r, id, b[p + 1:p + {WINDOW}] as s, p from (select r, id, b, unnest(range(octet_length(b) - {WINDOW - 1})) as p from texts)),
late as (select r, p from (select r, p, id > min(id) over (partition by s) as is_late from starts) where is_late),
marked as (select r, p, coalesce(p > lag(p) over (partition by r order by p) + {WINDOW}, true) as opens from late),
numbered as (select r, p, sum(opens::int) over (partition by r order by p) as span from marked),
spans as (select r, span, min(p) as low, max(p) + {WINDOW} as high from numbered group by r, span),
kept as (
    select r, string_agg(hex(piece), '' order by low) as kept from (
        select t.r, s.low, t.b[coalesce(lag(s.high) over (partition by t.r order by s.low), 0) + 1:s.low] as piece from texts t join spans s on s.r = t.r
        union all select t.r, {LAST}, t.b[coalesce(s.high, 0) + 1:] from texts t left join (select r, max(high) as high from spans group by r) s on s.r = t.r
    ) group by r),
counted as (select r, sum(high - low) as n_removed, count(*) as n_spans from spans group by r)
select t.doc_id, octet_length(t.b)::BIGINT as n_bytes, coalesce(n_removed, 0)::BIGINT as n_removed, coalesce(n_spans, 0)::BIGINT as n_spans, sha256(unhex(kept)) as kept_sha256
from texts t join kept using (r) left join counted using (r)
"""
