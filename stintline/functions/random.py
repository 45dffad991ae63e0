"""Random numbers that depend on their key alone, never on partitions, retries or order.

``xxhash64`` hashes a key for each number. ``philox`` is a counter-based generator: a key names a stream, a counter a block of four
numbers, all in 64-bit integer columns, so any SQL engine gives the same. ``md5`` also does, at the cost of a digest a number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of Philox 4x32-10 (Salmon et al., 2011): multipliers, what the key grows by a round, rounds.
PHILOX_MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
PHILOX_WEYL = (0x9E3779B9, 0xBB67AE85)
PHILOX_ROUNDS = 10
WORD = 0xFFFFFFFF


def spawn(seed: int, stream: int = 0) -> tuple[int, int]:
    """The key of a stream of its own: 32 bits of the seed, and the stream's number."""
    if not 0 <= stream <= WORD:
        raise ValueError(f"a stream has 32 bits: {stream}")
    return seed & WORD, stream


def words(value: Column, kind: str) -> tuple[Column, Column]:
    """Two 32-bit words of an id: an integer's own bits, of anything else a hash's. A null counts as zero."""
    whole = F.coalesce(value.cast("bigint"), F.lit(0)) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(value)
    return whole.bitwiseAND(F.lit(WORD)), F.shiftrightunsigned(whole, 32)


def _product(multiplier: int, word: Column) -> tuple[Column, Column]:
    """High and low word of a 32 by 32 bit product, by halves, so that nothing exceeds 63 bits."""
    low = F.lit(multiplier) * word.bitwiseAND(F.lit(0xFFFF))
    high = F.lit(multiplier) * F.shiftright(word, 16) + F.shiftright(low, 16)
    return F.shiftright(high, 16), F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))


def philox(df: DataFrame, key: tuple[int, int], counter: list[Column], names: list[str]) -> DataFrame:
    """Add four integers of 32 bits, the block of ``counter`` (four columns of 32 bits) in the stream of ``key``.

    One projection a round: each of its results is used twice in the next, so they stay apart and are computed once.
    """
    k0, k1 = key
    # a null counts as zero: without null checks each round's code stays small enough to be compiled
    out = df.withColumns(dict(zip(names, [F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for c in counter])))
    for _ in range(PHILOX_ROUNDS):
        c = [F.col(n) for n in names]
        (high0, low0), (high1, low1) = _product(PHILOX_MULTIPLIERS[0], c[0]), _product(PHILOX_MULTIPLIERS[1], c[2])
        mixed = [high1.bitwiseXOR(c[1]).bitwiseXOR(F.lit(k0).cast("bigint")), low1, high0.bitwiseXOR(c[3]).bitwiseXOR(F.lit(k1).cast("bigint")), low0]
        out = out.withColumns(dict(zip(names, mixed)))
        k0, k1 = (k0 + PHILOX_WEYL[0]) & WORD, (k1 + PHILOX_WEYL[1]) & WORD
    return out


def uniforms(df: DataFrame, key: tuple[int, int], counter: list[Column], names: list[str]) -> DataFrame:
    """Add four uniforms in (0, 1), of 32 bits each."""
    drawn = philox(df, key, counter, names)
    return drawn.withColumns({n: (F.col(n) + F.lit(0.5)) / F.lit(float(2**32)) for n in names})


def uniform(*key: Column | str | int, engine: str = "xxhash64") -> Column:
    """Uniform in (0, 1) from the key's parts; 52 bits."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    if engine == "md5":
        text = F.concat_ws(":", *[p.cast("string") for p in parts])
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    else:
        bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def gumbel(u: Column, scale: float | Column = 1.0) -> Column:
    return -F.log(-F.log(u)) * scale


def normal(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms (Box and Muller)."""
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
