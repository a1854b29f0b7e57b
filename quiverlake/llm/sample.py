"""A uniform sample of fixed size from rows that arrive in pieces.

Every item gets a random key that depends on the seed and its index only, so it is the same in whatever
piece, order or number of copies the item arrives. The keys are written down piece by piece; the sample of
size n is the items with the n smallest keys. The n-th smallest is found exactly by counting: a histogram
over the leading digits says in which bin it lies, the next one refines that bin, until all digits are
known. A filter by that key is the sample. There is no global sort and no heap, and the driver sees
histograms of fixed size only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.vectors import usable
from quiverlake.session import cut

KEY_BITS, DIGIT_BITS = 60, 12


def random_key(index: Column, seed: int) -> Column:
    """60 random bits of an index: the first 15 hexadecimal digits of the MD5 of ``seed:index``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string"))), 1, 15), 16, 10).cast("bigint")


def keys_of(piece: DataFrame, seed: int, dim: int, index: str = "vec_index", vector: str = "v") -> DataFrame:
    """``(index, key)`` of the usable items of one piece, copies once. Rows without an index are no items."""
    fit = piece.where(F.col(index).isNotNull() & usable(vector, dim))
    return fit.select(F.col(index).alias("index")).distinct().select("index", random_key(F.col("index"), seed).alias("key"))


def persist_keys(pieces: Iterable[DataFrame] | DataFrame, seed: int, dim: int, **names: str) -> DataFrame:
    """The keys of all pieces as a written table, each item once even if its copies came in different pieces."""
    if isinstance(pieces, DataFrame):
        return cut(keys_of(pieces, seed, dim, **names), "keys")
    tables = [cut(keys_of(p, seed, dim, **names), "keys") for p in pieces]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct() if len(tables) > 1 else out


def kth_smallest(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """(the k-th smallest key, how many of the rows with just this key belong to the k smallest); None if there are fewer than k rows."""
    prefix, left, shift = 0, k, KEY_BITS
    while shift:
        shift -= DIGIT_BITS
        within = F.shiftright("key", shift + DIGIT_BITS) == prefix
        digit = F.shiftright("key", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        low, high = prefix << (shift + DIGIT_BITS), (prefix + 1) << (shift + DIGIT_BITS)
        rows = keys.where((F.col("key") >= low) & (F.col("key") < high) & within).groupBy(digit.alias("d")).count()
        for d, n in sorted((r["d"], r["count"]) for r in rows.collect()):  # at most 2 ** DIGIT_BITS rows
            if left <= n:
                prefix = prefix << DIGIT_BITS | d
                break
            left -= n
        else:
            return None
    return prefix, left


def draw(items: DataFrame, n: int, seed: int, dim: int, index: str = "vec_index", vector: str = "v", keys: DataFrame | None = None) -> DataFrame:
    """``n`` usable items of ``items``, each with the same chance, as ``(index, sample_key, vector)``.

    With ``n`` at or above the number of items all come out, with ``n`` <= 0 none. Items are told apart by
    their index; items loaded twice count once; unusable vectors and null indexes never. Equal keys are taken
    by the smaller index. Other columns of ``items`` are not read. ``keys`` are those of ``persist_keys``.
    """
    key = random_key(F.col(index), seed)
    fit = items.where(F.col(index).isNotNull() & usable(vector, dim)).select(index, key.alias("sample_key"), vector)
    if n <= 0:
        return fit.limit(0)
    keys = persist_keys(items, seed, dim, index=index, vector=vector) if keys is None else keys
    last = kth_smallest(keys, n)
    if last is None:
        return fit.dropDuplicates([index])
    at, ties = last
    below = fit.where(F.col("sample_key") < at).dropDuplicates([index])
    equal = fit.where(F.col("sample_key") == at).dropDuplicates([index]).orderBy(index).limit(ties)
    return below.unionByName(equal)
