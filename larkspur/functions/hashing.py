"""Hash expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits (offset basis and prime).
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211

_LOW = (1 << 32) - 1


def _limbs(text: Column) -> Column:
    """FNV-1a as (high, low) halves of 32 bits: products of halves never overflow a long.

    The prime is 2^40 + 435, so h * prime = h * 435 + (h << 40).
    """
    hexed = F.hex(F.encode(text, "UTF-8"))
    ats = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    data = F.transform(ats, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & _LOW).cast("long").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        mixed = acc["lo"].bitwiseXOR(byte)
        low = mixed * (FNV_PRIME & _LOW)
        high = acc["hi"] * (FNV_PRIME & _LOW) + F.shiftright(low, 32) + F.shiftleft(mixed, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.aggregate(data, start, step)


def fnv1a_hex(text: Column) -> Column:
    """The 64-bit hash as 16 hex digits."""
    h = _limbs(text)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def fnv1a_bucket(text: Column, buckets: int) -> Column:
    """The unsigned hash modulo a number of buckets."""
    h = _limbs(text)
    return ((h["hi"] % buckets) * ((1 << 32) % buckets) + h["lo"]) % buckets


def fnv1a_many(words: list[str]) -> np.ndarray:
    """The 64-bit hashes of words in a task, all words a byte at a time."""
    data = [w.encode() for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    starts, text = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(data), np.uint8)
    longer = len(data) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")  # words that have a byte there
    found = np.full(len(data), FNV_OFFSET, np.uint64)
    for i, n in enumerate(longer.tolist()):
        found[:n] = (found[:n] ^ text[starts[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(found)
    out[order] = found
    return out
