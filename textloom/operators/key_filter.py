"""A Bloom filter over the keys of a smaller table, in front of an exact join that then sees only what passes it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: A filter larger than this isn't made: the join then goes without.
MOST_BYTES = 16 << 20


def _halves(columns: Sequence[str]) -> tuple[Column, Column]:
    h = F.xxhash64(*columns)
    return h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))


class KeyFilter:
    """Bits of a set of keys. ``may_hold`` is true for each of them, and for a share ``rate`` of others."""

    def __init__(self, words: np.ndarray, bits: int, hashes: int, session):
        self.bits, self.hashes = bits, hashes
        self.words = session.sparkContext.broadcast(words)

    @staticmethod
    def size(n: int, rate: float) -> tuple[int, int]:
        """(bits, hashes) for ``n`` keys."""
        bits = max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
        return bits, max(1, round(bits / max(n, 1) * math.log(2))) if n else 1

    @classmethod
    def build(cls, keys: DataFrame, columns: Sequence[str], rate: float = 0.01, most_bytes: int = MOST_BYTES, n: int | None = None) -> KeyFilter | None:
        """The filter over ``columns`` of ``keys``, or None if it would be larger than ``most_bytes``.

        Sized from the count; the bits are set on the executors, with partial results, and come to the driver as words of 64.
        """
        n = keys.count() if n is None else n
        bits, hashes = cls.size(n, rate)
        if bits // 8 > most_bytes:
            return None
        low, high = _halves(columns)
        at = keys.select(low.alias("low"), high.alias("high")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: (F.col("low") + k * F.col("high")) % bits)).alias("at"))
        set_bits = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
        words = np.zeros(bits // 64, dtype=np.int64)
        for word, value in set_bits.toLocalIterator():
            words[word] = value
        return cls(words.view(np.uint64), bits, hashes, keys.sparkSession)

    def may_hold(self, *columns: str) -> Column:
        words, bits, hashes = self.words, self.bits, self.hashes

        @pandas_udf("boolean")
        def test(low: pd.Series, high: pd.Series) -> pd.Series:
            low, high, held = low.to_numpy(), high.to_numpy(), np.ones(len(low), dtype=bool)
            for k in range(hashes):
                at = (low + k * high) % bits
                held &= (words.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            return pd.Series(held)

        return test(*_halves(columns))


def semi_join(rows: DataFrame, keys: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """``rows`` whose ``columns`` are in ``keys``: only what passes the filter is shuffled."""
    found = KeyFilter.build(keys, columns, **options)
    return (rows if found is None else rows.filter(found.may_hold(*columns))).join(keys.select(*columns), list(columns), "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """``rows`` whose ``columns`` are not in ``keys``: what doesn't pass the filter stays where it is, the rest is joined.

    A null in ``columns`` is in no table of keys. ``rows`` is read twice.
    """
    found = KeyFilter.build(keys, columns, **options)
    if found is None:
        return rows.join(keys.select(*columns), list(columns), "left_anti")
    passes = found.may_hold(*columns)
    # An anti-join by name puts nothing in another order, so both parts have the columns of ``rows``.
    return rows.filter(~passes).unionByName(rows.filter(passes).join(keys.select(*columns), list(columns), "left_anti").select(*rows.columns))
