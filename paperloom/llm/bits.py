"""Bit tables of 64-bit keys: a bounded broadcast that tells whether a key may be among some."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 16, 1 << 28, 16
_U = np.uint64


class BitTable:
    """Whether a key may be among some; never wrong about those that are."""

    def __init__(self, bits: int, number: np.ndarray, word: np.ndarray):
        self.bits = _U(bits - 1)
        self.table = np.zeros(bits >> 6, dtype=np.uint64)
        self.table[number] = word.view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        a, b = keys & self.bits, (keys >> _U(32)) & self.bits
        one = _U(1)
        return ((self.table[(a >> _U(6)).view(np.int64)] >> (a & _U(63))) & (self.table[(b >> _U(6)).view(np.int64)] >> (b & _U(63))) & one) == one


def bit_table(keys: DataFrame, key: str = "key") -> BitTable:
    """A bit table of the keys: as many bits as they need, at most ``MOST_BITS``, a fuller table only lets more keys through.

    Its words are made by a grouped ``bit_or``, so at most ``MOST_BITS`` / 64 rows reach the driver.
    """
    wanted = BITS_A_KEY * keys.count()
    bits = LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    mask = F.lit(bits - 1)
    at = F.explode(F.array(F.col(key).bitwiseAND(mask), F.shiftright(key, 32).bitwiseAND(mask)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("number")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("word")
    ).toArrow()
    return BitTable(bits, words["number"].to_numpy(), words["word"].to_numpy())
