"""Leave out rows that a semi join would drop, before it moves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 32  # one row in so many passes for nothing
MOST_WORDS = 1 << 20  # 8 MB; more keys only let more rows through to the join
_WORD = 64


class Sieve:
    """One bit of a table per key, found by hash. The table is a scalar subquery of bounded size."""

    def __init__(self, keys: DataFrame, key: str):
        listed = keys.select(key).where(F.col(key).isNotNull())
        self.key, self.words = key, min(max(1, -(-listed.count() * BITS_PER_KEY // _WORD)), MOST_WORDS)
        filled = listed.groupBy(self._word().alias("at")).agg(F.bit_or(self._mask()).alias("bits"))
        numbers = keys.sparkSession.range(self.words).select(F.col("id").cast("int").alias("at"))
        word = F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        table = numbers.join(filled, "at", "left").agg(F.array_sort(F.collect_list(word)).alias("t"))
        self.bits = table.select(F.transform("t", lambda x: x["bits"])).scalar()

    def _bit(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("sieve"), self.key), F.lit(self.words * _WORD))

    def _word(self) -> Column:
        return F.shiftright(self._bit(), 6).cast("int")

    def _mask(self) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), self._bit().bitwiseAND(_WORD - 1).cast("int"))

    def sifted(self, rows: DataFrame) -> DataFrame:
        """``rows`` without most of those whose key is not listed; a row whose key is listed is never lost.

        An exact join has to follow. Null keys match nothing and go.
        """
        return rows.where(F.get(self.bits, self._word()).bitwiseAND(self._mask()) != 0)
