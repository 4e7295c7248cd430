"""A set of hashed keys as a bitmap of bounded size, built and asked with DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768  # bits in one row of bitmap_construct_agg


@dataclass
class Marked:
    """A bitmap of hashed keys: a table of one row, which plans read as a scalar."""

    table: DataFrame
    size: int
    columns: list[str]

    def may_hold(self) -> Column:
        """False only for rows whose key was not put in."""
        slot = slot_of(self.columns, self.size)
        byte = F.conv(F.hex(F.substring(self.table.scalar(), (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def slot_of(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def marked(keys: DataFrame, columns: list[str], least_bits: int = 1 << 18, most_bits: int = 1 << 25) -> Marked:
    """A bitmap with 16 bits or more for each row of keys, up to most_bits (4 MB); beyond, more rows pass that need not."""
    pages = max(1, least_bits // PAGE)
    n = keys.count()
    while pages * PAGE < min(16 * n, most_bits):
        pages *= 2
    slot = slot_of(columns, pages * PAGE)
    made = keys.groupBy((slot / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(PAGE))).alias("bits")).collect()  # `pages` rows at most
    found = {r["page"]: bytes(r["bits"]) for r in made}
    bits = b"".join(found.get(p, bytes(PAGE // 8)) for p in range(pages))
    return Marked(keys.sparkSession.createDataFrame([(bits,)], "bits binary"), pages * PAGE, columns)
