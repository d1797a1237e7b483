"""Rows that may have one of many wanted keys, told by a bitmap of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
PAGE = 1 << 15
"""Bits of a bitmap's row; the rows of all come to BITS / 8 bytes, 8 MB, at most."""


def position(keys: tuple[Column, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def screened(rows: DataFrame, keys: tuple[Column, ...], wanted: DataFrame, wanted_keys: tuple[Column, ...]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``keys`` may be in ``wanted``, and those whose are not.

    A wanted key is always in the first part, with others whose bit is set too; more so
    the more keys are wanted, until the part is the whole. So a join after it has the same
    result, and shuffles fewer rows where few are wanted.
    """
    at = wanted.select(position(wanted_keys).alias("p")).select(F.shiftright("p", 15).alias("_page"), F.col("p").bitwiseAND(PAGE - 1).alias("bit"))
    pages = at.groupBy("_page").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    place = position(keys)
    bit = place.bitwiseAND(PAGE - 1)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(pages), F.shiftright(place, 15) == F.col("_page"), "left")  # BITS / 8 bytes at most
    set_ = F.col("_bits").isNotNull() & (F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1)
    return tuple(marked.filter(c).select(*rows.columns) for c in (set_, ~set_))
