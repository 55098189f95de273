"""Bits of numbers, without Python in the plan."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_bits(v: Column) -> Column:
    """The IEEE 754 bits of a double as BIGINT."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("long")


def _binary(x: Column) -> Column:
    return F.lpad(F.bin(x), 64, "0")


def leading_zeros(x: Column) -> Column:
    """Zero bits above the highest set one; 64 for 0."""
    at = F.instr(_binary(x), "1")
    return F.when(at == 0, 64).otherwise(at - 1)


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest set one; 64 for 0."""
    at = F.instr(F.reverse(_binary(x)), "1")
    return F.when(at == 0, 64).otherwise(at - 1)


#: Widths of a storage id's fields, high to low: page, offset, length, count.
STORAGE_ID = (18, 16, 15, 15)


def pack_storage_id(page: Column, offset: Column, length: Column, count: Column) -> Column:
    """One BIGINT of 18 + 16 + 15 + 15 bits."""
    wide = [c.cast("long") for c in (page, offset, length, count)]
    return F.shiftleft(wide[0], 46).bitwiseOR(F.shiftleft(wide[1], 30)).bitwiseOR(F.shiftleft(wide[2], 15)).bitwiseOR(wide[3])


def unpack_storage_id(x: Column) -> dict[str, Column]:
    def field(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))

    return {"page": field(46, 18), "offset": field(30, 16), "length": field(15, 15), "count": field(0, 15)}
