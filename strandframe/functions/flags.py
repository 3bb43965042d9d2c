"""Flag bits, the filters of the reports, and index bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
# Records a report leaves out if any of these bits is set.
NOT_EXAMINED = 0x904
NOT_COUNTED_MULTI = 0x804
NOT_DISTRIBUTED = 0x304
NOT_POSITIONED = 0x204
NOT_DISTANCED = 0x704
LEAST_QUALITY = 30


def has(bits: int, flag: str | Column = "flag") -> Column:
    """Whether any of ``bits`` is set."""
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bits) != 0


def lacks(bits: int, flag: str | Column = "flag") -> Column:
    return ~has(bits, flag)


def reg2bin(begin: Column, end: Column) -> Column:
    """The smallest bin of the five-level scheme (16 kb to 64 Mb) that holds [begin, end)."""
    last = end - 1
    value = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        value = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), F.shiftright(begin, shift) + first).otherwise(value)
    return value
