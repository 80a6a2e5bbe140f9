"""A filter of list members that orders meet before they are shuffled.

The recipients' hashes are marked in a bitmap of 16 bits for each recipient, whose size follows from their number and stops
growing at 32 MB. An order passes if both marks of its customer are set: every recipient's order passes, and of the others
about one in seventy (more, but never fewer of the recipients', where the lists outgrow the bitmap). The exact join comes
after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, MOST_BITS, HASHES = 16, 1 << 28, 2
#: Bits of one of Spark's bitmaps.
PART = 8 * 4096


def _places(key: Column, parts: Column) -> list[Column]:
    """The marks of a key, as numbers from 0 in a bitmap of so many parts."""
    return [F.pmod(F.xxhash64(F.lit(seed), key), parts * PART) for seed in range(HASHES)]


def member_marks(touches: DataFrame, most_bits: int = MOST_BITS) -> tuple[Column, Column]:
    """The bitmap of all recipients, as an array of parts, and the number of parts: two values for any plan."""
    members = touches.where("recipient IS NOT NULL").select("recipient").distinct()
    needed = F.ceil(F.count(F.lit(1)) * BITS / PART)
    parts = members.agg(F.greatest(F.lit(1), F.least(needed, F.lit(most_bits // PART))).cast("long").alias("parts"))
    marked = members.select(F.explode(F.array(*_places(F.col("recipient"), parts.scalar()))).alias("place"))
    # Marks that fall together are one before they are moved; a part's marks then meet in one task.
    bitmaps = (
        marked.distinct()
        .groupBy(F.floor(F.col("place") / PART).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("place") % PART).alias("bits"))
    )
    every = parts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(bitmaps, "part", "left")
    empty = F.unhex(F.repeat(F.lit("00"), F.lit(PART // 8)))
    rows = F.array_sort(F.collect_list(F.struct("part", F.coalesce("bits", empty).alias("bits"))))
    return every.agg(rows["bits"].alias("bits")).scalar(), parts.scalar()


def likely_members(orders: DataFrame, touches: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The orders whose customers may be on a list: all that are, and few others."""
    bits, parts = member_marks(touches, most_bits)

    def is_set(place: Column) -> Column:
        part = F.element_at(bits, (F.floor(place / PART) + 1).cast("int"))
        within = (place % PART).cast("int")
        byte = F.ascii(F.decode(F.substring(part, F.floor(within / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        return byte.bitwiseAND(F.pow(F.lit(2), within % 8).cast("int")) != 0

    out = orders.where(F.col("customer_email").isNotNull())
    for place in _places(F.col("customer_email"), parts):
        out = out.where(is_set(place))
    return out
