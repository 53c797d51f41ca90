"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS

WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, separator: str = WHITE) -> Column:
    """Words of a text (null: none), never an empty string among them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def bitmap_chunks(df: DataFrame, column: str) -> DataFrame:
    """Fixed-size bitmap of the hashes in ``column``: at most 4096 rows of 4 KB, so 16 MB whatever the input."""
    bit = F.col(column).bitwiseAND(BITMAP_BITS - 1)
    return df.groupBy(F.shiftright(bit, 15).alias("chunk_")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits_"))


def split_by_bitmap(df: DataFrame, column: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be in the bitmap, rows whose hash is not): spares the others a shuffle."""
    bit = F.col(column).bitwiseAND(BITMAP_BITS - 1)
    place = bit.bitwiseAND(32767)
    joined = df.join(F.broadcast(chunks), F.shiftright(bit, 15) == F.col("chunk_"), "left")
    byte = F.conv(F.hex(F.substring("bits_", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return joined.filter(found).select(*df.columns), joined.filter(~found).select(*df.columns)
