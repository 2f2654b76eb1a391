"""Filters of bounded size that keep rows out of a shuffle; an exact join follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each id, and at least and at most. Beyond that (8 MB) more rows pass in vain.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 26


def filter_size(ids: int) -> int:
    """Bits for a filter of so many ids."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_EACH * ids).bit_length()))


def id_bits(ids: DataFrame, column: str, bits: int) -> bytes:
    """A bit for each hash value that occurs, gathered as words of 64 bits: at most bits / 64 rows come to
    the driver."""
    placed = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("place"))
    marked = placed.select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return held.astype("<i8").tobytes()


def bit_of(column: str, bits: int) -> Column:
    """The place of an id's bit."""
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")


def set_bits(bits: bytes, places: pa.Array) -> pa.Array:
    """Whether the bits of these places are set."""
    on, place = np.frombuffer(bits, np.uint8), places.to_numpy()
    return pa.array(on[place >> 3] >> (place & 7) & 1 == 1)
