"""Tables of bits over hashes, broadcast to tell most rows before a shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

CELL = 12  # 2 ** 12 bits a row
BITS = (26, 29)  # least and most bits of a table, as powers of two (8 MB, 64 MB)
BITS_A_KEY = 64


@dataclass
class Bits:
    cells: DataFrame  # (cell, words array<long>), those with a bit set
    bits: int  # in all, as a power of two


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << CELL - 6) - 1)).cast("int")


def bit_table(hashes: DataFrame, n: int, name: str) -> Bits:
    """Bits over the ``n`` hashes in the only column, those of a hash set, written
    once. About 64 bits a hash up to 64 MB, whatever their number."""
    bits = min(max(math.ceil(math.log2(max(n, 1) * BITS_A_KEY)), BITS[0]), BITS[1])
    hashes = hashes.toDF("hash").where("hash is not null")
    h = F.col("hash")
    keys = hashes.select(F.shiftrightunsigned(h, 64 - bits + CELL).alias("cell"), _word(h).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    words = keys.groupBy("cell", "word").agg(F.bit_or("bit").alias("bits"))
    cells = words.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit((1 << CELL - 6) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return Bits(materialize(cells.select("cell", every.alias("words")), name), bits)


def maybe(rows: DataFrame, h: Column, table: Bits, flag: str | None = None) -> DataFrame:
    """The rows whose hash ``h`` has its bit set: all with a hash of the table, and a
    few more. With ``flag`` all rows, and the column of that name tells."""
    rows = rows.withColumn("_cell", F.shiftrightunsigned(h, 64 - table.bits + CELL))
    rows = rows.join(F.broadcast(table.cells), F.col("_cell") == F.col("cell"), "left" if flag else "inner")
    is_set = F.getbit(F.get("words", _word(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    rows = rows.withColumn(flag, F.coalesce(is_set, F.lit(False))) if flag else rows.where(is_set)
    return rows.drop("_cell", "cell", "words")
