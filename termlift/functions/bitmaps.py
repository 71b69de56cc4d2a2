"""Sets of entities as bitmaps: dense numbers, chunks of 64-bit words, counts of common members by AND and bit count.

A set is a row for each chunk of WORDS * 64 numbers in which it has members, with the words as columns, so that the AND of
two sets is a join on the chunk and WORDS machine operations, all within generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlift.functions.lineage import cut

WORDS = 16
_LOW = (1 << 33) - 1  # the place in its partition, in monotonically_increasing_id()


def dense_numbers(rows: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct values that are not null, numbered from 0 without gaps.

    Values are numbered within partitions; where a partition begins follows from one row each."""
    found = cut(rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_at", F.monotonically_increasing_id()))
    found = found.select(column, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_LOW)).alias("_at"))
    sizes = found.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return found.join(F.broadcast(begins), "_part").select(column, (F.col("_begin") + F.col("_at")).alias("number"))  # one row a partition


def bitmaps(rows: DataFrame, key: str, prefix: str, words: int = WORDS) -> DataFrame:
    """rows(key, number): (key, chunk, <prefix>0, <prefix>1, ...), repeated rows counting once. Words are combined before they are dealt."""
    number = F.col("number")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(number, 6) % words
    sets = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"{prefix}{i}") for i in range(words)]
    return rows.groupBy(key, F.floor(number / (64 * words)).alias("chunk")).agg(*sets)


def members(*prefixes: str, words: int = WORDS) -> Column:
    """How many members a row's sets have in common."""
    total = None
    for i in range(words):
        both = F.col(f"{prefixes[0]}{i}")
        for p in prefixes[1:]:
            both = both.bitwiseAND(F.col(f"{p}{i}"))
        total = F.bit_count(both) if total is None else total + F.bit_count(both)
    return total.cast("long")


def common(left: str, right: str, out: str, words: int = WORDS) -> list[Column]:
    """The words of the AND of two sets."""
    return [F.col(f"{left}{i}").bitwiseAND(F.col(f"{right}{i}")).alias(f"{out}{i}") for i in range(words)]
