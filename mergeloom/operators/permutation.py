"""Permutations of a corpus by arithmetic: a seed gives each row number a place, and each place the number back.

The keyed bijection is a swap-or-not network: in each round a number and its mirror image about the
round's key change places or not, as one bit says that both of them share. It is a permutation for
any number of rows, without numbers to skip, and its own inverse with the rounds reversed. So no
rows are sorted by random keys, and any stretch of the permuted corpus can be named without the rest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.sources.storage import Scratch

#: Rounds: a number stays with its mirror images throughout with a probability of 2**-ROUNDS.
ROUNDS = 32
#: Bits of monotonically_increasing_id that number the rows within a partition.
ROW_BITS = 33


def _rounds(start: Column, n: int, seed: int, order: range) -> Column:
    if n < 2:
        return start
    keys = [(k, int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16) % n) for k in order]
    steps = F.array(*[F.struct(F.lit(f"{seed}:{k}:").alias("name"), F.lit(key).cast("bigint").alias("key")) for k, key in keys])

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["key"] - x, F.lit(n).cast("bigint"))
        bit = F.substring(F.md5(F.concat(r["name"], F.greatest(x, other).cast("string")).cast("binary")), 1, 1) >= "8"
        return F.when(bit, other).otherwise(x)

    return F.aggregate(steps, start.cast("bigint"), step)


def place_of(number: Column, n: int, seed: int) -> Column:
    """The place, from 0 to n - 1, of each row number from 0 to n - 1; null gives null."""
    return _rounds(number, n, seed, range(ROUNDS))


def number_at(place: Column, n: int, seed: int) -> Column:
    """The row number that place_of puts at a place."""
    return _rounds(place, n, seed, range(ROUNDS - 1, -1, -1))


def numbered(rows: DataFrame, *order_cols: str, scratch: Scratch) -> DataFrame:
    """rows with number: their rank from 0 in order of order_cols. Rows alike in these are numbered in any order.

    Rows are sorted by ranges once and stored; the ranges' sizes, a row for each, are summed up.
    """
    if "number" in rows.columns:
        raise ValueError("rows has a column number")
    ranged = rows.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    stored = scratch.store(ranged.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftrightunsigned("at", ROW_BITS)
    sizes = sorted((r.part, r.n) for r in stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    within = F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return stored.join(F.broadcast(first), part == F.col("part")).select("r.*", (F.col("start") + within).alias("number"))


def permuted(rows: DataFrame, seed: int, *order_cols: str, scratch: Scratch | None = None) -> DataFrame:
    """rows with number, their rank in order of order_cols, and place in the permutation that seed gives."""
    if "place" in rows.columns:
        raise ValueError("rows has a column place")
    ranked = numbered(rows, *order_cols, scratch=scratch or Scratch(rows.sparkSession, "permuted"))
    return ranked.withColumn("place", place_of(F.col("number"), ranked.count(), seed))


def write_permuted(placed: DataFrame, folder: str, rows_per_file: int = 1 << 20) -> None:
    """Write rows in order of place, rows_per_file of them under each folder block=k."""
    block = F.floor(F.col("place") / rows_per_file)
    placed.withColumn("block", block).repartition("block").sortWithinPartitions("block", "place").write.partitionBy("block").parquet(folder)
