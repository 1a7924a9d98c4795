import hashlib

import pytest
from pyspark.sql import functions as F

from mergeloom.operators import permutation
from mergeloom.sources.storage import Scratch


def plain(x, n, seed):
    for k in range(permutation.ROUNDS):
        key = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16) % n
        other = (key - x) % n
        if hashlib.md5(f"{seed}:{k}:{max(x, other)}".encode()).hexdigest()[0] >= "8":
            x = other
    return x


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000])
def test_a_permutation_for_any_n(spark, n):
    rows = spark.range(n).select("id", permutation.place_of(F.col("id"), n, 7).alias("place")).withColumn("back", permutation.number_at(F.col("place"), n, 7)).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    assert all(r.back == r.id and r.place == plain(r.id, n, 7) for r in rows)


def test_large_numbers_null_and_seeds(spark):
    n = 10**15
    r = spark.createDataFrame([(n - 1, None)], "a bigint, b bigint").select(permutation.place_of(F.col("a"), n, 1).alias("a"), permutation.place_of(F.col("b"), n, 1).alias("b"), permutation.place_of(F.col("a"), n, 2).alias("c")).first()
    assert r.a == plain(n - 1, n, 1) and r.b is None and r.a != r.c


def test_places_are_spread(spark):
    n = 4000
    rows = spark.range(n).select("id", permutation.place_of(F.col("id"), n, 3).alias("place")).collect()
    for part in range(4):  # of each quarter of the rows about a quarter in each quarter of the places
        for other in range(4):
            found = sum(r.id * 4 // n == part and r.place * 4 // n == other for r in rows)
            assert 190 < found < 310


def test_rows_are_numbered_in_order_and_written_by_place(spark, tmp_path):
    rows = spark.createDataFrame([(k * 37 % 100, f"t{k}", k, 5) for k in range(100)], "id int, text string, at int, part int").repartition(7)
    got = sorted((r.number, r.id) for r in permutation.numbered(rows, "id", scratch=Scratch(spark, "t")).collect())
    assert got == [(k, k) for k in range(100)]
    placed = permutation.permuted(rows, 5, "id")
    permutation.write_permuted(placed, f"{tmp_path}/out", 30)
    back = spark.read.parquet(f"{tmp_path}/out").orderBy("place").collect()
    assert [r.place for r in back] == list(range(100)) and [r.block for r in back] == [k // 30 for k in range(100)]
    assert all(plain(r.id, 100, 5) == r.place for r in back)
    assert permutation.permuted(rows.limit(0), 5, "id").count() == 0
    with pytest.raises(ValueError, match="place"):
        permutation.permuted(rows.withColumn("place", F.lit(1)), 5, "id")
