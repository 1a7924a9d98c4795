import hashlib

import pytest

from mergeloom.llm.exact_dedup import exact_dedup

TEXTS = ["a b", "ab", "a\tb ", None, "", "  ", "c", "ab", "x" * 50000, "x " * 50000, "ü", "c"]
SCHEMA = "doc_id bigint, text string, digest string, id int, row_id string"


def brute(rows):
    norm = lambda t: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return sorted(
        (i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in rows
        for g in [groups[norm(t)]]
    )


@pytest.mark.parametrize("key_hex", [64, 1])
def test_against_brute_force(spark, key_hex):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "d", 7, "r") for i, t in rows], SCHEMA)
    got = exact_dedup(docs, key_hex=key_hex)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute(rows)


def test_small_batches_give_the_same(spark):
    rows = [(i, f"t {i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = exact_dedup(docs, bytes_per_batch=1)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    rows = exact_dedup(docs).collect()
    assert len(rows) == 4
    assert sorted((r.keep_id, r.group_size) for r in rows if r.keep_id) == [(1, 3)] * 3
    assert sum(r.kept for r in rows) == 2


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("key_hex", [64, 1])
def test_later_deliveries_are_checked_against_earlier_ones(spark, tmp_path, key_hex):
    first = [(1, "a b"), (2, "c"), (3, "d"), (None, "e")]
    second = [(4, "ab"), (5, "c  "), (6, "new"), (6, "new"), (None, "e")]
    for rows, want in (
        (first, [(None, None, 1, True), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True)]),
        (second, [(None, None, 2, False), (4, 1, 2, False), (5, 5, 2, True), (6, 6, 2, False), (6, 6, 2, True)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = exact_dedup(docs, key_hex=key_hex, state=f"file://{tmp_path}/state").collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("key_hex", [64, 1])
def test_a_delivery_may_be_repeated(spark, tmp_path, key_hex):
    state = f"file://{tmp_path}/state"
    names = ("doc_id", "keep_id", "group_size", "kept")
    run = lambda rows, k: sorted(tuple(r[n] for n in names) for r in exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), key_hex=key_hex, state=state, delivery=k).collect())
    first, second = [(1, "a"), (2, "b")], [(3, "a "), (4, "c")]
    assert run(first, 1) == [(1, 1, 1, True), (2, 2, 1, True)]
    assert run(first, 1) == [(1, 1, 1, True), (2, 2, 1, True)]
    (tmp_path / "state" / "arriving" / "2").mkdir()  # a broken attempt
    (tmp_path / "state" / "arriving" / "2" / "part-0.parquet").write_bytes(b"x")
    want = [(3, 3, 2, True), (4, 4, 1, True)]
    assert run(second, 2) == want and run(second, 2) == want
    assert run(first, 1) == [(1, 3, 2, False), (2, 2, 1, True)]
