import numpy as np
import pytest

from mergeloom.llm.token_counts import count_tokens, document_token_counts, rank_encoding

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(ids, end):
    out, start, n = [], 0, 0
    for k, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, n, True))
            start, n = k + 1, 0
        else:
            n += 1
    return out + ([(len(out), start, n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 19])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {"a": rng.integers(0, 9, 500), "b": np.full(40, 3), "c": np.array([3, 3, 1]), "d": np.full(90, 5), "e": np.array([], int), "f": np.array([1, 3])}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    got = count_tokens(spark, str(tmp_path), end_id=3, block_tokens=block).collect()
    check(files, got)


def check(files, got):
    for name, ids in files.items():
        mine = sorted((r.place, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith(f"/{name}"))
        assert mine == brute(ids.tolist(), 3), name


@pytest.mark.parametrize(("end", "seed"), [(0, 1), (3, 2), (0x0303, 3), (0x0300, 4), (771, 5)])
def test_byte_ranges_of_one_file(spark, tmp_path, end, seed):
    """Ranges that begin anywhere, with bytes that match the end id across two tokens."""
    rng = np.random.default_rng(seed)
    some = np.array([end, 3, 0x0300, 0, 0x0303, 5])
    files = {"a": rng.choice(some, 3001), "b": np.r_[rng.choice(some, 999), end], "c": np.r_[np.full(700, 9), end, np.full(5, 0x0003)]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1201")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    got = count_tokens(own, str(tmp_path), end_id=end, block_tokens=64).collect()
    for name, ids in files.items():
        mine = sorted((r.place, r.start, r.n_tokens, r.closed) for r in got if r.file.endswith(f"/{name}"))
        assert mine == brute(ids.tolist(), end), name


def test_documents(spark):
    texts = ["one two three", "", None, "a" * 3000, "x <|endoftext|> y", "naïve ünïcode", "word " * 20000, "one two three"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id bigint, text string, part int, empty int").repartition(3)
    from mergeloom.llm.common import materialize

    got = {r.doc_id: r.n_tokens for r in document_token_counts(materialize(docs, "test"), rank_file=RANKS).collect()}
    encoding = rank_encoding(RANKS)
    assert got == {k: len(encoding.encode_ordinary(t or "")) for k, t in enumerate(texts)}
    odd = materialize(spark.createDataFrame([(None, "a b"), (None, ""), (7, "a b"), (7, "a b")], "doc_id bigint, text string"), "test")
    assert sorted((str(r.doc_id), r.n_tokens) for r in document_token_counts(odd, rank_file=RANKS).collect()) == [("7", 2), ("7", 2), ("None", 0), ("None", 2)]
    empty = materialize(docs.where("doc_id > 99"), "test")
    assert document_token_counts(empty, rank_file=RANKS).count() == 0


def test_odd_size_is_refused(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    with pytest.raises(Exception, match="2-byte tokens"):
        count_tokens(spark, str(tmp_path), end_id=3)
