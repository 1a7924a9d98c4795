import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mergeloom.operators import encoding as E
from mergeloom.operators import trie
from mergeloom.operators.batches import Trie
from mergeloom.operators.training import Merge, token_bytes, vocabulary
from mergeloom.sources import model_io

AB = [Merge(97, 98, 256, 9)]


def tokens(spark, texts, merges):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r.tokens for r in E.encode_merge_order(docs, merges).collect()}


def test_merge_order_vectors(spark):
    assert tokens(spark, ["abab", "", None], AB) == {0: [256, 256], 1: [], 2: None}
    assert tokens(spark, ["ğ"], []) == {0: [196, 159]}
    with pytest.raises(ValueError, match="no model"):
        tokens(spark, ["a"], None)


def test_long_lists_agree_with_short_ones(spark):
    rng = random.Random(1)
    merges = []
    for k in range(80):
        merges.append(Merge(rng.choice([97, 98, 99, *range(256, 256 + k)]), rng.choice([97, 98, 99]), 256 + k, 2))
    texts = ["".join(rng.choice("abcé ") for _ in range(200)) for _ in range(20)]
    got = tokens(spark, texts, merges)
    for k, text in enumerate(texts):
        ids = list(text.encode())
        for m in merges:
            out, i = [], 0
            while i < len(ids):
                pair = ids[i : i + 2] == [m.a, m.b]
                out.append(m.new_id if pair else ids[i])
                i += 1 + pair
            ids = out
        assert got[k] == ids and E.decode_bytes(ids, merges) == text.encode()


def longest_match(value, vocabulary, size):
    ids, chunks, _ = Trie(vocabulary).encode(np.frombuffer(value, np.uint8), np.array([0, len(value)]), size)
    return [ids[a:b].tolist() for a, b in zip(chunks[:-1], chunks[1:], strict=True)]


def test_longest_match_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [bytes([b]) for b in range(256)] + [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    table = {b: k for k, b in enumerate(vocab)}
    texts = ["".join(rng.choice("abcd\u00e9") for _ in range(rng.randint(0, 3000))) for _ in range(25)] + [None, "abcab" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, part in ((None, None), (7, None), (64, 1000)):
        got = {r.id: r.chunks for r in E.encode_longest_match(docs, vocab, size=size, part_bytes=part).collect()}
        for k, text in enumerate(texts):
            want, value = [], (text or "").encode()
            for begin in range(0, len(value), size or 512):
                at, end, own = begin, min(begin + (size or 512), len(value)), []
                while at < end:
                    n = next(n for n in range(min(7, end - at), 0, -1) if value[at : at + n] in table)
                    own.append(table[value[at : at + n]])
                    at += n
                want.append(own)
            assert got[k] == (None if text is None else want)


def test_longest_match_vectors():
    vocab = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    assert longest_match(b"abcab", vocab, 512) == [[257, 256]]
    assert longest_match(b"abcab", vocab, 2) == [[256], [99, 97], [98]]
    assert [E.chunk_size(n) for n in (1, 100, 1000)] == [512, 800, 2048]


def test_equal_tokens_the_last_counts(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r.chunks for r in E.encode_longest_match(docs, [bytes([b]) for b in range(256)] + [b"ab", b"", b"ab"]).collect()}
    assert rows == {1: [[258]], 2: [], 3: None}


def test_decode_unknown_and_round_trip(spark):
    docs = spark.createDataFrame([(1, "abc ğ ab"), (2, "x")], "id int, text string")
    vocab = vocabulary(spark, AB)
    rows = {r.id: bytes(r.bytes).decode() for r in E.decode(E.encode_merge_order(docs, AB), vocab, "id").collect()}
    assert rows == {1: "abc ğ ab", 2: "x"}
    odd = spark.createDataFrame([(1, [97, 400, -1]), (2, []), (3, None)], "id int, tokens array<int>")
    assert {r.id: r.bytes and bytes(r.bytes) for r in E.decode(odd, vocab, "id").collect()} == {1: b"a" + b"\xef\xbf\xbd" * 2, 2: b"", 3: None}


def test_trie_round_trip_and_refusals(spark):
    vocab = vocabulary(spark, [*AB, Merge(256, 99, 257, 2)])
    blob = bytes(trie.trie_blob(spark, vocab).first().trie)
    head, nodes, edges = trie.parse(blob)
    assert (head["longest"], head["vocab_size"], len(nodes), len(edges)) == (3, 258, 259, 258)

    def walk(value):
        at = 0
        for b in value:
            first, n, _ = nodes[at]
            at = next(edges[k - 1][1] for k in range(first, first + n) if edges[k - 1][0] == b)
        return nodes[at][2]

    assert walk(b"abc") == 257 and walk(b"ab") == 256 and walk(b"a") == 97
    for bad in (b"", b"\0" * 28, blob[:-1]):
        with pytest.raises(ValueError):
            trie.parse(bad)
    old = struct.pack("<7I", trie.MAGIC, 2, 2, 1, 1, 1, 0) + struct.pack("<4H", 1, 1, 0xFFFF, 0) + struct.pack("<4H", 2, 0, 5, 0) + struct.pack("<2H", 97, 1)
    assert trie.parse(old)[1:] == ([(1, 1, trie.NONE), (2, 0, 5)], [(97, 1)])


def test_models_and_exports(spark, tmp_path):
    model_io.write_model(spark, AB, str(tmp_path / "m"))
    model = model_io.read_model(spark, str(tmp_path / "m"))
    assert model.first().vocabSize == 257
    rows = {r.token_id: bytes(r.bytes) for r in model_io.model_vocabulary(model).collect()}
    assert rows == dict(enumerate(token_bytes(AB)))
    with pytest.raises(Exception, match="needs vocab"):
        model_io.parse_models(spark.createDataFrame([('{"version": 1}',)], "value string")).collect()
    encoded = E.encode_merge_order(spark.createDataFrame([(1, "abx")], "id int, text string"), AB)
    blob = bytes(model_io.token_blob(encoded, "{}", 257, "id").first().export)
    assert model_io.parse_token_blob(blob) == (257, [256, 120], "{}")
    text = model_io.vocabulary_text(vocabulary(spark, AB).where(F.col("token_id") >= 255)).first().text
    assert text == "# Vocabulary\n# Total tokens: 2\n\n255\t<0xFF>\t[255]\n256\tab\t[97,98]\n"


def test_ids_of_a_batch_are_given_out_slice_by_slice(spark):
    from mergeloom.operators.batches import MergeTable, Trie
    from mergeloom.operators.encoding import matched_slices, merged_slices
    from mergeloom.plans import queries
    from mergeloom.sources.storage import BATCH_SETTINGS

    rows = [b"ab" * 150_000, None, b"", b"b" * 300_000] * 4
    table, trie = MergeTable([(97, 98, 256)]), Trie([bytes([k]) for k in range(256)] + [b"ab"])
    merged = list(merged_slices(table, iter([pa.array(rows, pa.binary())])))
    matched = list(matched_slices(trie, 512, iter([pa.array(rows, pa.binary())])))
    for parts in (merged, matched):
        assert len(parts) > 1 and pa.concat_arrays(parts).is_valid().to_pylist() == [r is not None for r in rows]
    assert max(len(p.flatten()) for p in merged) <= 1 << 20
    assert pa.concat_arrays(merged).slice(0, 4).to_pylist() == [[256] * 150_000, None, [], [98] * 300_000]
    assert [None if r is None else [t for c in r for t in c] for r in pa.concat_arrays(matched).slice(0, 4).to_pylist()] == [[256] * 150_000, None, [], [98] * 300_000]
    # the queries' tables bound what a task gets at a time, by rows and by bytes
    queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert all(spark.conf.get(k) == v for k, v in BATCH_SETTINGS.items())
    assert int(BATCH_SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 16 << 20
