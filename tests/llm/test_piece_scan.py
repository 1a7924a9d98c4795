import random

import numpy as np
import pytest

from mergeloom.llm import piece_scan
from mergeloom.llm.piece_scan import SPACE, combined, decode_documents, encode_documents, pieces_of, states_at_borders

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = ["The cat sat.", "", " ", "  two  spaces ", "Été 中 \n\t x▁y", "abcdefgh" * 200, "naïve ünïcode \U0001f600!", "a" * 3000, "x  " * 30, "日本語のテキスト" * 90]


def library(texts):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=FILE).encode(texts)


def random_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeht  é中") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["".join(rng.choice(["the", "ing", "er", "a", "st", "un", "break", "\n", "12"]) for _ in range(rng.randint(1, 700))) for _ in range(20)]
    return texts + ["".join(chr(rng.randint(33, 0x2FFF)) for _ in range(2000))]


def encoded(pieces, texts, chunk=512):
    ids, at = pieces.encode([t.encode() for t in texts], chunk)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("chunk", [512, 32])
def test_ids_are_the_library_s(chunk):
    pieces = pieces_of(FILE)
    pieces._forget()
    texts = TEXTS + random_texts()
    assert encoded(pieces, texts, chunk) == library(texts)


def test_ids_of_documents_are_the_library_s():
    pq = pytest.importorskip("pyarrow.parquet")
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert encoded(pieces_of(FILE), texts) == library(texts)


def test_neighbours_against_encoding_them():
    pieces = pieces_of(FILE)
    rng = random.Random(4)
    some = [i for i in range(300, 20000) if not pieces.text[i].startswith(b" ") and pieces.text[i].decode("utf-8", "replace") in pieces.reached]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(300)]
    # the library puts a space in front: a space that no piece of the pair joins changes nothing
    asked = pieces.side_by_side(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), fits in zip(pairs, asked, strict=True):
        word = (pieces.text[a] + pieces.text[b]).decode()
        ids, _ = pieces._words(np.array([len(word)]), np.frombuffer(word.encode("utf-32-le"), np.uint32))
        assert (ids.tolist() == [a, b]) == bool(fits)


def test_matrices_combine_associatively():
    pieces = pieces_of(FILE)
    codes = np.frombuffer((SPACE + "thecatsatonthematandthedog" * 20).encode("utf-32-le"), np.uint32)
    m = pieces.matrices(pieces.chunked(codes, 40))
    left = m[0]
    for x in m[1:]:
        left = combined([left, x])
    right = m[-1]
    for x in m[-2::-1]:
        right = combined([x, right])
    assert left.shape == (1, 1) and np.isfinite(left[0, 0])
    assert np.allclose(left, right) and np.allclose(left, combined(m)) and len(states_at_borders(m, 0, 0)) == len(m) + 1


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(piece_scan, "FAN", 3)  # several levels of products
    rng = random.Random(5)
    giant = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(4000)) + "z" * 3000
    texts = TEXTS[:4] + [None, giant, "unbroken" * 2000, giant, "the" * 3003]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "null id", 1, "x"), (None, "null id", 1, "x")], "doc_id bigint, text string, row int, ids string")
    rows = encode_documents(docs, model_file=FILE, giant_chars=9000, chunk_chars=1000)
    found = {r.doc_id: r.ids for r in rows.collect()}
    plain = {r.doc_id: r.ids for r in encode_documents(docs, model_file=FILE).collect()}
    want = dict(enumerate(library([t or "" for t in texts]))) | {4: None, None: library("null id")}
    assert found == want and plain == want
    decoded = decode_documents(rows, model_file=FILE, keep=("doc_id",)).collect()
    assert len(decoded) == len(texts) + 2 and {r.doc_id: r.decoded for r in decoded} == dict(enumerate(texts)) | {None: "null id"}
    assert encode_documents(docs.where("doc_id > 99"), model_file=FILE).count() == 0
