import numpy as np
import pyarrow as pa
import pytest

words = pytest.importorskip("mergeloom.llm.words")
public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n):
    """The word over a and b of n characters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(n) for n in (64, 256, 1024, 2048, 4096, 8192)]


def hashes(texts, folded=True):
    return words.hash_words(words.find_words(pa.array(texts, pa.binary())), folded)


@pytest.mark.parametrize("one, two", PAIRS)
def test_constructed_words_differ(one, two):
    a, b, c = hashes([one.encode(), two.encode(), one.upper().encode()]).tolist()
    assert a != b and a == c
    assert hashes([one.upper().encode()], False) != hashes([one.encode()], False)


def test_hash_depends_on_the_word_alone():
    rng = np.random.default_rng(1)
    known = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (*range(1, 40), 511, 512, 513, 2000)]
    alone = [hashes([w])[0] for w in known]
    assert hashes([b" ".join(known)]).tolist() == alone and hashes([b"x\n", *known, None]).tolist()[1:] == alone
    assert len(set(alone)) == len(known)
    assert hashes([b"abc\x00", b"abc", b"abc\x00\x00"]).tolist() != [alone[0]] * 3 and len(set(hashes([b"abc\x00", b"abc", b"abc\x00\x00"]).tolist())) == 3


def test_shingles_are_no_sums():
    one = np.array([1, 2, 3, 4], np.uint64)
    two = one + np.array([1, np.uint64(2**64 - words.MULTIPLIER), 0, 0], np.uint64)  # alike in a linear sum of pairs
    assert words.shingles(one[:2], np.array([2]), 2)[0] != words.shingles(two[:2], np.array([2]), 2)[0]


def test_known_words_tell_clashes_apart():
    known = words.KnownWords()
    numbers = {}
    for texts in (["one two three", "two"], ["four two", "one four five"], ["five three"]):
        found = words.find_words(pa.array([t.encode() for t in texts], pa.binary()))
        slots, new = known.slots(found, np.full(len(found.starts), 7, np.uint64))
        spelled = " ".join(texts).split()
        for k in new.tolist():
            assert spelled[k] not in numbers
            numbers[spelled[k]] = len(numbers)
        assert [numbers[w] for w in spelled] == slots.tolist()
    slots, new = known.slots(words.find_words(pa.array([b"one one"])), np.array([7, 7], np.uint64), np.array([0, 1]))
    assert slots.tolist() == [numbers["one"], len(numbers)] and new.tolist() == [1]


@pytest.mark.parametrize("clash", [False, True])
def test_ids_of_constructed_words(clash, monkeypatch):
    """Both encoders against their libraries, also where every word has the same hash."""
    import sentencepiece
    from tokenizers import Tokenizer

    from mergeloom.llm import packing, piece_scan

    if clash:
        for module in (packing, piece_scan):
            monkeypatch.setattr(module, "hash_words", lambda w, folded=True: np.zeros(len(w.starts), np.uint64))
    texts = [w for pair in PAIRS for w in pair] + ["Plain words and plain Words", "  two  two"]
    file = public_tokenizers.path("word_bpe_49k.json")
    ids, at = packing.WordEncoder(file).encode(pa.array([t.encode() for t in texts], pa.binary()))
    plain = Tokenizer.from_file(file)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    file = public_tokenizers.path("piece_bpe_32k.model")
    pieces = piece_scan.pieces_of(file)
    pieces._forget()
    ids, at = pieces.encode([t.encode() for t in texts])
    pieces._forget()
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sentencepiece.SentencePieceProcessor(model_file=file).encode(texts)


def test_constructed_words_are_not_linked(spark):
    from mergeloom.llm.near_dedup import minhash_components

    rows = [(k, w) for k, w in enumerate(w for pair in PAIRS for w in pair)]
    got = minhash_components(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=3, percent=85).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got)


def test_constructed_words_are_counted_apart(spark):
    from mergeloom.llm.pseudo_likelihood import word_counts

    docs = spark.createDataFrame([(f"{one} {two} {two}",) for one, two in PAIRS], "text string")
    assert sorted(r.n for r in word_counts(docs, "text").collect()) == [1] * len(PAIRS) + [2] * len(PAIRS)
