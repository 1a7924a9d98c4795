import random
from collections import Counter

import numpy as np
import pytest

passages = pytest.importorskip("mergeloom.llm.repeated_passages")


def brute_force(texts, length=200):
    """Bytes, removed spans and kept bytes of each text, by counting all strings."""
    bodies = [(t or "").encode() for t in texts]
    known = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if known[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        starts = [i for i in range(len(b)) if gone[i] and not (i and gone[i - 1])]
        spans = tuple((i, gone.index(0, i) - i) for i in starts)
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    pool = [prose(rng.randint(20, 120)) for _ in range(12)]
    cut = lambda: rng.choice(pool)[rng.randint(0, 100) : rng.randint(150, 600)]
    kinds = [lambda: prose(rng.randint(1, 60)), lambda: rng.choice(pool), cut, lambda: "a" * rng.randint(0, 500), lambda: "ab " * rng.randint(0, 200), lambda: "\x00" * rng.randint(0, 300)]
    texts = ["".join(rng.choice(kinds)() for _ in range(rng.randint(0, 5))) for _ in range(120)]
    family = prose(250).split()
    for _ in range(50):
        changed = list(family)
        changed[rng.randrange(len(changed))] = word()
        texts.append(" ".join(changed))
    return texts + [None, "", texts[3], texts[3], "x" * 199, "y" * 200, "y" * 200, "z" * 201, "é" * 150]


@pytest.mark.parametrize("most_records", [10_000, 3])
def test_against_brute_force(spark, most_records):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, b"k", "row") for i, t in enumerate(texts)], "doc_id bigint, text string, text_key binary, row string")
    rows = passages.remove_repeated(docs, most_records=most_records).collect()
    got = {r.doc_id: (r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in rows}
    assert len(rows) == len(texts) and got == dict(enumerate(brute_force(texts)))


def test_parts_of_a_long_text(spark, monkeypatch):
    """Triggers are the same however a text is cut for hashing."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 50_000, dtype=np.uint8)
    data[20_000:30_000] = 97
    offsets = np.array([0, 10_000, 10_150, 40_000, 50_000])
    whole = passages.parse(data, offsets, 200)
    monkeypatch.setattr(passages, "PLACES", 777)
    assert all((a == b).all() for a, b in zip(whole, passages.parse(data, offsets, 200), strict=True))
    first, last, trigger, counts = whole
    assert counts.tolist()[1] == 0 and counts.sum() == len(first)
    assert ((trigger - first < passages.TRIGGER_WINDOW) & (trigger >= last)).all()
    assert (last - first + 1).sum() == sum(max(0, n - 199) for n in np.diff(offsets))


def test_orders_against_plain_sorting():
    rng = np.random.default_rng(2)
    rows, heads = rng.integers(0, 3, (300, 11), dtype=np.uint8), rng.integers(0, 4, 300)
    order, shared = passages.suffix_order(rows, heads)
    assert order.tolist() == sorted(range(300), key=lambda k: (heads[k], rows[k].tobytes(), k))
    for size in (0, 2, 11):
        number = passages.classes(order, shared, size)
        for a in range(0, 300, 7):
            assert [number[a] == number[b] for b in range(300)] == [heads[a] == heads[b] and (rows[a, :size] == rows[b, :size]).all() for b in range(300)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert passages.remove_repeated(empty).collect() == []
    rows = [(None, "n" * 300), (None, None), (1, "short"), (1, "short")]
    got = passages.remove_repeated(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == [("1", 5, 0, b"short"), ("1", 5, 0, b"short"), ("None", 0, 0, b""), ("None", 300, 1, b"")]
    with pytest.raises(ValueError):
        passages.remove_repeated(empty, length=100)


def test_no_scratch_is_left_but_what_the_result_reads(spark, tmp_path):
    from mergeloom.llm.common import Scratch

    docs = spark.createDataFrame(list(enumerate(corpus(6))), "doc_id bigint, text string")
    scratch = Scratch(spark, "passages-test")
    passages.remove_repeated(docs, scratch=scratch).count()
    assert set(scratch.paths) <= {"copies", "marks-by-text"}
