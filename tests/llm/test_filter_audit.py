import itertools

import pytest

audit = pytest.importorskip("mergeloom.llm.filter_audit")

WORDS = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, WORDS, "a"),
    (2, WORDS, "a"),
    (3, WORDS, None),
    (4, "short", "a"),
    (5, None, ""),
    (6, "", "a"),
    (7, "same " * 80, "b"),
    (8, "SHOUTING " + WORDS.upper(), "b"),
    (9, WORDS + " 100 % $", "b"),
    (None, WORDS, "b"),
    (2, WORDS, "a"),
    (10, "Same $ " * 3, "b"),
]
MARKS = [(1, True, False), (4, False, True), (4, True, False), (9, None, True), (None, True, True), (2, True, None)]


def brute_force():
    good = {i for i, g, _ in MARKS if g and i is not None}
    toxic = {i for i, _, t in MARKS if t and i is not None}
    docs = []
    for key, text, part in ROWS:
        text = text or ""
        words = text.split()
        copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in ROWS)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), copy]
        docs.append((part or "", {f for f, bad in zip("ABCDE", fails, strict=True) if bad}, key in good, key in toxic))
    rows = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by, mine = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [d for d in own if f in d[1] and not d[1] & before]
                removed_by[f] += len(removed)
                kept = sum(not d[1] & (before | {f}) for d in own)
                redundant = sum(f in d[1] and bool(d[1] & before) for d in own)
                mine.append((part, "".join(order), k + 1, kept, len(removed), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed), f))
        rows += [(*r[:-1], removed_by[r[-1]]) for r in mine]
    return sorted(rows)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in ROWS], "doc_id bigint, text string, source string, fails int, part string, good boolean")
    marks = spark.createDataFrame(MARKS, "doc_id bigint, good boolean, toxic boolean")
    got = audit.filter_audit(docs, marks, ["good", "toxic"])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == 3 * 600 and rows == brute_force()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    marks = spark.createDataFrame([], "doc_id bigint, good boolean, toxic boolean")
    assert audit.filter_audit(docs, marks, ["good", "toxic"]).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], docs.schema)
    assert audit.filter_audit(one, marks, ["good", "toxic"]).where("good_lost + toxic_lost > 0").count() == 0


def test_lattice_has_eighty_edges(spark):
    patterns = spark.createDataFrame([("s", 3, 5, True)], "part string, fails int, n bigint, good boolean")
    edges = audit.lattice_edges(patterns, 5, ["good"])
    assert edges.count() == 80 and audit.order_steps(spark, "ABCDE").count() == 600
    assert edges.where("removed > 0").count() == 2 * 8  # filter 0 or 1 before the other, any of three further ones before
