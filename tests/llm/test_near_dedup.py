import random

import pytest

from mergeloom.llm.components import connected_components
from mergeloom.llm.near_dedup import minhash_components


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, k = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    for _ in range(40):  # share a passage, similar but not linked
        rows.append((k, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 30))])))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t"), (k + 3, "ONE two"), (k + 4, "one TWO "), (k + 5, "É a b"), (k + 6, "é a b"), (k + 7, "x " * 40000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, size, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, n int, key string")
    got = minhash_components(docs, shingle_words=size, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, size, percent)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "z y x")], "doc_id bigint, text string")
    rows = minhash_components(docs).collect()
    assert sorted(str(r.component_id) for r in rows) == ["5", "5", "5", "None"] and sum(r.kept for r in rows) == 2
    assert minhash_components(docs.where("doc_id > 9")).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    links = spark.createDataFrame(chain + [(7, k) for k in range(300, 340)] + [(9, 9), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(300, 340)]}
