import random

import pytest

runs = pytest.importorskip("mergeloom.llm.periodic_runs")


def brute_force(words, least_length, least_exponent):
    """All stretches that keep a period, without those that a smaller period covers."""
    n, found = len(words), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                found.append((i, j - i + p, p))
            i = max(j, i + 1)
    found = [(s, m, p) for s, m, p in found if m >= 2 * p and not any(q < p and t <= s and t + k >= s + m for t, k, q in found)]
    return sorted(r for r in found if r[1] >= least_length and r[1] >= least_exponent * r[2])


def random_words(rng):
    letters, n = rng.randint(1, 3), rng.randint(0, 40)
    words = [b"abc"[k : k + 1] for k in (rng.randrange(letters) for _ in range(n))]
    if n and rng.random() < 0.5:
        q = rng.randint(1, 6)
        words = [words[i % min(q, n)] for i in range(n)]
        words[rng.randrange(n)] = b"b"
    return words


def test_runs_against_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        words = random_words(rng)
        for least_length, least_exponent in ((6, 4), (1, 2), (1, 3)):
            assert runs.find_runs(words, least_length, least_exponent) == brute_force(words, least_length, least_exponent)


def test_next_smaller_suffixes():
    rng = random.Random(8)
    for _ in range(300):
        words = random_words(rng)
        for descending in (False, True):
            key = [[-w[0] if descending else w[0] for w in words[i:]] for i in range(len(words))]
            after, shared = runs.next_smaller_suffixes(words, descending)
            for i, k in enumerate(after):
                assert k == next((j for j in range(i + 1, len(words)) if key[j] < key[i]), len(words))
                assert words[i : i + shared[i]] == words[k : k + shared[i]] and (k == len(words) or words[i + shared[i] : i + shared[i] + 1] != words[k + shared[i] : k + shared[i] + 1])


class Counted:
    made = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.made += 1
        return self.value == other.value

    def __lt__(self, other):
        Counted.made += 1
        return self.value < other.value

    __gt__ = lambda self, other: other < self


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "make",
    [lambda n: [0] * n, lambda n: [0, 1] * (n // 2), fibonacci, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: ([0] * 99 + [1]) * (n // 100), lambda n: [int(int((8 * i + 1) ** 0.5) ** 2 == 8 * i + 1) for i in range(n)]],
)
def test_comparisons_grow_in_proportion(make):
    for n in (2000, 16000):
        Counted.made = 0
        runs.find_runs([Counted(x) for x in make(n)])
        assert Counted.made < 14 * n


def test_table_with_odd_rows(spark):
    rows = [(1, "a b " * 4, "x"), (1, "a b " * 4, "x"), (None, "w " * 9 + "end", "y"), (2, None, "z"), (3, " \t\n", "z"), (4, "été " * 7 + "fin\x0bfin", "z"), (5, "a\xa0a " * 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in runs.periodic_runs(docs).collect()}
    assert got == {
        (1, 8, ((0, 8, 2),), "a b"),
        (None, 10, ((0, 9, 1),), "w end"),
        (2, 0, (), ""),
        (3, 0, (), ""),
        (4, 9, ((0, 7, 1),), "été fin fin"),
        (5, 6, ((0, 6, 1),), "a\xa0a"),
    }
    assert runs.periodic_runs(docs.where("false")).collect() == []


def test_long_text(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(200_001))
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_001, 50_000)] and row.collapsed == " ".join(f"w{i}" for i in range(50_000))


def test_query_plants_periods(spark, tmp_path):
    """The query's rows against plain Python, ids and texts of all kinds."""
    import hashlib
    import zlib

    from mergeloom.llm.queries import op12_periodic_runs

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(None, "a a a a a a a"), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        found = brute_force(words, 6, 4)
        top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
        gone = {i for s, m, p in found for i in range(s + p, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((key, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(collapsed)))
    got = op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
