import random

import pytest

from mergeloom.operators import training as T


def plain_merges(words, target):
    """One merge at a time on lists of ids."""
    bag = {w: list(w.encode()) for w in words}
    merges = []
    while 256 + len(merges) < target:
        counts = {}
        for w, n in words.items():
            s = bag[w]
            for pair in zip(s, s[1:]):
                if 0 not in pair:
                    counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        if counts[a, b] < 2:
            break
        new = 256 + len(merges)
        merges.append((a, b, new, counts[a, b]))
        for w, s in bag.items():
            out, k = [], 0
            while k < len(s):
                if s[k : k + 2] == [a, b]:
                    out.append(new)
                    k += 2
                else:
                    out.append(s[k])
                    k += 1
            bag[w] = out
    return merges


def bag_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq bigint")


@pytest.mark.parametrize("index_from", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_single_merges(spark, seed, index_from):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(60)}
    got = T.train_merges(bag_of(spark, words), 256 + 25, board_size=12, index_from=index_from)
    assert [tuple(m) for m in got] == plain_merges(words, 256 + 25)


VECTORS = [
    ({"aaaa": 2}, "greedy", [(97, 97, 256, 6), (256, 256, 257, 2)]),
    ({"aaaa": 2}, "collapse", [(97, 97, 256, 6)]),
    ({"ab": 1}, "greedy", []),
    ({"ab": 2, "ba": 2}, "greedy", [(97, 98, 256, 2), (98, 97, 257, 2)]),
    ({"\0a": 5}, "greedy", []),
]


@pytest.mark.parametrize(("words", "mode", "want"), VECTORS)
def test_vectors(spark, words, mode, want):
    assert [tuple(m) for m in T.train_merges(bag_of(spark, words), 300, self_pair=mode)] == want


def test_limits(spark):
    assert T.train_merges(bag_of(spark, {"abab": 9}), 256) == []
    with pytest.raises(ValueError, match="empty"):
        T.train_merges(bag_of(spark, {"a": 1}).where("freq > 1"), 300)
    with pytest.raises(ValueError, match="at most"):
        T.train_merges(bag_of(spark, {"a": 1}), 70_000)


def test_order_of_texts_does_not_matter(spark):
    texts = ["the cat sat", "on the mat", "the end"] * 3
    one = spark.createDataFrame([(t,) for t in texts], "text string")
    two = spark.createDataFrame([(t,) for t in reversed(texts)], "text string").repartition(3)
    train = lambda d: T.train_merges(T.word_bag(d), 270)
    assert train(one) == train(two)


def test_progress(spark):
    bag = bag_of(spark, {"abab": 3})
    merges = T.train_merges(bag, 258)
    rows = T.progress(T.symbol_bag(bag), merges).collect()
    assert [(r.merge_string, r.best_count, r.symbol_count) for r in rows] == [("ab", 6, 6), ("abab", 3, 3)]


def test_rounds_read_less_and_less(spark):
    """Words are read by the pairs they hold: rare pairs need few of them."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(40)]
    words = {"".join(rng.choice(stems) for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(800)}
    rounds = []
    got = T.train_merges(bag_of(spark, words), 256 + 60, board_size=300, renew_after=40, rounds=rounds)
    assert [tuple(m) for m in got] == plain_merges(words, 256 + 60)
    assert all(r.words <= len(words) * r.merges for r in rounds) and rounds[-1].words < len(words) / 3
