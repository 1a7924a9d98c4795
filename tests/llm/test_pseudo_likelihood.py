import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.llm import pseudo_likelihood as pl
from mergeloom.llm.words import find_words, hash_words

PATTERNS = ["the cat sat on the mat", "a dog ran in the park", "the bird sang on a branch"]


def words_of(text):
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode().lower())


def hash_of(word):
    return int(hash_words(find_words(pa.array([word])))[0])


def codes_of(word):
    return [int(pl.byte_codes()[b]) for b in word]


def ending_of(word):
    last = [0, *codes_of(word)][-2:]
    return last[0] * pl.CODES + last[1]


def class_of(classes, word):
    return int(classes.of(np.array([hash_of(word)], np.uint64), np.array([ending_of(word)]))[0])


def spelling(letters, word):
    """Log-probability of a word given its ending, letter by letter from the back."""
    c = codes_of(word)
    total = -sum(math.log(pl.SHARED_BY[x]) for x in c)
    for k in range(len(c) - 3, -2, -1) if len(c) > 1 else []:
        after = [c[j] if j < len(c) else 0 for j in (k + 1, k + 2, k + 3)]
        total += float(letters[(after[0] * pl.CODES + after[1]) * pl.CODES + after[2], c[k] if k >= 0 else 0])
    return total


def class_log(n, window, own):
    h = np.tanh(sum(n.places[k][c].astype(float) for k, c in enumerate(window)) + n.bias)
    logs = lambda x: x - np.log(np.exp(x).sum())
    b = n.branch[own]
    return logs(h @ n.branch_out + n.branch_bias)[b] + logs(h @ n.leaf_out[b] + n.leaf_bias[b])[n.leaf[own]]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(PATTERNS) for _ in range(rng.randint(2, 8))) + f" name{k}. Été{k % 7}" for k in range(300)]
    texts += ["twice over zebra quagga", "twice over zebra quagga", "", None]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id bigint, text string, mean int")
    return docs, texts, pl.learn_model(docs, own_words=12, width=16, epochs=4)


def test_scores_against_brute_force(spark, trained):
    docs, texts, (model, counts) = trained
    odd = ["The CAT sat", "", None, " . ", "unseen words 中文 x", "the name3 " * 20000]
    corpus = Counter(w for t in texts for w in words_of(t))
    assert {r.hash: r.n for r in counts.collect()} == {int(np.uint64(hash_of(w)).view(np.int64)): n for w, n in corpus.items()}
    rare = {w: n for w, n in corpus.items() if class_of(model.classes, w) > len(model.classes.hashes)}
    assert len(corpus) - len(rare) == 12

    def want(text, own):
        words, total, known, several = words_of(text), 0.0, 0, 0
        classes = [0, 0, *[class_of(model.classes, w) for w in words], 0, 0] if len(words) < 1000 else None
        if classes is None:
            pair = [class_of(model.classes, w) for w in words[:2]]
            classes = [0, 0, *pair * (len(words) // 2), 0, 0]
        cache = {}
        for k in range(len(words)):
            key = tuple(classes[k : k + 5])
            if key not in cache:
                cache[key] = class_log(model.network, (key[0], key[1], key[3], key[4]), key[2])
            total += cache[key]
        for w, n in Counter(words).items():
            if w in rare or w not in corpus:
                same = [v for v in rare if ending_of(v) == ending_of(w)]
                taken = n if own else 0
                others = max(0, rare.get(w, 0) - taken)
                prior = len(same) + 1
                total += n * math.log((others + prior * math.exp(spelling(model.letters, w))) / (max(0, sum(rare[v] for v in same) - taken) + prior))
                known, several = known + n * (others > 0), several + n
        return len(words), total, known / several if several else None

    for own, rows in ((True, list(enumerate(texts))[:8] + [(300, texts[300]), (302, ""), (303, None)]), (False, list(enumerate(odd)))):
        asked = docs if own else spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: r for r in pl.score_documents(asked, model, counts, own_left_out=own).collect()}
        for k, t in rows:
            n, total, known = want(t, own)
            assert got[k].n_tokens == n and abs(got[k].log_likelihood - total) < 1e-4 * (1 + abs(total)), (k, t)
            assert got[k].known == known and (got[k].mean is None) == (not n)


def test_text_that_occurs_twice_is_scored_apart(trained):
    docs, texts, (model, counts) = trained
    got = {r.doc_id: r for r in pl.score_documents(docs, model, counts).collect()}
    assert got[300].known == got[301].known == 1.0 and got[0].known < 1


def test_prefers_text_in_order(spark, trained):
    _, _, (model, counts) = trained
    rng = random.Random(9)
    rows = []
    for k in range(60):
        words = " ".join(rng.choice(PATTERNS) for _ in range(6)).split()
        rows.append((2 * k, " ".join(words)))
        rng.shuffle(words)
        rows.append((2 * k + 1, " ".join(words)))
    got = {r.doc_id: r.mean for r in pl.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), model, counts).collect()}
    assert sum(got[2 * k] > got[2 * k + 1] for k in range(60)) >= 59


def test_probabilities_add_up(trained):
    model = trained[2][0]
    assert np.allclose(np.exp(model.letters).sum(axis=1), 1, atol=1e-4)
    every = np.arange(1, model.classes.number)
    window = np.tile(np.array([[1], [2], [3], [0]]), (1, len(every)))
    assert abs(np.exp(pl.class_logs(model.network, window, every)).sum() - 1) < 1e-3


def test_better_than_unigrams_and_trigrams_on_held_out_documents():
    pq = pytest.importorskip("pyarrow.parquet")
    texts = [t.encode() for t in dict.fromkeys(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()) if t]
    seen, held = (pl.spelled(pa.array(texts[k::2])) for k in (0, 1))
    words, n = np.unique(hash_words(seen.words), return_counts=True)
    top = np.sort(words[np.argsort(-n)][:4096])
    classes = pl.Classes(top, 1 + np.arange(len(top)))
    own, asked = (classes.of(hash_words(s.words), s.endings) for s in (seen, held))
    counts = np.bincount(own, minlength=classes.number).astype(float)
    cuts = np.r_[0, np.cumsum(seen.words.counts)]
    network = pl.train_network([own[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], counts)
    mean = pl.class_logs(network, pl.windows(asked, held.words.counts), asked).mean()

    size = classes.number
    unigram = (counts + 0.5) / (counts + 0.5).sum()
    keys = lambda w, o: ((w[1] * size + w[2]) * size + o, w[1] * size + w[2], w[1] * size + o, w[1])
    tables = [Counter(k.tolist()) for k in keys(pl.windows(own, seen.words.counts), own)]
    triple, pair, left, one = (np.array([t[k] for k in ks.tolist()]) for t, ks in zip(tables, keys(pl.windows(asked, held.words.counts), asked), strict=True))
    bigram = (left + 20 * unigram[asked]) / (one + 20)
    trigram = (triple + 5 * bigram) / (pair + 5)
    assert mean > np.log(trigram).mean() + 0.1 and mean > np.log(unigram[asked]).mean() + 0.5


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " . ")], "doc_id bigint, text string")
    model, counts = pl.learn_model(docs, own_words=3)
    assert [(r.n_tokens, r.log_likelihood, r.mean, r.known) for r in pl.score_documents(docs, model, counts).collect()] == [(0, 0.0, None, None)] * 3
    some = spark.createDataFrame([(1, "a bc def")], "doc_id bigint, text string")
    assert pl.score_documents(some, model, counts).first().log_likelihood < 0
    assert pl.score_documents(docs.where("doc_id > 7"), model, counts).count() == 0
    empty, none = pl.learn_model(docs.where("doc_id > 7"))
    assert none.count() == 0 and pl.score_documents(some, empty, none).first().n_tokens == 3


def test_network_is_trained_on_every_word(spark, trained):
    """With no sample to begin from; the tasks' changes averaged by the words that each had."""
    from pyspark.sql import functions as F

    docs, texts, (model, _) = trained
    docs = docs.select("doc_id", F.when(F.col("doc_id") == 7, F.repeat(F.lit("cat sat "), 15_000)).otherwise(F.col("text")).alias("text"))
    classes, number = model.classes, model.classes.number
    counts = np.ones(number)
    start = pl.begun([], counts, width=8)
    first = [x.copy() for x in start.weights.tables()]
    network = pl.train_on_all(docs, "text", classes, start, 1.0, batch=64, block_rows=100)
    sums, seen = [np.zeros(x.shape) for x in first], [np.zeros(len(x)) for x in first]
    for part, rows in enumerate(docs.select("text").rdd.glom().collect()):
        spelled = pl.spelled(pa.array([(r.text or "").encode() for r in rows], pa.binary()))
        one = pl.Learner(pl.begun([], counts, width=8).network)
        one.read(classes.of(hash_words(spelled.words), spelled.endings), spelled.words.counts, 64, np.random.default_rng(part))
        for k, (old, new, n) in enumerate(zip(first, one.weights.tables(), one.seen, strict=True)):
            sums[k] += (new - old) * n[:, None]
            seen[k] += n
    words = sum(len(words_of(t)) for k, t in enumerate(texts) if k != 7) + 30_000
    assert seen[1][0] == seen[2][0] == sum(n[0] for n in seen[3:]) == words and seen[0].sum() == 4 * words
    for got, old, total, n in zip(pl.Learner(network).weights.tables(), first, sums, seen, strict=True):
        assert np.allclose(got, old + total / np.maximum(n, 1)[:, None], atol=1e-4)


def test_model_without_a_sample_has_learned_of_every_frequent_word(trained):
    model, counts = pl.learn_model(trained[0], own_words=12, width=16, sample_tokens=0)
    class_counts = np.r_[0.0, sorted((r.n for r in counts.collect()), reverse=True)[:12], model.tokens]
    begin = pl.new_network(class_counts, 16, np.random.default_rng(7))
    changed = (model.network.places != begin.places).any(axis=2)
    assert changed[:, 1:13].all() and changed[:, 13:][:, np.array(model.tokens) > 0].any(axis=0).all()
    assert not changed[:, 13:][:, np.array(model.tokens) == 0].any()


def test_learning_reads_the_corpus_three_times_and_counts_letters_while_training(spark, trained):
    """Once for words, once for the sample and once for network and letters."""
    docs, texts, (model, _) = trained
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pl.learn_model(docs.mapInArrow(seen, docs.schema), own_words=12, width=8, sample_tokens=0)
    assert read.value == 3 * len(texts)
    start = pl.begun([], np.ones(model.classes.number), width=8)
    got = pl.read_all(docs, "text", model.classes, start, 1.0, batch=64)[1]
    want = Counter()
    for rows in docs.select("text").rdd.glom().collect():  # a partition is one slice here
        for w in {w for r in rows for w in words_of(r.text) if class_of(model.classes, w) > len(model.classes.hashes)}:
            c = codes_of(w)
            for k in range(len(c) - 3, -2, -1) if len(c) > 1 else []:
                after = [c[j] if j < len(c) else 0 for j in (k + 1, k + 2, k + 3)]
                want[((after[0] * pl.CODES + after[1]) * pl.CODES + after[2]) * pl.CODES + (c[k] if k >= 0 else 0)] += 1
    assert len(got) == pl.CODES**4 and {k: int(got[k]) for k in np.flatnonzero(got).tolist()} == want
    assert np.array_equal(pl.letter_model(got), model.letters)


@pytest.mark.parametrize("scale", [1, 200])
def test_steps_against_plain_adagrad(scale):
    """scale 200: exponentials would be out of range without the largest logit taken off."""
    rng = np.random.default_rng(3)
    number, width, rate = 60, 6, 0.08
    network = pl.new_network(np.r_[0.0, 1000 / np.arange(1, number)], width, rng)
    network.branch_out[:] *= scale
    learner = pl.Learner(network, rate)
    learner.ROWS = 32  # several blocks, and branches of more rows than one
    places, bias, outs = network.places.astype(float), network.bias.astype(float), {-1: np.r_[network.branch_out, network.branch_bias[None]].astype(float)}
    outs |= {b: np.r_[network.leaf_out[b][:, :k], network.leaf_bias[b][None, :k]].astype(float) for b, k in enumerate(pl.leaf_counts(network).tolist())}
    grown = {k: np.full(x.shape, 0.1) for k, x in outs.items()} | {"bias": np.full(width, 0.1), "places": np.full(places.shape[:2], 0.1)}
    for _ in range(4):
        window, own = rng.integers(0, number, (4, 150)), np.minimum(1 + rng.geometric(0.1, 150), number - 1)
        learner.step(window.astype(np.uint16), own)
        steps = {k: np.zeros_like(x) for k, x in outs.items()} | {"bias": np.zeros(width), "places": np.zeros_like(places)}
        for w, c in zip(window.T.tolist(), own.tolist(), strict=True):
            h = np.r_[np.tanh(sum(places[k, x] for k, x in enumerate(w)) + bias), 1]
            back, b = np.zeros(width), int(network.branch[c])
            for which, wanted in ((-1, b), (b, int(network.leaf[c]))):
                logits = h @ outs[which]
                error = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
                error[wanted] -= 1
                back += outs[which][:-1] @ error
                steps[which] += np.outer(h, error)
            back *= 1 - h[:-1] ** 2
            steps["bias"] += back
            for k, x in enumerate(w):
                steps["places"][k, x] += back
        for k, x in outs.items():
            grown[k] += steps[k] ** 2
            x -= rate * steps[k] / np.sqrt(grown[k])
        grown["bias"] += steps["bias"] ** 2
        bias -= rate * steps["bias"] / np.sqrt(grown["bias"])
        grown["places"] += (steps["places"] ** 2).mean(axis=2)
        places -= rate * steps["places"] / np.sqrt(grown["places"])[:, :, None]
    got = learner.network
    assert np.allclose(got.places, places, atol=1e-3) and np.allclose(got.bias, bias, atol=1e-3)
    assert np.allclose(got.branch_out, outs[-1][:-1], atol=1e-3) and np.allclose(got.branch_bias, outs[-1][-1], atol=1e-3)
    for b, k in enumerate(pl.leaf_counts(network).tolist()):
        assert np.allclose(got.leaf_out[b][:, :k], outs[b][:-1], atol=1e-3) and np.allclose(got.leaf_bias[b][:k], outs[b][-1], atol=1e-3)


def test_sums_of_rows_by_number_and_classes_of_hashes_that_begin_alike():
    rng = np.random.default_rng(5)
    for numbers in (np.minimum(rng.geometric(0.02, 3000), 400).astype(np.uint16), np.zeros(100, np.int64), np.zeros(0, np.uint16)):
        values = rng.normal(size=(len(numbers), 3)).astype(np.float32)
        for many in (2, 5, 64):
            rows, sizes, sums = pl.row_sums(values, numbers, many)
            assert sorted(rows.tolist()) == np.unique(numbers).tolist()
            for r, n, x in zip(rows, sizes, sums, strict=True):
                assert n == (numbers == r).sum() and np.allclose(x, values[numbers == r].sum(axis=0), atol=1e-4)
    first = rng.integers(0, 1 << pl.SLOT_BITS, 50, dtype=np.uint64) << pl.SHIFT
    hashes = np.unique(np.r_[first, first + np.uint64(1), first[:20] + np.uint64(9), rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.uint64(2**64 - 1)])
    known, number = hashes[::2], rng.permutation(len(hashes[::2])) + 1
    want = dict(zip(known.tolist(), number.tolist(), strict=True))
    asked = rng.permutation(np.r_[hashes, hashes])
    assert pl.Classes(known, number).of(asked, np.full(len(asked), 7)).tolist() == [want.get(h, 1 + len(known) + 7) for h in asked.tolist()]
    order, begins = pl.grouped(asked)
    assert np.array_equal(asked[order[begins]], hashes) and (np.diff(np.r_[begins, len(order)]) == 2).all()
    assert len(pl.grouped(asked[:0])[1]) == 0
