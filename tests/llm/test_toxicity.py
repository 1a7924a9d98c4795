import random

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.llm.toxicity import CODES, Decoder, character_model, count_quadruples, learn_toxicity, restore_texts, score_toxicity

PLAIN = [a + b + c for a in ("gar", "win", "mor", "let", "num", "sil") for b in ("den", "dow", "ning", "ter", "ber", "ver") for c in ("", "s", "ing", "ed", "er", "ly")]
PLAIN += "garden window river stone".split()


def corpus(n):
    rng = random.Random(3)
    for k in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(8, 40))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["rotten", "vile"]))
        yield k, " ".join(words), int(k % 4 == 0)


@pytest.fixture(scope="module")
def learned(spark):
    rows = list(corpus(400))
    docs = spark.createDataFrame([(k, t, "s") for k, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7000, 1), (3, None)], "doc_id bigint, toxic int")
    return learn_toxicity(docs, labels)


def test_learns_the_words_and_finds_them_disguised(spark, learned):
    assert set(learned.weights) == {"rotten", "vile"}
    texts = ["river r0tt3n stone", "v i l e window", "vvviiile", "v.i.l.e", "VILE!", "garden 1234 st0ne a b c", "", None, "stone " * 30000 + "r0tten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in score_toxicity(docs, learned).collect()}
    assert [got[k].predicted for k in range(len(texts))] == [1, 1, 1, 1, 1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())
    restored = {r.doc_id: r.restored for r in restore_texts(docs, learned.characters).collect()}
    assert restored[0] == "river rotten stone" and restored[1] == "vile window" and restored[6] == "" and restored[7] is None


def test_viterbi_finds_the_best_of_all_readings(learned):
    import itertools

    decoder = Decoder(learned.characters)

    def score(reading):
        total, state = 0.0, (0, 0, 0)
        for letter, cost in reading:
            total += cost
            if letter:
                code = 0 if letter == " " else ord(letter) - 96
                total += learned.characters[state][code] if state[2] or code else 0.0
                state = (state[1], state[2], code) if code else (0, 0, 0)
        return total + (learned.characters[state][0] if state[2] else 0.0)

    for token in ["r0tt3n", "v1le", "st0n3", "ggg4rden", "s.1.l"]:
        best = max(itertools.product(*decoder._readings(token)), key=score)
        assert decoder.decode(token) == "".join(x for x, _ in best)


def test_counts_over_texts():
    got = count_quadruples(pa.array([b"ab", None, b"", b"AB"], pa.binary())).reshape((CODES,) * 4)
    assert got[0, 0, 0, 1] == got[0, 0, 1, 2] == got[0, 1, 2, 0] == 2 and got.sum() == 6


def test_nothing_labelled_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    model = learn_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert score_toxicity(docs, model).first().score == 0
    assert score_toxicity(docs.where("doc_id > 1"), model).count() == 0
    assert np.allclose(np.exp(character_model(docs, "text")).sum(axis=-1), 1, atol=1e-3)


def test_scores_against_plain_python(spark, learned):
    """Every text as a whole, token by token, with a Viterbi of its own for the readings."""
    import math

    from mergeloom.llm.toxicity import DISGUISED, LETTERS

    decoder = Decoder(learned.characters)

    def reading(token):
        """The best path over (last three letters), written out without shortcuts."""
        best = {(0, 0, 0): (0.0, "")}
        for options in decoder._readings(token):
            after = {}
            for state, (score, read) in best.items():
                for letter, cost in options:
                    code = None if not letter else 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27
                    total = score + cost + (float(learned.characters[state][code]) if code is not None and (state[2] or code) else 0.0)
                    to = state if code is None else (state[1], state[2], code) if code else (0, 0, 0)
                    if to not in after or total > after[to][0]:
                        after[to] = (total, read + letter)
            best = after
        return max(best.items(), key=lambda x: x[1][0] + (float(learned.characters[x[0]][0]) if x[0][2] else 0.0))[1][1]

    def score(text):
        lower = (text or "").lower()
        words = set(LETTERS.findall(lower))
        for match in DISGUISED.finditer(lower):
            words.update(LETTERS.findall(reading(match.group(0))))
        logit = learned.intercept + sum(learned.weights[w] for w in words & learned.weights.keys())
        return 1 / (1 + math.exp(-logit))

    rng = random.Random(8)
    disguises = ["r0tt3n", "v1le", "v.i.l.e", "viiiile", "v i l e", "R0TT3N", "vi1e", "stone", "123", "r-o-t-t-e-n", "ro77en"]
    texts = [" ".join(rng.choice(PLAIN + disguises) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", "vvvv" + "iiii" * 40 + "llle", "r0tt3n" * 30, "ab1cd2" * 200, "x1" * 700 + "vile", "1l" * 60 + " v1le"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in score_toxicity(docs, learned).collect():
        assert abs(r.score - score(texts[r.doc_id])) < 1e-9, texts[r.doc_id]
    token = "".join(rng.choice("r0tt3nv1l3") for _ in range(300))
    assert decoder._decode(token) == reading(token)
