import math
import re

from mergeloom.llm.license_texts import TEMPLATES
from mergeloom.llm.licenses import PHRASES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.",
    "mit mit license LICENSE apache-license general public license mit license",
    None,
    "",
    " .. ",
    "Licensed under CC BY-NC 4.0. x",
    "permission is hereby granted, free of charge, to any person",
    "hereby granted free of charge",
    "lesser general public license under the terms of the gnu",
    "GNU Lesser General Public License; terms of the GNU Lesser General Public License",
    "Kelvin K mit licenſe Été license mit",
    "word " * 3000 + "licensed under the apache license version 2.0 " + "mit " * 500,
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, most=16, least=0.6):
    vocabulary = {w for t in TEMPLATES for w in t.text.split()}
    split = [words_of(t) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) + 1e-6 for w in vocabulary}
    for s in split:
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(s)) if s[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        for t in TEMPLATES:
            own, key = t.text.split(), t.key.split()
            k = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
            end = k + len(key) - 1
            posted = sorted(range(len(own)), key=lambda p: (-idf[own[p]], p))[:most]
            total = sum(idf[own[p]] for p in posted)
            for d in [i - k for i in range(len(s)) if s[i : i + len(key)] == key]:
                share = 0.0
                for p in posted:
                    off = 0 if k <= p <= end else 2 + max(k - p, p - end) // 8
                    share += idf[own[p]] / total * (own[p] in s[max(0, d + p - off) : max(0, d + p + off + 1)])
                if share >= least:
                    labels.add(t.label)
                    score = max(score, min(1.0, share))
        yield (
            len(s), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
            round(max(score, 0.5 * bool(starts)), 9),
        )


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "w", 3) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, words string, n_words int")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for k, want in enumerate(brute(TEXTS)):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == want, TEXTS[k]
    assert got[5].labels == "cc-by-nc" and got[9].labels == "gpl,lgpl"


def test_empty_table_and_null_ids(spark):
    assert license_scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(None, "mit license"), (None, "mit license")], "doc_id bigint, text string")
    assert [r.n_base for r in license_scan(docs).collect()] == [1, 1]


def test_texts_that_name_many_licenses(spark):
    every = " -- ".join(t.text for t in TEMPLATES)
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Licensed under CC BY-NC 4.0",
        every,
        "person charge copy binary forms domain international universal permission " * 3 + "released under the mit license",
        " ".join(reversed(every.split())),
    ] + ["licensed under cc by nc 4 0"] * 20  # makes its words less rare than those of the others
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for k, want in enumerate(brute(texts)):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == want, texts[k]
    assert got[0].labels == "cc-by-nc,mit"
    assert set(got[1].labels.split(",")) == {t.label for t in TEMPLATES}


def test_a_word_put_in_or_left_out(spark):
    texts, want = [], []
    for t in TEMPLATES:
        words = t.text.split()
        key = t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        for change in (0, 1):
            own = list(words)
            place = next((p for p in (len(own) - 2, 2) if not at <= p <= at + len(key)), None)
            if place is not None and len(own) > 12:
                own[place : place + change] = ["inserted"] * (1 - change)
            texts.append("Some words before. " + " ".join(own) + " and more behind.")
            want.append(t.label)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    for k, label in enumerate(want):
        assert label in got[k].labels.split(","), texts[k]
