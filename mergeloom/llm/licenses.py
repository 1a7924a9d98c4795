"""Licence scan with a positional index of rare licence words, in DataFrame functions only.

Templates are notices and passages of licences, each with a key phrase that must stand
whole. Inverse document frequencies over the whole corpus tell which words of a template are
rare: some of them are its postings, words with their places in it, and the rarest word of
its key phrase is looked up wherever it stands in a text, each hit proposing the template
at a relative position. No alignment with a whole key phrase can be missed, however many
licences a text names. A proposal stands when the key phrase is there and enough of the
template's postings agree with its position, weighted by rarity; a posting may be off by
some places, the more the further it is from the key phrase, so that a word put in or left
out does not lose the rest.
All of this happens inside a row, so no text is shuffled and no key can be hot.

Defined results for odd input
-----------------------------
* A null text counts as empty: no words, no labels, score 0, first_word and last_word null.
* Null ids, repeated rows and ties are kept as they are: one result row for each row.
* Texts of any length are read whole; an empty table gives an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.license_texts import TEMPLATES, Template

#: What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Room for a template's number beside a position in one 64-bit value.
SPAN = 1 << 40


def word_array(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other, in order."""
    parts = phrase.split()
    last = len(parts) - 1
    found = F.filter(F.transform(words, lambda w, i: F.when(w == parts[last], i - last)), lambda i: i >= 0)
    return F.filter(found, lambda i: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(parts[:last])]), lambda p: F.get(words, i + p["k"]) == p["w"]))


def license_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def postings_of(template: Template, idf: dict[str, float], most: int) -> list[tuple[str, int, float, int]]:
    """The template's rarest words: word, place, share of their weight, and how many places it may be off."""
    own, key = template.text.split(), key_place(template)
    chosen = sorted(sorted(range(len(own)), key=lambda p: -idf[own[p]])[:most])
    total = sum(idf[own[p]] for p in chosen)
    after = key + len(template.key.split()) - 1
    return [(own[p], p, idf[own[p]] / total, 0 if key <= p <= after else 2 + max(key - p, p - after) // 8) for p in chosen]


def key_place(template: Template) -> int:
    """Where the key phrase begins in the template."""
    own, key = template.text.split(), template.key.split()
    return next(p for p in range(len(own)) if own[p : p + len(key)] == key)


def inverse_document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log(rows / rows with the word) over all rows; the result is as small as the vocabulary."""
    counts = (
        words.select(F.explode(F.array_append(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))), F.lit(""))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    n = {r.word: r.n for r in counts}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    templates: tuple[Template, ...] = TEMPLATES,
    postings: int = 16,
    least_share: float = 0.6,
) -> DataFrame:
    """One row for each row of docs.

    Columns: id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans, an array of (label, start, score) for the alignments that stand.
    postings: how many of a template's words, the rarest, are held against a text.
    least_share: share of their weight (inverse document frequencies) that must lie about
    its place. score is the best such share, and 0.5 at least where a base phrase stands.
    """
    words = docs.select(F.col(id_col).alias("id"), word_array(F.col(text_col)).alias("words"))
    vocabulary = license_words(templates)
    idf = inverse_document_frequency(words, vocabulary)

    # small literals: places of key words by word; postings and key phrase by template
    looked_up: dict[str, list[int]] = {}
    bodies, keys = [], []
    for t, m in enumerate(templates):
        bodies.append(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(float(x)).alias("x"), F.lit(off).alias("off")) for w, p, x, off in postings_of(m, idf, postings)]))
        key, at = m.key.split(), key_place(m)
        keys.append(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(at + p).alias("p")) for p, w in enumerate(key)]))
        rare = max(range(len(key)), key=lambda p: idf[key[p]])
        looked_up.setdefault(key[rare], []).append(t * SPAN - at - rare)
    index = F.create_map(*[x for w, found in looked_up.items() for x in (F.lit(w), F.array(*[F.lit(s).cast("bigint") for s in found]))])
    bodies, key_words, names = F.array(*bodies), F.array(*keys), F.array(*[F.lit(m.label) for m in templates])

    phrase_places = {p: places(F.col("words"), p) for p in PHRASES}
    step = words.select(
        "id", "words", F.size("words").cast("bigint").alias("n_words"), *[c.alias(f"at_{k}") for k, c in enumerate(phrase_places.values())]
    )
    # a hit of word w at place i proposes t * SPAN + i - p for each posting (t, p)
    found = F.transform("words", lambda w, i: F.when(w.isin(list(looked_up)), F.transform(index[w], lambda s: s + i)))
    proposals = F.flatten(F.filter(found, lambda hit: hit.isNotNull()))
    template = lambda c: F.floor((c + (SPAN >> 1)) / F.lit(SPAN)).cast("int")
    start = lambda c: (c - template(c) * F.lit(SPAN)).cast("int")
    word_at = lambda i: F.when(i >= 0, F.get("words", i))
    first = lambda c, k: F.greatest(start(c) + k["p"] - k["off"], F.lit(0))
    around = lambda c, k: F.slice("words", first(c, k) + 1, F.greatest(start(c) + k["p"] + k["off"] + 1 - first(c, k), F.lit(0)))
    step = step.withColumn("proposals", proposals)
    spans = F.filter(
        F.transform(
            F.filter("proposals", lambda c: F.forall(key_words[template(c)], lambda k: F.coalesce(word_at(start(c) + k["p"]) == k["w"], F.lit(False)))),
            lambda c: F.struct(
                names[template(c)].alias("label"),
                start(c).alias("start"),
                F.least(F.lit(1.0), F.aggregate(bodies[template(c)], F.lit(0.0), lambda sum_, k: sum_ + F.when(F.array_contains(around(c, k), k["w"]), k["x"]).otherwise(0.0))).alias("score"),
            ),
        ),
        lambda s: s["score"] >= least_share,
    )
    starts = F.concat(*[F.col(f"at_{k}") for k in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    step = step.select(
        "id",
        "n_words",
        starts.alias("starts"),
        base.alias("base"),
        F.coalesce(spans, F.array().cast("array<struct<label:string,start:int,score:double>>")).alias("spans"),
    )
    return step.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        _joined(F.col("base")).alias("base_labels"),
        _joined(F.concat("base", F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), F.when(F.size("starts") > 0, 0.5).otherwise(0.0)).alias("score"),
        "spans",
    )
