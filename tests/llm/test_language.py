import random

from mergeloom.llm.language import LanguageModel, identify_language, labelled_rows, learn_languages

STEMS = {"xa": "kora mita selu vano peri duma".split(), "yb": "strong birth cloud thing wrench graft".split()}


def prose(lang, words, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang])[:2] for _ in range(words)).capitalize() + "."


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [(k, prose(lang, 5 + k % 60, k), lang, "x") for k, lang in enumerate(["xa", "yb"] * 100)]
    rows += [(1000, None, "xa", "x"), (1001, "12 34 !", "xa", "x"), (1002, "", None, "x"), (1003, prose("yb", 20000, 1), None, "x"), (None, prose("xa", 30, 2), "xa", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    from pyspark.sql import functions as F

    model = learn_languages(labelled_rows(docs, F.col("doc_id") % 4 != 2), sample_rows=20)
    assert set(model.languages) == {"xa", "yb"}
    got = [r for r in identify_language(docs, model).collect()]
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    held_out = [k for k in range(200) if k % 4 == 2]
    assert sum(by_id[k].lang_pred == rows[k][2] for k in held_out) >= 0.98 * len(held_out)
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yb"]
    assert by_id[1000].rejected and by_id[1000].score == 0 and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    model = learn_languages(labelled_rows(docs, docs.doc_id > 0))
    assert model == LanguageModel([], [])
    assert identify_language(docs, model).first().lang_pred == "und"
    assert identify_language(docs.where("doc_id > 1"), model).count() == 0


def test_against_sizes_by_brute_force(spark):
    import regex
    import zstandard

    rows = [(k, prose(lang, 3 + k % 40, k), lang) for k, lang in enumerate(["xa", "yb"] * 60)]
    rows += [(500, prose("xa", 9000, 7), "long"), (501, prose("xa", 40, 8) + " " + prose("yb", 40, 9), None), (502, "Kora 7 MITA", None), (503, "éß ıİ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn_languages(labelled_rows(docs, docs.doc_id >= 0))
    assert set(model.languages) == {"xa", "yb", "long"} and model.languages[2] == "long"  # learned from a long text alone
    dictionaries = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in model.contents]
    for r in identify_language(docs, model).collect():
        text = next(t for k, t, _ in rows if k == r.doc_id)
        letters = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip().encode()
        blocks = [letters[k : k + 4096] for k in range(0, len(letters), 4096)]
        plain = {"level": 6, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        sizes = [sum(len(zstandard.ZstdCompressor(dict_data=d, **plain).compress(b)) for b in blocks) for d in dictionaries]
        best = min(range(3), key=lambda k: sizes[k])
        margin = 1 - sizes[best] / min(n for k, n in enumerate(sizes) if k != best)
        assert (r.lang_pred, r.rejected) == (model.languages[best], margin < 0.005) and abs(r.margin - margin) < 1e-12, text


def test_as_many_languages_as_allowed(spark):
    rows = [(k, prose("xa", 9, k), f"l{k % 7}" if k else "l6") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert learn_languages(labelled_rows(docs, docs.doc_id >= 0), most_languages=3).languages == ["l6", "l1", "l2"]
