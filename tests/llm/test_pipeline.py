import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

STEMS = {"xa": "kora mita selu vano peri duma loki zane".split(), "yb": "strong birth cloud thing wrench graft shelf drown".split()}


def prose(lang, words, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang])[:3] for _ in range(words))


def test_each_stage_drops_what_it_should(spark, tmp_path):
    rows, labels = [], []
    for k in range(300):
        lang = "xa" if k % 2 else "yb"
        text = prose(lang, 60, k)
        toxic = k % 5 == 0
        if toxic:
            text = text.replace(" ", " vilest ", 1)
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, 1, int(toxic)))
    clean = [r[0] for r in rows if r[0] % 5]
    copy, near = rows[7], rows[11]
    words = near[1].split()
    words[30] = "changed"
    rows.append((1000, copy[1] + "\n", copy[2], "s", 0))  # longer, so it stays and row 7 goes
    rows.append((1001, " ".join(words), near[2], "s", 0))
    rows.append((1002, prose("xa", 50, "z") + " v1l3st " + "v i l e s t", "xa", "s", 0))
    rows += [(1003, "12 34", None, None, 0), (1004, None, "xa", "s", 0), (1005, "", "xa", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = (set(clean) | {1000}) - {7}
    assert {r.doc_id for r in packed} == want
    fills = {}
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 4096


STAGES = [corpus_pipeline.toxicity, corpus_pipeline.language, corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates, corpus_pipeline.packing]


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_columns_long_texts_and_empty_tables(spark, tmp_path, stage):
    extra = ["again_id", "dropped_id", "kept", "text_key", "id", "group", "first", "node", "word", "label", "n", "row", "text_group", "a.b"]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(k, prose("xa" if k % 2 else "yb", 40, k) + (" vilest" if k % 5 == 0 else ""), "xa" if k % 2 else "yb") for k in range(120)]
    rows += [(900, prose("xa", 100_000, "long"), "xa"), (1, rows[1][1], "xa"), (None, rows[3][1], "xa"), (901, "word " * 200_000, None), (902, "", None), (None, None, None)]
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(120)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(*r, *[f"{c}{k}" for c in extra]) for k, r in enumerate(rows)], schema)
    out = stage(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 900 in ids
    if stage is not corpus_pipeline.packing:
        assert out.schema == docs.schema
        if stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates):
            assert ids.count(1) == 1 and 3 in ids  # a repeated row once, a copy without id not
    none = stage(spark, docs.where("doc_id > 5000"), str(tmp_path))
    assert none.count() == 0 and none.schema == out.schema


def test_decisions_are_per_row(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, row_key int"
    plain = [(k, prose("xa" if k % 2 else "yb", 60, k) + (" vilest" if k % 5 == 0 else ""), "xa" if k % 2 else "yb", 0) for k in range(300)]
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    # 1001 and null are ids of a row that goes and of one that stays
    clean, other = prose("xa", 60, "p"), prose("yb", 60, "q")
    odd = [(1001, clean, "xa", 1), (1001, other + " vilest", "yb", 2), (None, other, "yb", 3), (None, clean + " vilest", "xa", 4)]
    out = corpus_pipeline.toxicity(spark, spark.createDataFrame(plain + odd, schema), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "row_key"]
    assert {r.row_key for r in out.where("row_key > 0").collect()} == {1, 3}

    odd = [(1001, clean, "xa", 1), (1001, "", "xa", 2), (None, other, "yb", 3), (None, None, "yb", 4)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(plain + odd, schema), str(tmp_path))
    assert {r.row_key for r in out.where("row_key > 0").collect()} == {1, 3}

    # copies go whatever else their ids stand for; of copies the smallest id stays, null last
    words = clean.split()
    words[50] = "changed"
    for copy, stage in ((clean + "\n", corpus_pipeline.exact_duplicates), (" ".join(words), corpus_pipeline.near_duplicates)):
        third = prose("xa", 60, "r")
        odd = [(1005, copy, "xa", 1), (1003, copy, "xa", 2), (None, copy, "xa", 3), (1005, other, "yb", 4), (None, third, "xa", 5), (1003, copy, "xa", 6)]
        out = stage(spark, spark.createDataFrame(odd, schema), "").collect()
        assert sorted((r.doc_id or 0, r.text == copy) for r in out) == [(0, False), (1003, True), (1005, False)]
        odd = [(1005, clean, "xa", 1), (1003, copy, "xa", 2), (None, other, "yb", 3), (None, copy, "xa", 4), (1003, third, "xa", 5)]
        out = stage(spark, spark.createDataFrame(odd, schema), "").collect()
        assert {r.row_key for r in out} == {2, 3, 5}


def test_language_stage_has_the_margin_of_the_operator(spark):
    from mergeloom.llm.common import bucket_of_id
    from mergeloom.llm.language import identify_language, labelled_rows, learn_languages

    rows = [(k, prose("xa" if k % 2 else "yb", 60, k), "xa" if k % 2 else "yb") for k in range(300)]
    for k in range(300, 400):  # half of the one, half of the other
        rows.append((k, prose("xa", 150, k) + " " + prose("yb", 95 + k % 60, k), None))
    docs = spark.createDataFrame([*rows, (500, "12 34", None)], "doc_id bigint, text string, lang string")
    model = learn_languages(labelled_rows(docs, bucket_of_id("doc_id", 4) != 2))
    verdicts = identify_language(docs, model).collect()
    assert any(r.rejected and r.margin >= 0.0005 for r in verdicts)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {r.doc_id for r in verdicts if not r.rejected}
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, ["lang"])
    assert {r.doc_id for r in corpus_pipeline.language(spark, unlabelled, "").collect()} == {r[0] for r in rows}


def small_corpus(path, spark):
    rows = [(k, prose("xa" if k % 2 else "yb", 60, k) + (" vilest" if k % 5 == 0 else ""), "xa" if k % 2 else "yb") for k in range(200)]
    rows += [(300, rows[7][1], "xa"), (301, rows[7][1].replace(" ", "\n"), "xa"), (302, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return {k for k in range(200) if k % 5}


def test_texts_that_share_a_hash_lose_no_row(spark, tmp_path, monkeypatch):
    """One text in three has the same first hash as others."""
    from pyspark.sql import functions as F

    plain = corpus_pipeline.text_hash
    monkeypatch.setattr(corpus_pipeline, "text_hash", lambda salt: F.pmod(plain(0), F.lit(40)) if salt == 0 else plain(salt))
    want = small_corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scratch = corpus_pipeline.Scratch(spark, "keys")
    rows, key = corpus_pipeline.keyed(docs, scratch)
    assert rows.select(key).distinct().count() == docs.select("text").distinct().count() == rows.select(key, "text").distinct().count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_nothing_is_left_but_the_result(spark, tmp_path, monkeypatch):
    import os

    from mergeloom.sources import storage

    root = tmp_path / "shared"
    small_corpus(tmp_path, spark)
    monkeypatch.setattr(storage, "shared_root", lambda spark: str(root))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    (folder,) = os.listdir(root)
    assert folder.startswith("pipeline-") and len(os.listdir(root / folder)) == 1 and rows.count() == 160
