import random

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import text as T
from mergeloom.operators import segments, training

PIECES = ["a", "it's", "'S", "’ll", "'", "s", "re", "12345678901", "1", " ", "  ", "\n", ",", "$%", "‍", "́", "é", "中文", "😀", "٣٤", " ", "x'sy", "\x00", "\t"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(5, 60))) for _ in range(150)]
    return [None, "", "short", "1" * 200, "a" + "7" * 101 + "b", "x" * 90, " " * 77, "‍" * 50 + "5" * 40, "n's" * 40, "'s" * 40, "9‍" * 40, *made]


@pytest.mark.parametrize("mode", ["unicode", "byte"])
@pytest.mark.parametrize("size", [1, 3, 10, 64])
def test_words_are_those_of_the_whole_text(spark, texts, mode, size):
    docs = spark.createDataFrame(list(enumerate(texts)), "giant int, text string")  # a clashing name
    cut = segments.cut_at_words(docs, "text", mode, part_bytes=size)
    assert cut.columns == ["giant", "text", "piece"]
    got, whole = {}, {}
    for r in sorted(cut.select("giant", "piece", T.words(F.col("text"), mode).alias("w")).collect(), key=lambda r: (r.giant, r.piece)):
        rows = got.setdefault(r.giant, [])
        assert r.piece == len(rows)
        rows.append(r.w)
    for r in docs.select("giant", T.words(F.col("text"), mode).alias("w")).collect():
        whole[r.giant] = r.w
    assert set(got) == set(whole)
    for k, rows in got.items():
        assert (None if rows == [None] else [w for words in rows for w in words]) == whole[k], texts[k]
        assert size > 10 or texts[k] is None or len(texts[k].encode()) <= size or all(rows), texts[k]
    assert max(map(len, got.values())) > 1


def test_repeated_rows_empty_tables_and_names(spark):
    docs = spark.createDataFrame([(1, "one two three", "x")] * 2, "id int, body string, part string")
    rows = segments.cut_at_words(docs, "body", part_bytes=4).collect()
    assert sorted((r.id, r.piece, r.body, r.part) for r in rows) == sorted([(1, 0, "one two", "x"), (1, 1, " three", "x")] * 2)
    assert segments.cut_at_words(docs.limit(0), "body").count() == 0
    with pytest.raises(ValueError, match="piece"):
        segments.cut_at_words(docs.withColumnRenamed("part", "piece"), "body")


def test_a_bag_of_giant_texts(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    one, two = ({r.word: r.freq for r in training.word_bag(docs, part_bytes=n).collect()} for n in (None, 16))
    assert one == two
