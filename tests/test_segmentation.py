import pytest
from pyspark.sql import functions as F

from mergeloom.functions import text as T
from mergeloom.functions import unicode as U
from mergeloom.sources import corpus

UNICODE = [
    ("kabul edilmek", ["kabul", " edilmek"]), ("a   b", ["a", "   b"]), ("it's we'll", ["it's", " we'll"]), ("x'sy", ["x", "'", "sy"]),
    ("1234567", ["123", "456", "7"]), (" 1234", [" 123", "4"]), ("abc12,3", ["abc", "12", ",", "3"]), (' "hi', [' "', "hi"]),
    ("a\n\nb", ["a", "\n", "\n", "b"]), ("a$,b", ["a", "$,", "b"]), ("a‍1", ["a‍1"]), ("", []), ("  ", ["  "]),
]
BYTE = [("it's", ["it", "'", "s"]), ("1234567", ["1234567"]), ("a ,b", ["a", " ", ",", "b"]), ("  ab", ["  ab"]), ("é1", ["é", "1"])]


@pytest.mark.parametrize(("mode", "cases"), [("unicode", UNICODE), ("byte", BYTE)])
def test_words(spark, mode, cases):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", T.words(F.col("t"), mode).alias("w")).collect()
    got = {r.k: r.w for r in rows}
    for k, (text, want) in enumerate(cases):
        assert got[k] == want, text
        assert "".join(got[k]) == text


def test_display():
    assert [T.display_bytes(bytes(b)) for b in ([32], [10], [7], [0xC4, 0x9F], [0x9F], [0xC4, 65], [0xE2, 0x82], [65])] == ["▁", "\\n", "<0x07>", "ğ", "<0x9F>", "<0xC4>A", "<0xE2><0x82>", "A"]


def test_files_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfhi \xff e\xcc\x81")
    (tmp_path / "sub" / "b.py").write_text("x")
    (tmp_path / "c.png").write_text("no")
    rows = {r.name: r.text for r in corpus.read_files(spark, str(tmp_path), recursive=True, only_text=True).collect()}
    assert rows == {"a.TXT": "hi � é", "b.py": "x"}
    raw = {r.name: bytes(r.bytes) for r in corpus.read_files(spark, str(tmp_path), raw=True).collect()}
    assert raw["a.TXT"].startswith(b"\xef\xbb\xbf") and set(raw) == {"a.TXT", "c.png"}
    assert corpus.without_file(spark.createDataFrame([("x",), ("y",)], "name string"), "x").count() == 1


def test_corpus_and_paragraphs(spark):
    docs = spark.createDataFrame([(2, "c\n\n \n\nd"), (1, "a\n\n\nb")], "id int, text string")
    assert [r.par for r in corpus.split_paragraphs(docs, "id").orderBy("id", "par_idx").collect()] == ["a", "b", "c", "d"]
    assert [r.text for r in corpus.build_corpus(docs, "id").collect()] == ["a\n\n\nb", "c\n\n \n\nd"]
    one, two = ([r.text for r in corpus.build_corpus(docs, "id", shuffle_seed=s).collect()] for s in (5, 5))
    assert one == two and sorted(one) == ["a", "b", "c", "d"]
    assert [r.text for r in corpus.build_corpus(docs.where("id = 2"), "id", shuffle_seed=5).collect()] == ["c\n\n \n\nd"]


def test_unicode_functions(spark):
    row = spark.createDataFrame([("é", "A", "٣", "e", "́", "Aб")], "a string, b string, c string, d string, e string, f string").select(
        U.category(F.col("b")).alias("cat"), U.name(F.col("a")).alias("name"), U.numeric_value(F.col("c")).alias("num"), U.can_compose(F.col("d"), F.col("e")).alias("can"),
        U.script(F.col("b")).alias("script"), U.is_suspicious(F.col("f")).alias("mixed"), U.is_suspicious(F.col("a")).alias("plain"), U.from_name(F.lit("DIGIT ONE")).alias("one"),
        U.in_block(F.col("b"), "BasicLatin").alias("block"), U.is_noncharacter(F.lit(0xFFFE)).alias("non"), U.is_valid_codepoint(F.lit(0xD800)).alias("valid"),
        U.from_utf16(U.to_utf16(F.col("a"))).alias("back"), U.decomposed(F.col("a")).alias("nfd"), U.case_fold(F.lit("ß")).alias("fold"), U.count_words(F.lit("it's two")).alias("words"),
    ).first()
    assert (row.cat, row.name, row.num, row.can, row.script) == (1, "LATIN SMALL LETTER E WITH ACUTE", 3.0, True, 3)
    assert (row.mixed, row.plain, row.one, row.block, row.non, row.valid) == (True, False, "1", True, True, False)
    assert (row.back, row.nfd, row.fold, row.words) == ("é", "é", "ss", 2)


def test_lines_have_the_bag_of_whole_files(spark, tmp_path):
    from mergeloom.operators.training import word_bag

    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone  two\n\n three e\xcc\x81 \xff\r\nfour\n")
    (tmp_path / "b.md").write_text("x y \n z\n")
    (tmp_path / "c.png").write_text("no\n")
    whole, lines = (f(spark, str(tmp_path), only_text=True) for f in (corpus.read_files, corpus.read_lines))
    for mode in ("unicode", "byte"):
        one, two = ({r.word: r.freq for r in word_bag(d, pretokenizer=mode).collect()} for d in (whole, lines))
        assert one == two


def test_scripts_blocks_and_forms(spark):
    import unicodedata

    import regex

    cps = [65, 0xB5, 0x3B1, 0x416, 0x5D0, 0x627, 0x905, 0xE01, 0x4E00, 0xAC00, 0x3042, 0x10D0, 0x1F600, 0x301, 0x20]
    rows = spark.createDataFrame([(c, chr(c)) for c in cps], "cp int, c string").select("cp", U.script(F.col("c")).alias("script"), U.block(F.col("c")).alias("block")).collect()
    for r in rows:
        assert regex.fullmatch(rf"\p{{Script={U.SCRIPTS[r.script]}}}", chr(r.cp)), r
    assert {r.cp: r.block for r in rows}[0x416] == "CYRILLIC" and {r.cp: r.block for r in rows}[65] == "BASIC_LATIN"
    texts = ["é", "e\u0301", "\ufb01", "plain", "", None]
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        got = d.select("k", U.is_normalized(F.col("t"), form).alias("is"), U.normalize_bytes(F.col("t").cast("binary"), form).alias("b"), T.normalize(F.col("t"), form).alias("s")).collect()
        for r in got:
            t = texts[r.k]
            want = None if t is None else unicodedata.normalize(form, t)
            assert r["is"] == (None if t is None else t == want) and r.s == want and (r.b if t is None else bytes(r.b).decode()) == want
    ok = spark.createDataFrame([(1, [65, 0x10FFFF]), (2, [0xD800]), (3, [0x110000]), (4, [])], "k int, c array<int>")
    assert {r.k: r.w for r in ok.select("k", U.is_well_formed(F.col("c")).alias("w")).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_files_that_cannot_be_read_are_listed(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes("﻿é".encode())
    (tmp_path / "stray.txt").write_bytes(b"a\xffb")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"changed since its checksum was made")
    (tmp_path / ".bad.txt.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\0\0\0\0")
    rows = {r.name: (r.status, r.size, r.text) for r in corpus.scan_files(spark, f"file://{tmp_path}").collect()}
    assert rows == {"ok.txt": ("text", 2, "é"), "stray.txt": ("replaced", 5, "a�b"), "empty.txt": ("empty", 0, ""), "bad.txt": ("unreadable", None, None)}


def test_files_in_archives(spark, tmp_path):
    import tarfile

    long = "d/" * 80 + "long name é.txt"
    files = [("ok", "﻿é".encode()), ("stray", b"a\xffb"), ("empty", b""), ("block", b"x" * 512), (long, b"\0\n\0"), ("big", b"y" * 5000)]
    rows = spark.createDataFrame(files * 2, "name string, bytes binary").coalesce(1)  # names may come again
    corpus.write_archives(rows, f"{tmp_path}/a", archive_bytes=2000)
    archives = sorted(tmp_path.glob("a/part-*"))
    assert len(archives) > 2 and sum(len(tarfile.open(a).getmembers()) for a in archives) == 12
    got = sorted((r.name, r.status, r.size, r.text) for r in corpus.scan_archives(spark, f"file://{tmp_path}/a").collect())
    want = [("ok", "text", 2, "é"), ("stray", "replaced", 5, "a�b"), ("empty", "empty", 0, ""), ("block", "text", 512, "x" * 512), (long, "text", 3, "\0\n\0"), ("big", "text", 5000, "y" * 5000)]
    assert got == sorted(want * 2)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.tar").write_bytes(archives[0].read_bytes()[:700])
    with pytest.raises(Exception, match="ends inside an archive"):
        corpus.scan_archives(spark, f"file://{tmp_path}/cut").collect()
