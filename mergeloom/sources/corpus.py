"""Sources of text: files, folders, tables; and their assembly to a corpus."""

from __future__ import annotations

import io
import re
import tarfile
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.text import extension, nfc, paragraphs

#: Extensions of files that are read as text.
TEXT_EXTENSIONS = (
    "txt md markdown rst json jsonl csv tsv xml yaml yml toml html htm css py js mjs ts tsx jsx swift rs go c h cpp hpp cc "
    "java kt kts scala rb php pl lua sh bash zsh fish sql r jl zig wgsl glsl hlsl tex bib srt vtt log"
).split()
SEPARATOR = "\n\n"


def is_text_name(name: Column) -> Column:
    """Whether a file's name has a known text extension."""
    return extension(name).isin(TEXT_EXTENSIONS)


def read_files(spark: SparkSession, *paths: str, recursive: bool = False, only_text: bool = False, raw: bool = False) -> DataFrame:
    """name, size and text (or bytes with raw=True) of files, one row each; scan_files also lists empty and unreadable ones.

    Text is decoded as UTF-8 with U+FFFD for invalid bytes and without a leading byte
    order mark, then brought to NFC. recursive: walk folders. only_text: by extension.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths))
    if only_text:
        files = files.where(is_text_name(F.col("path")))
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    if raw:
        return files.select(name, F.col("length").alias("size"), F.col("content").alias("bytes"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\x{FEFF}", "")
    return files.select(name, F.col("length").alias("size"), nfc(text).alias("text"))


def scan_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path, name, status, size and text of files, a row for each, also for those that cannot be read.

    status: "text"; "replaced", where bytes that are not UTF-8 became U+FFFD; "empty", with an empty text;
    "unreadable", with null for text and size: the file is listed, but went away or fails its checksum.
    Decoding is as in read_files; size is that of the text in bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths))
    # a scan leaves out files without bytes; the names are those of the index that the driver has made for the scan
    names = [(re.sub("^file:///", "file:/", unquote(p)),) for p in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string")
    settings = {"recursiveFileLookup": recursive, "ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    content = F.col("content").cast("string")
    text = nfc(F.regexp_replace(F.make_valid_utf8(content), "^\\x{FEFF}", ""))
    read = spark.read.format("binaryFile").options(**settings).load(list(paths)).select("path", F.is_valid_utf8(content).alias("valid"), text.alias("text"))
    found = listed.join(files.select("path", F.lit(True).alias("filled")), "path", "left").join(read, "path", "left")
    text = F.when(F.col("filled"), F.col("text")).otherwise("")
    status = F.when(text.isNull(), "unreadable").when(text == "", "empty").when(F.col("valid"), "text").otherwise("replaced")
    return found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), status.alias("status"), F.octet_length(text).cast("bigint").alias("size"), text.alias("text"))


def write_archives(files: DataFrame, folder: str, name_col: str = "name", bytes_col: str = "bytes", *, archive_bytes: int = 4 << 20) -> None:
    """Write rows as files of tar archives in a folder, about archive_bytes each; a larger file has an archive for itself.

    A file for each row costs a folder entry, a commit and an opening each; archives are as many as the bytes ask for.
    """

    def packed(batches):
        out, tar, room = None, None, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py() or b""
                if tar is not None and room + len(body) > archive_bytes:
                    tar.close()
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["archive"])
                    tar = None
                if tar is None:
                    out, room = io.BytesIO(), 0
                    tar = tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT)
                member = tarfile.TarInfo(name or "")
                member.size = len(body)
                tar.addfile(member, io.BytesIO(body))
                room += len(body)
        if tar is not None:
            tar.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["archive"])

    rows = files.select(F.col(name_col).alias("name"), F.col(bytes_col).alias("bytes")).mapInArrow(packed, "archive binary")
    # an archive ends with empty blocks; the text writer puts the last byte there
    rows.select(F.substring("archive", F.lit(1), F.octet_length("archive") - 1).cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def scan_archives(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path (of the archive), name, status, size and text of each file in tar archives; as scan_files, but an archive that is damaged or cut off is an error."""

    def members(batches):
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, room = [], 0
                body = value.as_buffer()
                if bytes(body[-1024:]).strip(b"\0"):
                    raise ValueError(f"{path} ends inside an archive")
                with tarfile.open(fileobj=io.BytesIO(body), mode="r:") as tar:
                    for member in tar:
                        if not member.isfile():
                            continue
                        held.append((member.name, tar.extractfile(member).read()))
                        room += len(held[-1][1])
                        if room >= 1 << 20:
                            yield given(path, held)
                            held, room = [], 0
                if held:
                    yield given(path, held)

    def given(path: str, held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        names, contents = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(names), pa.array(contents, pa.binary())], ["path", "name", "content"])

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths)).select("path", "content")
    content = F.col("content").cast("string")
    text = nfc(F.regexp_replace(F.make_valid_utf8(content), "^\\x{FEFF}", ""))
    read = archives.mapInArrow(members, "path string, name string, content binary").select("path", "name", F.is_valid_utf8(content).alias("valid"), text.alias("text"))
    status = F.when(F.col("text") == "", "empty").when(F.col("valid"), "text").otherwise("replaced")
    return read.select("path", "name", status.alias("status"), F.octet_length("text").cast("bigint").alias("size"), "text")


def read_lines(spark: SparkSession, *paths: str, recursive: bool = False, only_text: bool = False) -> DataFrame:
    """name and text of each line of files of any size, its line feed included, read by byte ranges.

    A line feed is a word by itself in both word rules, so the bag of words of the lines is
    that of the whole files. A file's last line gets a line feed too. Decoding is as in read_files.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n").text(list(paths))
    lines = lines.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.make_valid_utf8("value"), F.lit("\n")).alias("text"))
    if only_text:
        lines = lines.where(is_text_name(F.col("name")))
    text = F.when(F.col("start") == 0, F.regexp_replace("text", "^\\x{FEFF}", "")).otherwise(F.col("text"))
    return lines.select("name", nfc(text).alias("text"))


def without_file(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.col("name") != name)


def profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """n_docs, total_bytes and total_chars of a corpus."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length(text_col)).alias("total_bytes"), F.sum(F.char_length(text_col)).alias("total_chars")
    )


def character_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """c and n: each character of the texts and how often it stands there."""
    each = texts.select(F.explode(F.split(text_col, "")).alias("c")).where("c != ''")
    return each.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def byte_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """byte and n: each byte of the texts in UTF-8 and how often it stands there."""
    latin = F.decode(F.encode(text_col, "UTF-8"), "ISO-8859-1")  # a character for each byte
    return character_counts(texts.select(latin.alias("text"))).select(F.ascii("c").alias("byte"), "n")


def split_paragraphs(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, par_idx (from 0, blank ones left out) and par of each text."""
    return docs.select(id_col, F.posexplode(paragraphs(F.col(text_col))).alias("par_idx", "par"))


def shuffled(pars: DataFrame, seed: int, *key_cols: str) -> DataFrame:
    """Rows in an order given by a hash of the seed and their keys, the same on every run: adds shuffle_key."""
    key = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key_cols]).cast("binary"))
    return pars.withColumn("shuffle_key", key).orderBy("shuffle_key")


def build_corpus(docs: DataFrame, id_col: str, text_col: str = "text", shuffle_seed: int | None = None) -> DataFrame:
    """The corpus as rows (text), in order of id; with a seed and more than one text as shuffled paragraphs."""
    if shuffle_seed is None or docs.limit(2).count() < 2:
        return docs.orderBy(id_col).select(F.col(text_col).alias("text"))
    return shuffled(split_paragraphs(docs, id_col, text_col), shuffle_seed, id_col, "par_idx").select(F.col("par").alias("text"))


def concatenated(docs: DataFrame, group_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """group and text: each group's texts in order, joined by an empty line. A group must fit in a row."""
    parts = docs.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("parts"))
    return parts.select(group_col, F.array_join(F.col("parts").getField(text_col), SEPARATOR).alias("text"))
