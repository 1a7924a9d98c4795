"""Models and token streams in and out: JSON, text, and the binary export."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.operators.training import Merge, token_bytes

MODEL_SCHEMA = "version int, vocabSize int, vocab array<array<int>>, merges array<array<int>>"
#: Fixed value: the first number of a binary export.
EXPORT_MAGIC = 0x44584654
#: The most ids that the 32 bits of an export's header tell of.
MOST_IDS = 2**32 - 1


def model_json(merges: list[Merge]) -> str:
    """A model as JSON, version 1: vocabulary as lists of bytes, merges as [a, b, new id]."""
    vocab = [list(b) for b in token_bytes(merges)]
    return json.dumps({"version": 1, "vocabSize": len(vocab), "vocab": vocab, "merges": [[m.a, m.b, m.new_id] for m in merges]}, separators=(",", ":"))


def write_model(spark: SparkSession, merges: list[Merge], folder: str) -> None:
    """Write a model's JSON as a one-line text file."""
    spark.createDataFrame([(model_json(merges),)], "value string").coalesce(1).write.text(folder)


def parse_models(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Models from JSON text: version, vocabSize (the vocabulary's length), vocab, merges; an error for others."""
    model = F.from_json(json_col, MODEL_SCHEMA)
    parsed = rows.select(model.alias("m"))
    bad = F.col("m").isNull() | F.col("m.vocab").isNull() | F.col("m.merges").isNull()
    checked = F.when(bad, F.raise_error("a model needs vocab and merges")).otherwise(F.size("m.vocab"))
    return parsed.select("m.version", checked.cast("int").alias("vocabSize"), "m.vocab", "m.merges")


def model_vocabulary(models: DataFrame) -> DataFrame:
    """token_id, bytes and display (invalid bytes as U+FFFD) of a parsed model."""
    rows = models.select(F.posexplode("vocab").alias("token_id", "b"))
    text = F.unhex(F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))
    return rows.select("token_id", text.alias("bytes"), F.make_valid_utf8(text.cast("string")).alias("display"))


def read_model(spark: SparkSession, folder: str) -> DataFrame:
    return parse_models(spark.read.text(folder, wholetext=True))


def vocabulary_text(vocab: DataFrame, title: str = "Vocabulary") -> DataFrame:
    """One row with a vocabulary as text: two comment lines, an empty one, then id, display and bytes."""
    listed = F.transform(F.sequence(F.lit(0), F.length("bytes") - 1), lambda i: F.conv(F.hex(F.substr("bytes", i + 1, F.lit(1))), 16, 10))
    line = F.concat_ws("\t", F.col("token_id").cast("string"), "display", F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
    lines = vocab.select("token_id", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("token_id", "line"))).alias("l"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit(f"# {title}\n# Total tokens: "), F.col("n").cast("string"), F.lit("\n\n"))
    return lines.select(F.concat(head, F.array_join("l.line", "\n"), F.lit("\n")).alias("text"))


def little_endian(number: Column) -> Column:
    """Four bytes of a number, lowest first, in hexadecimal."""
    h = F.lpad(F.hex(number.cast("bigint")), 8, "0")
    return F.concat(*[F.substr(h, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)])


def token_blob(tokens: DataFrame, vocab_json: str, vocab_size: int, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """id and export of each row: four 32-bit numbers (magic, vocabulary, tokens, JSON length), tokens, JSON."""
    tail = vocab_json.encode().hex().upper()
    numbers = [F.lit(EXPORT_MAGIC), F.lit(vocab_size), F.size(tokens_col), F.lit(len(tail) // 2)]
    body = F.array_join(F.transform(tokens_col, little_endian), "")
    return tokens.select(id_col, F.unhex(F.concat(*[little_endian(n) for n in numbers], body, F.lit(tail))).alias("export"))


def parse_token_blob(blob: bytes) -> tuple[int, list[int], str]:
    """Vocabulary size, token ids and JSON of an export."""
    magic, size, n, length = struct.unpack_from("<4I", blob)
    if magic != EXPORT_MAGIC:
        raise ValueError("not a token export")
    ids = list(struct.unpack_from(f"<{n}I", blob, 16))
    return size, ids, blob[16 + 4 * n : 16 + 4 * n + length].decode()


def _write_raw(rows: DataFrame, last: str, folder: str) -> None:
    """Write rows of bytes one after the other; each ends with the byte `last`, which the text writer puts there."""
    rows.select(F.substring("bytes", F.lit(1), F.octet_length("bytes") - 1).cast("string").alias("value")).write.option("lineSep", last).text(folder)


def export_corpus(encoded: DataFrame, vocab_json: str, vocab_size: int, folder: str, file_ids: int = 2 << 20, most_ids: int = MOST_IDS) -> int:
    """Write the ids of a whole corpus (piece, offset, tokens, width and ids, as encode_corpus gives them) as one export in files; the number of ids.

    The files of folder/0-header, 1-tokens and 2-vocabulary, in this order and within each in order of their names, are
    the export that token_blob gives for all ids in a row. Each task writes the ids of a range of pieces, about file_ids
    on average: files do not grow with the corpus, since a file is read back as a row. A header tells of at most
    most_ids: a larger corpus goes into several exports one after the other, folder/volume-k-of-n, each with header and vocabulary.
    """
    found = encoded.agg(F.sum("tokens").alias("n"), F.max("tokens").alias("most")).first()
    total, room = found.n or 0, most_ids - (found.most or 0)  # a volume ends with the piece that begins in its room
    if total > most_ids and room < 1:
        raise ValueError(f"a piece of {found.most} ids in exports of at most {most_ids}")
    volume = F.expr(f"offset div {room}") if total > most_ids else F.lit(0)
    volumes = encoded.groupBy(volume.alias("volume")).agg(F.sum("tokens").alias("n"), F.min("piece").alias("first"), F.max("piece").alias("last")).orderBy("volume").collect()
    if len(volumes) < 2:
        _write_export(encoded, total, 0, volumes[0].last if volumes else -1, vocab_json, vocab_size, folder, file_ids)
    else:
        for k, v in enumerate(volumes):
            _write_export(encoded.where(F.col("piece").between(v.first, v.last)), v.n, v.first, v.last, vocab_json, vocab_size, f"{folder}/volume-{k:05d}-of-{len(volumes):05d}", file_ids)
    return total


def _write_export(encoded: DataFrame, n: int, first: int, last: int, vocab_json: str, vocab_size: int, folder: str, file_ids: int) -> None:
    """Write pieces first to last, which have n ids, as one export."""
    spark, tail = encoded.sparkSession, vocab_json.encode()

    def widened(batches):
        for batch in batches:
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"bytes": pa.array([np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4").tobytes()], pa.binary())})

    head = struct.pack("<4I", EXPORT_MAGIC, vocab_size, n, len(tail))
    raw = lambda value: spark.createDataFrame([(bytearray(value),)], "bytes binary").coalesce(1)
    _write_raw(raw(head), chr(head[-1]), f"{folder}/0-header")
    number = max(1, -(-n // file_ids))
    each = max(1, -(-(last + 1 - first) // number))
    # piece numbers have no gaps: a range of them is a file, without a pass for their bounds
    files = encoded.select("piece", "width", "ids").repartitionById(number, F.floor((F.col("piece") - first) / each).cast("int"))
    rows = files.sortWithinPartitions("piece").select("width", "ids").mapInArrow(widened, "bytes binary")
    _write_raw(rows.where(F.octet_length("bytes") > 0), "\0", f"{folder}/1-tokens")  # ids are under 2**24
    if tail:
        _write_raw(raw(tail), chr(tail[-1]), f"{folder}/2-vocabulary")


def _volumes(spark: SparkSession, folder: str) -> list[str]:
    """The folders of an export's volumes in order, or its own where it has none; ValueError where one lacks."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(str(f.getPath().getName()) for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place))
    names = [n for n in names if re.fullmatch(r"volume-\d+-of-\d+", n)]
    wanted = int(names[0].rsplit("-", 1)[1]) if names else 0
    if len(names) != wanted:
        raise ValueError(f"{len(names)} volumes instead of {wanted}")
    return [f"{folder}/{n}" for n in names] or [folder]


def _export_files(spark: SparkSession, folder: str) -> DataFrame:
    """start (its first id's number) and content of each file of ids of an export.

    Raises ValueError when a header is not an export's or tells of another number of ids, or when a volume lacks.
    """
    parts, wanted = _volumes(spark, folder), {}
    for k, part in enumerate(parts):
        head = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{part}/0-header").select("content").collect())
        if len(head) != 16 or struct.unpack("<4I", head)[0] != EXPORT_MAGIC:
            raise ValueError("not a token export")
        wanted[k] = struct.unpack("<4I", head)[2]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{part}/1-tokens" for part in parts])
    name = [F.coalesce(F.regexp_extract("path", pattern, 1).try_cast("bigint"), F.lit(0)) for pattern in (r"/volume-(\d+)-of-\d+/1-tokens/part-", r"part-(\d+)[^/]*$")]
    files = files.withColumns({"volume": name[0], "number": name[1]})
    found = {r.volume: r.n for r in files.groupBy("volume").agg(F.sum("length").alias("n")).collect()}
    for k, n in wanted.items():
        if found.get(k, 0) != 4 * n:
            raise ValueError(f"{found.get(k, 0) // 4} ids instead of {n}")
    order = Window.orderBy("volume", "number")  # a row for each file
    places = files.select("volume", "number", ((F.sum("length").over(order) - F.col("length")) / 4).cast("bigint").alias("start"))
    return files.select("volume", "number", "content").join(F.broadcast(places), ["volume", "number"]).select("start", "content")


def read_export(spark: SparkSession, folder: str, most: int = 1 << 16) -> DataFrame:
    """position (of the first) and tokens of an exported corpus, `most` ids of a file at a time; errors as those of _export_files."""

    def cut(batches):
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u4").astype(np.int32)
                for a in range(0, len(ids), most):
                    part = ids[a : a + most]
                    yield pa.RecordBatch.from_arrays([pa.array([start + a], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], ["position", "tokens"])

    return _export_files(spark, folder).mapInArrow(cut, "position bigint, tokens array<int>")


def export_sums(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """block, n_tokens and ids_sum for every `size` ids of an exported corpus: their number, and the sum of each id times its place in the block, from 1; errors as those of _export_files."""

    def sums(batches):
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u4")
                for a in range(0, len(ids), 1 << 18):
                    part = ids[a : a + (1 << 18)]
                    place = np.arange(start + a, start + a + len(part))
                    block = place // size
                    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                    found = np.add.reduceat(part * (place - block * size + 1), first)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block[first], np.diff(np.r_[first, len(part)]), found)], ["block", "n_tokens", "ids_sum"])

    parts = _export_files(spark, folder).mapInArrow(sums, "block bigint, n_tokens bigint, ids_sum bigint")
    return parts.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("ids_sum").alias("ids_sum"))


def write_tokens(tokens: DataFrame, folder: str) -> None:
    """Token ids as Parquet, the export for large corpora."""
    tokens.write.parquet(folder)
