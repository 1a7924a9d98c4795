"""Token counts per document in flat token files, by a separator scan.

A flat token file is nothing but token ids of 16 bits, little-endian, each document ended
by an end-of-document id; there is no index. Spark deals out a file's byte ranges to tasks,
however large it is. A task searches its range block by block for the end id with one
vector comparison, and yields how many ends a block holds and, for each piece of a document
in it, the tokens seen. Exclusive prefix sums on two levels, over the blocks of a range and
the ranges of a file, give every piece its document's number and place, and pieces of one
document that lie in several blocks are added.

Byte ranges come from Spark's text reader with the end id's bytes as line separator (one of
them if they are alike, as a separator must not overlap itself), which splits anywhere;
lines are put together again before they are searched, because the bytes may also match
across two tokens. Whether a range begins with a whole token is known only once
the ranges before it are summed, so ranges that are not a file's first are searched both
ways and the right one is chosen then.

Defined results for odd input
-----------------------------
* A null or empty text is a document of no tokens. Texts of any length are tokenized whole.
* Tokens after a file's last end id, if any, form a last document that is marked as open.
* An empty file has no documents; an empty table of texts gives no files with documents.
* Null ids and repeated rows keep their own places. Other columns are not read.
* An id of more than 16 bits raises ValueError when files are written, a file of an odd
  number of bytes when it is scanned. Bytes without an end id for 2 GB are beyond the reader.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.words import row_slices, text_bytes

PIECES = "file bigint, split bigint, odd int, block bigint, ends bigint, size bigint, bytes bigint, piece bigint, tokens bigint, lead bigint, closed boolean"


NAMES = [x.split()[0] for x in PIECES.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]


@lru_cache(maxsize=2)
def rank_encoding(rank_file: str):
    """One encoder for each Python worker, from a file of base64 tokens and their ranks."""
    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_bytes(end_id: int) -> bytes:
    if end_id >= 1 << 16:
        raise ValueError("ids of 16 bits only")
    return end_id.to_bytes(2, "little")


def separator(end_id: int) -> bytes:
    """What splits files into lines to read: the end id's bytes, or one of them if they are alike."""
    end = end_bytes(end_id)
    return end[:1] if end[0] == end[1] else end


def write_token_files(docs: DataFrame, id_col: str, text_col: str, rank_file: str, end_id: int, folder: str) -> DataFrame:
    """Tokenize docs into flat files in folder; one file for each partition, in row order.

    The end id is written as the line separator of Spark's own text writer, which any
    storage takes. Returns id, part and place: the place of each row in its partition's
    file, by a plan of the same scan. docs must be read from storage, so that a partition
    that is computed again has the same rows in the same order.
    """

    def tokens(batches):
        encoding = rank_encoding(rank_file)
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                out = []
                for text in batch.column(0)[a:b].to_pylist():
                    ids = np.array(encoding.encode_ordinary((text or b"").decode("utf-8", "replace")), np.int64)
                    if len(ids) and int(ids.max()) >= 1 << 16:
                        raise ValueError("ids of 16 bits only")
                    out.append(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["tokens"])

    flat = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(tokens, "tokens binary").selectExpr("CAST(tokens AS STRING) AS value")
    flat.write.option("lineSep", end_bytes(end_id).decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    place = F.monotonically_increasing_id()
    empty = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) == 0
    return docs.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"), empty.alias("empty"))


def joined_lines(lines: pa.Array, end: bytes) -> np.ndarray:
    """The bytes of lines, each with its separator."""
    data, offsets = text_bytes(lines)
    out = np.empty(len(data) + len(end) * len(lines), np.uint8)
    ends = offsets[1:] + len(end) * np.arange(len(lines))
    own = np.ones(len(out), bool)
    for k, byte in enumerate(end):
        out[ends + k], own[ends + k] = byte, False
    out[own] = data
    return out


def block_pieces(ids: np.ndarray, end_id: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of ends, and for each piece of a document its tokens, where it begins and whether an end follows."""
    ends = np.flatnonzero(ids == end_id)
    tokens = np.diff(np.r_[-1, ends, len(ids)]) - 1
    closed = np.arange(len(tokens)) < len(ends)
    if not tokens[-1] and len(ends):  # nothing follows the last end
        tokens, closed = tokens[:-1], closed[:-1]
    return len(ends), tokens, np.cumsum(tokens + closed) - (tokens + closed), closed


def scan_pieces(spark: SparkSession, folder: str, end_id: int, block_tokens: int) -> DataFrame:
    """Rows of PIECES: for each block of each byte range of a file its pieces of documents, in order.

    odd: 1 where the range is read as if its first byte were the second one of a token,
    whose first is then the last byte of the separator before.
    """
    end = separator(end_id)

    def scan(batches):
        where, state = None, []
        for batch in batches:
            key = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.r_[0, np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                file, split = int(key[0][a]), int(key[1][a])
                if where != (file, split):
                    where, state = (file, split), [[0, b"", 0], [1, end[-1:], 0]][: 2 if split else 1]
                raw = joined_lines(batch.column(0)[a:b], end)
                for own in state:
                    odd, carried, block = own
                    data = np.r_[np.frombuffer(carried, np.uint8), raw]
                    whole = len(data) // 2 * 2
                    own[1] = data[whole:].tobytes()
                    ids = np.frombuffer(data[:whole].tobytes(), "<u2")
                    for at in range(0, max(1, len(ids)), block_tokens):
                        part = ids[at : at + block_tokens]
                        ends, tokens, lead, closed = block_pieces(part, end_id)
                        n = len(tokens)
                        numbers = (file, split, odd, block, ends, len(part), len(raw) if not at else 0)
                        columns = [pa.array(np.full(n, x), k) for x, k in zip(numbers, KINDS, strict=False)] + [pa.array(np.arange(n)), pa.array(tokens), pa.array(lead), pa.array(closed)]
                        yield pa.RecordBatch.from_arrays(columns, NAMES)
                        block += 1
                    own[2] = block

    lines = spark.read.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return lines.mapInArrow(scan, PIECES)


def scanned_files(spark: SparkSession, folder: str, end_id: int, block_tokens: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pieces of documents in the files of folder (PIECES) and a list of the files, both stored: folder is read here only."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")  # no content is read
    files = scratch.store(files.select(F.col("path").alias("name"), F.xxhash64("path").alias("file"), "length"), "files")
    if not files.where("length % 2 = 1").isEmpty():
        raise ValueError(f"{folder} has files that are not of 2-byte tokens")
    return scratch.store(scan_pieces(spark, folder, end_id, block_tokens), "pieces"), files


def stitched_documents(pieces: DataFrame, files: DataFrame, end_id: int, scratch: Scratch) -> DataFrame:
    """The documents that the pieces make up, as count_tokens returns them."""
    own = ["file", "split", "odd"]
    blocks = pieces.where("piece = 0").select(*own, "block", "ends", "size", "bytes")
    before = lambda column, by, order: F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # first over ranges: where each begins tells which reading of it holds
    splits = blocks.groupBy(*own).agg(F.sum("ends").alias("ends"), F.sum("bytes").alias("bytes"))
    begins = splits.where("odd = 0").select("file", "split", before("bytes", ["file"], "split").alias("begin"))
    right = splits.join(begins, ["file", "split"]).where("odd = begin % 2")
    right = right.select(*own, "begin", "bytes", before("ends", ["file"], "split").alias("documents"))
    right = scratch.store(right, "ranges")
    # then over the blocks of a range
    inside = blocks.select(*own, "block", before("ends", own, "block").alias("inner"), before("size", own, "block").alias("tokens_before"))
    inside = scratch.store(inside, "blocks")
    offset = ((F.col("begin") - F.col("odd")) / 2 + F.col("tokens_before")).cast("bigint").alias("offset")
    based = scratch.store(inside.join(right, own).select(*own, "block", (F.col("documents") + F.col("inner")).alias("base"), offset), "bases")
    stitched = (
        pieces.join(with_small_side(based, based.count(), 64), [*own, "block"])
        .groupBy("file", (F.col("base") + F.col("piece")).alias("place"))
        .agg(F.sum("tokens").alias("n_tokens"), F.max("closed").alias("closed"), F.min(F.col("offset") + F.col("lead")).alias("start"))
    )
    # a file without an end id at its end was read as if it had one
    ends = right.groupBy("file").agg(F.max(F.col("begin") + F.col("bytes")).alias("read"))
    listed = scratch.store(files.join(ends, "file", "left"), "files-read")
    if not listed.where(f"read IS NULL OR read NOT IN (length, length + {len(separator(end_id))})").isEmpty():
        raise RuntimeError("the ranges read do not make up the files")
    found = stitched.join(with_small_side(listed, listed.count(), 300), "file")
    unended = (F.col("read") > F.col("length")) & (F.col("start") + F.col("n_tokens") >= F.col("length") / 2)
    found = found.select(F.col("name").alias("file"), "place", "start", "n_tokens", (F.col("closed") & ~unended).alias("closed"))
    return found.where("closed OR n_tokens > 0")


def count_tokens(spark: SparkSession, folder: str, *, end_id: int, block_tokens: int = 1 << 19) -> DataFrame:
    """One row for each document of the flat token files in folder.

    Columns: file, place (number in the file, from 0), start (its first token's place in
    the file), n_tokens (without the end id), closed (whether an end id follows).
    block_tokens: tokens searched at once; blocks take no notice of documents.
    """
    scratch = Scratch(spark, "token-counts")
    return stitched_documents(*scanned_files(spark, folder, end_id, block_tokens, scratch), end_id, scratch)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rank_file: str, end_id: int = 50256) -> DataFrame:
    """Tokenize docs into flat files, scan those, and give each row its count: id, n_tokens, part, place, start.

    Raises RuntimeError unless every file holds as many documents as its partition has rows,
    and tokens for those rows only that have a text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("flat-tokens")
    places = scratch.store(write_token_files(docs, id_col, text_col, rank_file, end_id, folder), "places")
    pieces, files = scanned_files(spark, folder, end_id, 1 << 19, scratch)
    scratch.drop("flat-tokens")
    counts = stitched_documents(pieces, files, end_id, scratch)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    counts = scratch.store(counts.select(part.alias("part"), "place", "start", "n_tokens"), "counts")
    scratch.drop("pieces", "ranges", "blocks", "bases", "files", "files-read")
    joined = scratch.store(places.join(counts, ["part", "place"], "full"), "joined")
    if not joined.where("n_tokens IS NULL OR empty IS NULL OR empty != (n_tokens = 0)").isEmpty():
        raise RuntimeError("the token files do not hold the documents of the table, row by row")
    scratch.drop("places", "counts")
    return joined.select(F.col("id").alias(id_col), "n_tokens", "part", "place", "start")
