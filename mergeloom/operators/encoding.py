"""Encoding by merge order and by longest match, and decoding.

Texts go to Arrow functions in batches; merges, matches and lookups run over a whole batch
in numpy (mergeloom.operators.batches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.operators.batches import MergeTable, Trie, flat_bytes, lists_of, picked, slices
from mergeloom.operators.training import Merge, token_bytes

REPLACEMENT = b"\xef\xbf\xbd"


def merged_slices(table: MergeTable, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Ids by merge order, given out slice by slice: ids take several times the room of their texts."""
    for values in batches:
        for part in slices(values):
            yield lists_of(*table.apply(*flat_bytes(part)), part)


def matched_slices(trie: Trie, size: int, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Chunks of ids by longest match, given out slice by slice."""
    for values in batches:
        for part in slices(values):
            ids, chunks, rows = trie.encode(*flat_bytes(part), size)
            lists = pa.ListArray.from_arrays(pa.array(chunks.astype(np.int32)), pa.array(ids))
            yield pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), lists, mask=pc.is_null(part))


def encode_merge_order(docs: DataFrame, merges: list[Merge] | None, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """docs with the token ids of each whole text: every merge once, in order, from left to right.

    Without merges the ids are the bytes; None, no model at all, raises ValueError. Null stays null.
    """
    if merges is None:
        raise ValueError("no model")
    table = MergeTable([(m.a, m.b, m.new_id) for m in merges])

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return merged_slices(table, batches)

    return docs.withColumn(out_col, run(F.col(text_col).cast("binary")))


def chunk_size(longest: int) -> int:
    """Bytes of a chunk for a vocabulary whose longest token has that many bytes."""
    return max(512, min(2048, 8 * longest))


def encode_longest_match(
    docs: DataFrame, vocabulary: list[bytes], text_col: str = "text", out_col: str = "chunks", size: int | None = None, part_bytes: int | None = None
) -> DataFrame:
    """docs with an array of chunks, each an array of token ids, for each text (string or binary).

    vocabulary: the bytes of each id, at most MOST_TOKENS; of equal ones the last counts,
    empty ones never. part_bytes: values longer than that are cut into parts of about so
    many bytes, which are dealt out to tasks and put together again; chunks know nothing
    of each other, so the result is the same.
    """
    longest = max(map(len, vocabulary), default=1) or 1
    step = size or chunk_size(longest)
    trie = docs.sparkSession.sparkContext.broadcast(Trie(vocabulary))

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return matched_slices(trie.value, step, batches)

    value = F.col(text_col).cast("binary")
    if part_bytes is None:
        return docs.withColumn(out_col, run(value))
    part = -(-part_bytes // step) * step
    giant = F.coalesce(F.octet_length(text_col) > part, F.lit(False))
    plain, big = docs.where(~giant).withColumn(out_col, run(value)), docs.where(giant).withColumn("giant_key", F.sha2(value, 256))
    values = big.select("giant_key", value.alias("value")).dropDuplicates(["giant_key"])
    at = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("value") - 1) / part))).alias("part")
    parts = values.select("giant_key", at, "value").select("giant_key", "part", F.substring("value", F.col("part") * part + 1, F.lit(part)).alias("value"))
    found = parts.repartition("giant_key", "part").select("giant_key", "part", run(F.col("value")).alias("chunks"))
    joined = found.groupBy("giant_key").agg(F.array_sort(F.collect_list(F.struct("part", "chunks"))).alias("parts"))
    whole = big.join(joined, "giant_key").withColumn(out_col, F.flatten("parts.chunks"))
    return plain.unionByName(whole.select(*plain.columns))


def chunk_offsets(encoded: DataFrame, id_col: str, chunks_col: str = "chunks") -> DataFrame:
    """id, chunk, tokens and offset: how many tokens each chunk has and how many come before it."""

    @F.arrow_udf("array<bigint>")
    def sums_before(sizes: pa.Array) -> pa.Array:
        flat = pc.fill_null(sizes.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(counts)]
        before = np.r_[0, np.cumsum(flat)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(before[:-1] - np.repeat(before[ends[:-1]], counts)))

    sizes = F.transform(chunks_col, lambda c: F.size(c))
    rows = encoded.select(id_col, sizes.alias("sizes")).where(F.size("sizes") > 0).select(id_col, "sizes", sums_before("sizes").alias("before"))
    return rows.select(id_col, F.posexplode(F.arrays_zip("sizes", "before")).alias("chunk", "z")).select(id_col, "chunk", F.col("z.sizes").alias("tokens"), F.col("z.before").alias("offset"))


def decode(tokens: DataFrame, vocab: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """id and bytes of each row's token ids; an id outside the vocabulary gives the bytes of U+FFFD, null gives null.

    vocab: token_id and bytes, at most MOST_TOKENS rows, which every task gets.
    """
    known = {r.token_id: bytes(r.bytes) for r in vocab.select("token_id", "bytes").collect()}
    # the last entry stands for unknown ids
    values = [known.get(k, REPLACEMENT) for k in range(max(known, default=-1) + 1)] + [REPLACEMENT]
    sizes = np.array([len(v) for v in values], np.int64)
    begins, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), np.uint8)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for lists in batches for part in slices(lists)):
            ids = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < len(values) - 1), ids, len(values) - 1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
            offsets = np.r_[0, np.r_[0, np.cumsum(sizes[ids])][ends]].astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked(pool, begins[ids], sizes[ids]).tobytes())])
            yield pc.if_else(part.is_valid(), body, pa.scalar(None, pa.binary()))

    return tokens.select(id_col, run(tokens_col).alias("bytes"))


def decode_bytes(ids: list[int], merges: list[Merge]) -> bytes:
    """Bytes of a few ids, for tests and single texts."""
    table = token_bytes(merges)
    return b"".join(table[i] if 0 <= i < len(table) else REPLACEMENT for i in ids)
