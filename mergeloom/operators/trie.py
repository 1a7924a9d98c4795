"""The vocabulary as a trie: nodes and edges in breadth-first order, and its binary form.

A node is a distinct prefix of a token; nodes are numbered by length, then by bytes,
which is breadth-first order with sorted children. A vocabulary has at most 65,536
tokens, so the global ranking is small.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the binary form: magic number, version, size of the header in bytes, "no token".
MAGIC, VERSION, HEADER, NONE = 0x54524945, 3, 28, 0xFFFFFFFF


def trie_nodes(vocab: DataFrame) -> DataFrame:
    """node_id, prefix (hexadecimal), first_child, num_children, token_id of a vocabulary (token_id, bytes).

    Of equal tokens the larger id counts, empty ones never; NONE marks a prefix that is no
    token. first_child is the number of the first child, or of the one that would follow.
    """
    tokens = vocab.select("token_id", F.hex("bytes").alias("h")).where("h != ''").groupBy("h").agg(F.max("token_id").alias("token_id"))
    n = (F.length("h") / 2).cast("int")
    prefixes = tokens.select(F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.substr("h", F.lit(1), k * 2))).alias("prefix")).distinct()
    parent = F.when(F.col("prefix") != "", F.expr("substr(prefix, 1, length(prefix) - 2)"))
    children = prefixes.select(parent.alias("prefix")).where("prefix IS NOT NULL").groupBy("prefix").agg(F.count(F.lit(1)).alias("num_children"))
    order = Window.orderBy(F.length("prefix"), "prefix")
    nodes = prefixes.join(children, "prefix", "left").join(tokens.withColumnRenamed("h", "prefix"), "prefix", "left")
    counted = nodes.select("prefix", F.coalesce("num_children", F.lit(0)).cast("int").alias("num_children"), F.coalesce(F.col("token_id").cast("bigint"), F.lit(NONE)).alias("token_id"))
    before = F.coalesce(F.sum("num_children").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select((F.row_number().over(order) - 1).alias("node_id"), "prefix", (before + 1).cast("int").alias("first_child"), "num_children", "token_id")


def trie_edges(nodes: DataFrame) -> DataFrame:
    """edge_id, symbol (byte) and target of each edge: node k is the target of edge k - 1."""
    last = F.conv(F.expr("right(prefix, 2)"), 16, 10).cast("int")
    return nodes.where("node_id > 0").select((F.col("node_id") - 1).alias("edge_id"), last.alias("symbol"), F.col("node_id").alias("target"))


def serialize(nodes: list[tuple[int, int, int]], edges: list[tuple[int, int]], longest: int, vocab_size: int) -> bytes:
    """The binary form: header, nodes (first child, children, token), edges (byte, target), little-endian."""
    head = struct.pack("<7I", MAGIC, VERSION, len(nodes), len(edges), longest, vocab_size, 0)
    return head + b"".join(struct.pack("<3I", *n) for n in nodes) + b"".join(struct.pack("<2I", *e) for e in edges)


def parse(blob: bytes) -> tuple[dict[str, int], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Header fields, nodes and edges of a binary trie of version 2 (16-bit fields) or 3."""
    if len(blob) < HEADER:
        raise ValueError("shorter than its header")
    magic, version, n, m, longest, size, flags = struct.unpack_from("<7I", blob)
    if magic != MAGIC or version not in (2, 3):
        raise ValueError("not a trie of version 2 or 3")
    node, edge = ("<3H2x", "<BxH") if version == 2 else ("<3I", "<B3xI")
    wanted = HEADER + n * struct.calcsize(node) + m * struct.calcsize(edge)
    if len(blob) < wanted:
        raise ValueError("cut short")
    at = HEADER + n * struct.calcsize(node)
    nodes = list(struct.iter_unpack(node, blob[HEADER:at]))
    edges = list(struct.iter_unpack(edge, blob[at:wanted]))
    if version == 2:
        nodes = [(a, b, NONE if t == 0xFFFF else t) for a, b, t in nodes]
    return {"version": version, "longest": longest, "vocab_size": size, "flags": flags}, nodes, edges


def trie_blob(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    """One row with the binary form of a vocabulary's trie."""
    nodes = trie_nodes(vocab)
    flat = nodes.orderBy("node_id").collect()  # bounded by the vocabulary
    edges = [(r.symbol, r.target) for r in trie_edges(nodes).orderBy("edge_id").collect()]
    longest = max((len(r.prefix) // 2 for r in flat), default=0)
    blob = serialize([(r.first_child, r.num_children, r.token_id) for r in flat], edges, longest, vocab.count())
    return spark.createDataFrame([(bytearray(blob),)], "trie binary")
