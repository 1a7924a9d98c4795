"""Similar vectors by an epsilon grid order join.

Vectors are scaled to length one, so a cosine bound is a bound on distance. They are
projected on the leading principal dimensions of all vectors, cut into grid cells as
wide as that distance, and sorted by label and cell into blocks. Two blocks are joined
only if their cells lie within one of each other in every leading dimension; a pair of
blocks is halved again and again, skipping intervals that are provably distant and counting
those that are provably all linked, down to small intervals whose cosines are computed in
double precision. Pairs of blocks are worked off in tiles of neighbouring blocks, so that a
block's vectors travel once for each tile and not for each pair.

Equal vectors of a label are one node with a weight. A pair of blocks yields for each
vector the number of links and a spanning forest of them, so dense groups do not yield
all their pairs.

Defined results for odd input
-----------------------------
* A vector that is null, zero, or holds null or non-finite components, or whose label is
  null, is linked with nothing; so are vectors of different lengths.
* Equal vectors, repeated rows among them, are linked with each other.
* Null ids are allowed and are never the least id unless all are null.
* An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.components import connected_components

#: Room for rounding between distances in the projection and exact cosines.
GUARD = 1e-6


def unit_rows(packed: list[bytes], size: int) -> np.ndarray:
    """Vectors from their bytes, in double precision, scaled to length one; by the largest component first, whose square always fits."""
    v = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), size)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def principal_axes(nodes: DataFrame, sizes: list[int], dimensions: int, rounds: int = 2) -> dict[int, np.ndarray]:
    """For each vector length axes near the leading ones of all nodes' second moments, by subspace iteration.

    A round sums v * (v . axes) over all nodes. Any axes give right results; good ones skip more.
    """
    axes = {n: np.linalg.qr(np.random.default_rng(n).normal(size=(n, min(n, 2 * dimensions))))[0] for n in sizes}

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            every, packed = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size in np.unique(every).tolist():
                v = unit_rows([packed[k] for k in np.flatnonzero(every == size).tolist()], size)
                sums[size] = sums.get(size, 0) + v.T @ (v @ shared.value[size])
        for size, x in sums.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "sums": pa.array([x.ravel().tolist()], pa.list_(pa.float64()))})

    for _ in range(rounds if sizes else 0):
        shared = nodes.sparkSession.sparkContext.broadcast(axes)
        rows = nodes.select("size", "vector").mapInArrow(products, "size int, sums array<double>")
        total = rows.select("size", F.posexplode("sums").alias("k", "x")).groupBy("size", "k").agg(F.sum("x").alias("x")).toPandas()  # some numbers for each component
        for size, group in total.groupby("size"):
            m = np.zeros(axes[int(size)].size)
            m[group["k"]] = group["x"]
            axes[int(size)] = np.linalg.qr(m.reshape(int(size), -1))[0]
    return {n: x[:, :dimensions].copy() for n, x in axes.items()}


class Block:
    """Sorted vectors with their cells; intervals of it know their cells' bounds."""

    def __init__(self, row: dict):
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        n = len(self.nodes)
        self.weights = np.frombuffer(row["weights"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.cells = np.frombuffer(row["cells"], np.int64).reshape(n, -1)


class Links:
    """Links between the nodes of two blocks (or within one), by number of neighbours and as a spanning forest."""

    def __init__(self, a: Block, b: Block):
        self.nodes = a.nodes if a is b else np.r_[a.nodes, b.nodes]
        self.weights = a.weights if a is b else np.r_[a.weights, b.weights]
        self.shift, self.within = (0 if a is b else len(a.nodes)), a is b
        self.counts = np.zeros(len(self.nodes), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Linked pairs, one node of either block."""
        j = j + self.shift
        if self.within:
            i, j = i[i < j], j[i < j]
        np.add.at(self.counts, i, self.weights[j])
        np.add.at(self.counts, j, self.weights[i])
        self.pairs.append((i, j))

    def add_all(self, u: slice, v: slice) -> None:
        """Every node of an interval linked with every one of another, or of the same one."""
        i, j = np.arange(u.start, u.stop), np.arange(v.start, v.stop) + self.shift
        if self.within and u == v:
            self.counts[i] += self.weights[i].sum() - self.weights[i]
        else:
            self.counts[i] += self.weights[j].sum()
            self.counts[j] += self.weights[i].sum()
            self.pairs.append((np.full(len(j), i[0]), j))
        self.pairs.append((np.full(len(i), i[0]), i))
        if not (self.within and u == v):
            self.pairs.append((i, np.full(len(i), j[0])))

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, number of links, and another node that it is connected with or itself."""
        least = np.arange(len(self.nodes))
        i, j = (np.concatenate([p[k] for p in self.pairs]) if self.pairs else np.zeros(0, np.int64) for k in (0, 1))
        while len(i):
            low = np.minimum(least[i], least[j])
            before = least.copy()
            np.minimum.at(least, least[i], low)
            np.minimum.at(least, least[j], low)
            least = least[least]
            if (before == least).all():
                break
        seen = np.flatnonzero(self.counts)
        return self.nodes[seen], self.counts[seen], self.nodes[least[seen]]


def join_intervals(a: Block, b: Block, u: slice, v: slice, least: float, leaf: int, links: Links) -> None:
    """Halve two intervals recursively; skip those with cells more than one apart in a dimension, count those linked throughout."""
    x, y = a.cells[u], b.cells[v]
    if (x.min(axis=0) > y.max(axis=0) + 1).any() or (y.min(axis=0) > x.max(axis=0) + 1).any():
        return
    spread = np.maximum(x.max(axis=0), y.max(axis=0)) - np.minimum(x.min(axis=0), y.min(axis=0))
    if (spread <= 1).all() and linked_throughout(a.vectors[u], b.vectors[v], least):
        links.add_all(u, v)
        return
    if len(x) <= leaf and len(y) <= leaf:
        i, j = np.nonzero(a.vectors[u] @ b.vectors[v].T >= least)
        links.add(i + u.start, j + v.start)
        return
    cut = lambda s: [slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)]
    for s in cut(u) if len(x) > leaf else [u]:
        for t in cut(v) if len(y) > leaf else [v]:
            if a is not b or s.start <= t.start:
                join_intervals(a, b, s, t, least, leaf, links)


def linked_throughout(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of unit vectors lie in balls so near that every pair must be linked."""
    centre_x, centre_y = x.mean(axis=0), y.mean(axis=0)
    reach = [np.sqrt(((s - c) ** 2).sum(axis=1).max()) for s, c in ((x, centre_x), (y, centre_y))]
    return bool(np.linalg.norm(centre_x - centre_y) + sum(reach) <= math.sqrt(2 - 2 * least) - GUARD)


def join_blocks(a: Block, b: Block, least: float, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted by node (weighted), and node pairs that span what the two blocks link, as Links.forest gives them."""
    links = Links(a, b)
    join_intervals(a, b, slice(0, len(a.nodes)), slice(0, len(b.nodes)), least, leaf, links)
    return links.forest()


def embedding_components(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    least_cosine: float = 0.98,
    dimensions: int = 4,
    block_rows: int = 512,
    leaf: int = 64,
    tile: int = 8,
) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    Linked are rows with equal labels and a cosine of at least least_cosine. tile: blocks
    on each side of a tile, which a task holds together.
    """
    scratch = Scratch(rows.sparkSession, "grid-order")
    width = math.sqrt(2 - 2 * least_cosine) + GUARD
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    listed = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & whole, F.lit(False))

    def pack(batches):
        for batch in batches:
            vectors = [None if not ok else np.asarray(v, np.float64).tobytes() for v, ok in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), pa.array(vectors, pa.binary())], ["id", "row", "label", "vector"])

    packed = listed.select("id", "label", "v", F.monotonically_increasing_id().alias("row"), fit.alias("fit")).mapInArrow(pack, "id bigint, row bigint, label string, vector binary")
    packed = scratch.store(packed, "vectors")
    # one node for equal vectors of a label
    nodes = packed.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = scratch.store(nodes.withColumn("size", (F.octet_length("vector") / 8).cast("int")), "nodes")
    sizes = [r.size for r in nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size").collect()]  # lengths of vectors
    axes = rows.sparkSession.sparkContext.broadcast(principal_axes(nodes, sizes, dimensions))  # as large as a few vectors

    def place(batches):
        for batch in batches:
            sizes, vectors = batch.column("size").to_numpy(), batch.column("vector").to_pylist()
            cells = np.zeros((batch.num_rows, dimensions), np.int64)
            units: list[bytes] = [b""] * batch.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                u = unit_rows([vectors[k] for k in at.tolist()], size)
                along = u @ axes.value[size]
                cells[at, : along.shape[1]] = np.floor(along / width).astype(np.int64)
                for k, x in zip(at.tolist(), u, strict=True):
                    units[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("size"), pa.array(cells.tolist(), pa.list_(pa.int64())), batch.column("node"), batch.column("weight"), pa.array(units, pa.binary())],
                ["label", "size", "cells", "node", "weight", "unit"],
            )

    placed = nodes.select("label", "size", "node", "weight", "vector").mapInArrow(place, "label string, size int, cells array<bigint>, node bigint, weight bigint, unit binary")
    total = nodes.count()
    parts = max(1, -(-total // (8 * block_rows)))
    ordered = placed.repartitionByRange(parts, "label", "size", "cells", "node").sortWithinPartitions("label", "size", "cells", "node")

    def cut(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            runs = [g for _, g in frame.groupby(["label", "size"], sort=False)]
            done = [r.iloc[k : k + block_rows] for r in runs[:-1] for k in range(0, len(r), block_rows)]
            last = runs[-1] if runs else frame
            full = len(last) // block_rows * block_rows
            done += [last.iloc[k : k + block_rows] for k in range(0, full, block_rows)]
            rest = last.iloc[full:]
            yield blocks(done)
        if rest is not None and len(rest):
            yield blocks([rest])

    def blocks(groups):
        made = []
        for g in groups:
            cells = np.array(g["cells"].tolist(), np.int64).reshape(len(g), dimensions)
            made.append(
                {
                    "label": g["label"].iloc[0], "size": int(g["size"].iloc[0]), "block": int(g["node"].iloc[0]), "low": cells.min(axis=0).tolist(), "high": cells.max(axis=0).tolist(),
                    "nodes": g["node"].to_numpy(np.int64).tobytes(), "weights": g["weight"].to_numpy(np.int64).tobytes(), "vectors": b"".join(g["unit"]), "cells": cells.tobytes(),
                }
            )
        return pd.DataFrame(made, columns=["label", "size", "block", "low", "high", "nodes", "weights", "vectors", "cells"])

    kinds = "label string, size int, block bigint, low array<bigint>, high array<bigint>, nodes binary, weights binary, vectors binary, cells binary"
    stored = scratch.store(ordered.mapInPandas(cut, kinds), "blocks")
    # candidate pairs of blocks share a cell, or have neighbouring ones, in the first dimension
    bounds = stored.select("label", "size", "block", "low", "high")
    one = bounds.select("label", "size", F.explode(F.expr("sequence(low[0], high[0])")).alias("cell"), F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    two = bounds.select("label", "size", F.explode(F.expr("sequence(low[0] - 1, high[0] + 1)")).alias("cell"), F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    near = F.forall(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: (F.get("low_a", k) <= F.get("high_b", k) + 1) & (F.get("low_b", k) <= F.get("high_a", k) + 1))
    pairs = one.join(two, ["label", "size", "cell"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # tiles: blocks in the order of their partition, `tile` to a group; a pair belongs to the tile of its two groups
    groups = bounds.select("block", "label", "size", "low").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("label", "size", "low", "block"))
    groups = scratch.store(groups.select("block", F.concat_ws("-", "part", F.floor((place - 1) / tile)).alias("tile_group")), "tile-groups")
    side = with_small_side(groups, groups.count(), 40)
    of = lambda x: side.select(F.col("block").alias(x), F.col("tile_group").alias(f"group_{x}"))
    pairs = scratch.store(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.concat_ws("/", "group_a", "group_b").alias("tile")), "block-pairs")
    content = stored.select("block", "nodes", "weights", "vectors", "cells")
    needed = pairs.select("tile", F.explode(F.array("a", "b")).alias("block")).distinct()
    listed_pairs = scratch.store(pairs.groupBy("tile").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "tile-pairs")  # tile * tile at most in a row

    def link(key: tuple, blocks: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        held = {int(r["block"]): Block(r) for r in blocks.to_dict("records")}
        found = [join_blocks(held[p["a"]], held[p["b"]], least_cosine, leaf) for p in listed["pairs"].iloc[0]]
        node, n, other = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"node": node, "n": n, "other": other})

    shipped = needed.join(content, "block").groupBy("tile")
    links = shipped.cogroup(listed_pairs.groupBy("tile")).applyInPandas(link, "node bigint, n bigint, other bigint")
    links = scratch.store(links, "links")
    scratch.drop("blocks", "tile-groups", "block-pairs", "tile-pairs")
    components = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    counted = links.groupBy("node").agg(F.sum("n").alias("n"))
    owner = nodes.select("label", "vector", "node", "weight").join(counted, "node", "left").join(components, "node", "left")
    owner = owner.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    owner = scratch.store(owner, "owners")
    owned = packed.join(owner, ["label", "vector"], "left").select("id", "row", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "row").alias("component"))
    owned = scratch.store(owned, "owned")
    scratch.drop("vectors", "nodes", "links", "components", "owners")
    best = owned.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    best = scratch.store(best.select("component", F.col("best.id").alias("component_id"), F.col("best.row").alias("kept_row")), "best")
    return owned.join(best, "component").select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
