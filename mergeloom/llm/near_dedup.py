"""Near-duplicate documents: MinHash, banding, verification, connected components.

Texts with equal shingle sets are one node, represented by their first row. Nodes that
agree in all minima of a band share a bucket. A bucket never yields its pairs. Its centre,
the row that meets most others, is compared with each of them on the full sets, and every
row is then known by its *difference* from the centre: the shingles in one of the two sets
only. Rows linked with the centre are one component. What is left are pairs of which one
row at least is not linked with the centre; for these

    |x - y| = |dx| + |dy| - 2 * common(dx, dy)       (- the symmetric difference)

so x and y are linked when their differences dx and dy share enough elements. That is an
overlap join with a threshold of its own for each pair, done exactly with an inverted
index: elements in order of rarity within the centre's rows, only so many of the rarest
ones of each row as a partner must share one of, and by their places a bound on what
the rest can still add. The pairs it leaves are counted on their whole differences.

Defined results for odd input
-----------------------------
* A null or empty text, or one of white space, has no shingles and is linked with nothing.
* A text of fewer words than a shingle has its whole sequence as its only shingle.
* Repeated rows are copies of each other; of a component the row with the smallest id
  (then the first such row) is kept. A null id is never the smallest unless all are null.
* Texts of any length are read whole; an empty table gives an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.components import connected_components
from mergeloom.llm.words import find_words, hash_words, minima, mixed, row_slices, shingles

SKETCH = "id bigint, row bigint, text_key bigint, n bigint, d0 bigint, d1 bigint, bands array<bigint>"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, text by text, and how many each text has."""
    words = find_words(texts)
    values, counts = shingles(hash_words(words), words.counts, size)
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.bincount(text[new], minlength=len(counts))


def set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's shingle set."""
    sums = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
            ends = np.r_[np.uint64(0), np.cumsum(mixed(values ^ salt), dtype=np.uint64)]
            at = np.r_[0, np.cumsum(counts)]
            sums.append((ends[at[1:]] - ends[at[:-1]]).view(np.int64))
    return sums[0], sums[1]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key (a hash of id and text, by which a text is found again) and text as bytes."""
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(id_.alias("id"), F.xxhash64(id_, text).alias("text_key"), text.cast("binary").alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, band_rows: int) -> DataFrame:
    """A row of SKETCH for each row of docs; bands: a hash of each band's minima."""

    def sketch(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(3), 1 << 20):
                part = batch.slice(a, b - a)
                values, counts = shingle_sets(part.column(3), size)
                least = minima(values.astype(np.uint32), counts, bands * band_rows)
                with np.errstate(over="ignore"):
                    keys = np.full((len(counts), bands), 0, np.uint64) + np.arange(bands, dtype=np.uint64)
                    for k in range(band_rows):
                        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k::band_rows])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(counts.astype(np.int64)), *[pa.array(d) for d in set_digests(values, counts)], lists],
                    ["id", "row", "text_key", "n", "d0", "d1", "bands"],
                )

    rows = keyed_texts(docs, id_col, text_col).select("id", F.monotonically_increasing_id().alias("row"), "text_key", "text")
    return rows.mapInArrow(sketch, SKETCH)


def fetch_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """row, n and shingle set (binary, sorted 64-bit hashes) of the wanted rows (row, text_key, d0, d1).

    A row repeated with its id has one text_key; the set's digests tell texts apart that share one by chance.
    """

    def sets(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(3), 1 << 20):
                part = batch.slice(a, b - a)
                values, counts = shingle_sets(part.column(3), size)
                d0, d1 = set_digests(values, counts)
                keep = np.flatnonzero((d0 == part.column(1).to_numpy()) & (d1 == part.column(2).to_numpy()))
                at = np.r_[0, np.cumsum(counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep)), pa.array(counts[keep].astype(np.int64)), pa.array([values[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())],
                    ["row", "n", "set"],
                )

    texts = keyed_texts(docs, id_col, text_col).select("text_key", "text")
    found = texts.join(with_small_side(wanted, n_wanted, 40), "text_key").select("row", "d0", "d1", "text")
    return found.mapInArrow(sets, "row bigint, n bigint, set binary").dropDuplicates(["row"])


def bucket_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (c, x): c is the centre of a bucket that holds x. nodes: row and bands."""
    banded = nodes.select("row", F.explode("bands").alias("band"))
    shared = scratch.store(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
    members = scratch.store(banded.join(with_small_side(shared, shared.count(), 24), "band"), "members")
    standing = members.groupBy("row").agg(F.sum("size").alias("standing"))
    centre = F.max(F.struct("standing", (-F.col("row")).alias("neg"))).alias("top")
    centres = scratch.store(members.join(standing, "row").groupBy("band").agg(centre).select("band", (-F.col("top.neg")).alias("c")), "centres")
    pairs = members.join(with_small_side(centres, centres.count(), 24), "band").where("row != c").select("c", F.col("row").alias("x")).distinct()
    pairs = scratch.store(pairs, "pairs")
    scratch.drop("shared-bands", "members", "centres")
    return pairs


def differences(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """For each pair (c, x) sizes n_c, n_x, the difference of their sets, its size d, and whether they are linked."""

    def differ(batches):
        for batch in batches:
            out, d = [], []
            for left, right in zip(batch.column(4), batch.column(5), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                out.append(np.setxor1d(u, v, assume_unique=True))
                d.append(len(out[-1]))
            d = np.array(d, np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(d)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(d), pa.array((100 - percent) * total >= (100 + percent) * d), lists], ["c", "x", "n_c", "n_x", "d", "linked", "difference"]
            )

    of_x = sets.join(with_small_side(pairs, n_pairs, 24), F.col("row") == F.col("x")).select("c", "x", F.col("n").alias("n_x"), F.col("set").alias("set_x"))
    of_c = sets.select(F.col("row").alias("c"), F.col("n").alias("n_c"), F.col("set").alias("set_c"))
    both = of_x.join(of_c, "c").select("c", "x", "n_c", "n_x", "set_c", "set_x")
    return both.mapInArrow(differ, "c bigint, x bigint, n_c bigint, n_x bigint, d bigint, linked boolean, difference array<bigint>")


def least_common(weight: Column, percent: int) -> Column:
    """How many elements two differences must share, given the sum of the pair's weights (see weigh)."""
    return F.ceil(weight / (2.0 * (100 + percent)) - 1e-9)


def weigh(rows: DataFrame, percent: int) -> DataFrame:
    """rows of differences with weight, and reach: how many of its rarest elements a row must show.

    x and y are linked when they share (weight_x + weight_y) / 2 / (100 + percent) elements.
    reach follows from the least such sum over all possible partners: no weight is under
    -(100 - percent) * n_c, that of a row not linked with the centre is above its opposite,
    and a partner's difference has to have as many elements as must be shared.
    """
    p, q = 100 + percent, 100 - percent
    rows = rows.withColumn("weight", p * F.col("d") - q * F.col("n_x"))
    by_centre = least_common(F.col("weight") + F.when(F.col("linked"), q * F.col("n_c")).otherwise(-q * F.col("n_c")), percent)
    by_size = F.ceil((F.col("weight") - q * F.col("n_x") * (100.0 / percent)) / p - 1e-9)
    return rows.withColumn("reach", F.col("d") - F.greatest(by_centre, by_size, F.lit(1)) + 1).where("reach > 0")


def candidate_pairs(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (c, x, y) of rows of one centre and different owners that may be linked.

    rows: those of differences with their owner; no linked pair is left out.
    """
    rows = weigh(rows, percent)
    elements = rows.select("c", "x", "owner", "linked", "d", "weight", "reach", F.explode("difference").alias("element"))
    # an element of one row only finds no partner; it comes before all others
    common = scratch.store(elements.groupBy("c", "element").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "common-elements")
    own = Window.partitionBy("c", "x")
    rank = F.row_number().over(own.orderBy("rows", "element")) - 1
    placed = elements.join(with_small_side(common, common.count(), 32), ["c", "element"]).withColumns({"rank": rank, "several": F.count(F.lit(1)).over(own)})
    placed = placed.withColumn("place", F.col("d") - F.col("several") + F.col("rank")).where("place < reach")
    index = scratch.store(placed.select("c", "element", "x", "owner", "linked", "weight", (F.col("d") - F.col("place")).alias("room")), "element-index")
    one = index.select("c", "element", *[F.col(k).alias(f"{k}_1") for k in ("x", "owner", "linked", "weight", "room")])
    two = index.select("c", "element", *[F.col(k).alias(f"{k}_2") for k in ("x", "owner", "linked", "weight", "room")])
    apart = (F.col("x_1") < F.col("x_2")) & (F.col("owner_1") != F.col("owner_2")) & ~(F.col("linked_1") & F.col("linked_2"))
    apart = apart & (F.least("room_1", "room_2") >= least_common(F.col("weight_1") + F.col("weight_2"), percent))
    pairs = one.join(two, ["c", "element"]).where(apart).select("c", F.col("x_1").alias("x"), F.col("x_2").alias("y")).distinct()
    pairs = scratch.store(pairs, "candidates")
    scratch.drop("common-elements", "element-index")
    return pairs


def linked_pairs(pairs: DataFrame, n_pairs: int, rows: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (c, x, y) that are linked, by their whole differences from c, as (a, b)."""

    def compare(batches):
        for batch in batches:
            keep = []
            for total, left, right in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                u, v = left.values.to_numpy(), right.values.to_numpy()
                apart = len(u) + len(v) - 2 * len(np.intersect1d(u, v, assume_unique=True))
                keep.append((100 - percent) * total >= (100 + percent) * apart)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = rows.select("c", "x", F.col("n_x").alias("n_1"), F.col("difference").alias("first"))
    two = rows.select("c", F.col("x").alias("y"), F.col("n_x").alias("n_2"), F.col("difference").alias("second"))
    half = one.join(with_small_side(pairs, n_pairs, 32), ["c", "x"])
    both = half.join(two, ["c", "y"]).select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("n_1") + F.col("n_2")).alias("total"), "first", "second")
    return both.mapInArrow(compare, "a bigint, b bigint")


def node_components(docs: DataFrame, rows: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """node and component of the nodes (row, bands) that are linked with others; None if none is. rows: all sketches."""
    pairs = bucket_pairs(nodes, scratch)
    n_pairs = pairs.count()
    if not n_pairs:
        return None
    ends = scratch.store(pairs.select(F.explode(F.array("c", "x")).alias("row")).distinct(), "ends")
    n_ends = ends.count()
    wanted = scratch.store(rows.select("row", "text_key", "d0", "d1").join(with_small_side(ends, n_ends, 16), "row", "left_semi"), "wanted")
    sets = scratch.store(fetch_sets(docs, wanted, n_ends, id_col, text_col, size), "sets")
    apart = scratch.store(differences(pairs, n_pairs, sets, percent), "differences")
    scratch.drop("ends", "wanted", "sets", "pairs")

    components = connected_components(apart.where("linked").select(F.col("c").alias("a"), F.col("x").alias("b")), scratch)
    side = with_small_side(components.select(F.col("node").alias("x"), "component"), components.count(), 24)
    owned = apart.join(side, "x", "left").withColumn("owner", F.coalesce("component", "x")).drop("component")
    several = owned.groupBy("c").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high").select("c")
    several = scratch.store(several, "open-centres")
    candidates = candidate_pairs(owned.join(with_small_side(several, several.count(), 16), "c", "left_semi"), percent, scratch)
    n_candidates = candidates.count()
    if n_candidates:
        found = scratch.store(linked_pairs(candidates, n_candidates, apart, percent), "found")
        if not found.isEmpty():
            components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), scratch)
    scratch.drop("differences", "open-centres", "candidates", "found")
    return components


def minhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 28,
    band_rows: int = 5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Linked are rows whose shingle sets have 100 * intersection >= percent * union.
    At a similarity of 0.85 a pair shares none of 28 bands of 5 minima with a
    probability of 7e-8 (at 0.80 of 1.5e-5); all else is exact.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.store(sketches(docs, id_col, text_col, shingle_words, bands, band_rows), "sketches")
    # of equal sets the first row stands for all
    same = ["d0", "d1", "n"]
    copies = scratch.store(rows.where("n > 0").groupBy(*same).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "copies")
    side = with_small_side(copies, copies.count(), 40)
    nodes = rows.where("n > 0").select("row", *same, "bands").join(side, same, "left").where("first IS NULL OR first = row").select("row", "bands")
    components = node_components(docs, rows, scratch.store(nodes, "nodes"), id_col, text_col, shingle_words, percent, scratch)
    scratch.drop("nodes")

    owned = rows.select("id", "row", *same).join(side, same, "left").withColumn("node", F.coalesce("first", "row"))
    if components is None:
        owned = owned.select("id", "row", "n", F.col("first").alias("component"))
    else:
        owned = owned.join(with_small_side(components, components.count(), 24), "node", "left").select("id", "row", "n", F.coalesce("component", "first").alias("component"))
    owned = scratch.store(owned, "owned")
    scratch.drop("sketches", "copies", "components")
    # least id, null last, then least row; rows without a component stand alone
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    best = owned.where("component IS NOT NULL").groupBy("component").agg(least).select("component", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"))
    best = scratch.store(best, "best")
    alone = F.col("best_row").isNull()
    return owned.join(with_small_side(best, best.count(), 32), "component", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
    )
