"""A corpus as one sequence of bytes: pieces at global places, chunks, token offsets, and merges across pieces.

Texts stand one after the other in order of their ids, an empty line between them. Pieces have
the same number of bytes, whatever texts they belong to, and go to different tasks. Running
sums and neighbours over all pieces come from two levels: within blocks of BLOCK pieces, and
over one row for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.operators.batches import Trie, batch_slices, binaries, pair_keys, summed
from mergeloom.operators.encoding import chunk_size
from mergeloom.operators.training import Merge, safe_prefix
from mergeloom.sources.corpus import SEPARATOR
from mergeloom.sources.storage import Scratch

BLOCK = 4096
#: Bytes that a task takes up at a time, those of a stored row, and those of texts that are sorted together.
ROOM, ROW, SORTED = 1 << 20, 1 << 17, 32 << 20

PIECES = pa.schema([("piece", pa.int64()), ("bytes", pa.binary())])
#: A piece's number in order, tokens before it in its stretch (the whole pieces that a task found in a row, named by the first), its own, those of its chunks, and their ids of so many bytes.
ENCODED = pa.schema([("piece", pa.int64()), ("stretch", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("sizes", pa.list_(pa.int32())), ("width", pa.int32()), ("ids", pa.binary())])
#: A piece's symbols (see symbol_type), first and last, their number, and how many equal ones end it; or, without a piece, how often a task found a pair.
STATE = pa.schema([("piece", pa.int64()), ("symbols", pa.binary()), *[(c, pa.int32()) for c in ("first", "last", "n", "trail")], ("pair", pa.int64()), ("count", pa.int64())])
SPARK_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>"}


def spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK_TYPES[f.type]}" for f in schema)


def filled(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of rows with these columns, the others null."""
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def beside_pieces(side: DataFrame, row_bytes: int = 64, limit_bytes: int = 8 << 20) -> DataFrame:
    """A stored table with a row for each piece or fewer, marked for broadcast while it is small, so that the pieces themselves stay where they are; beyond that the join shuffles."""
    return F.broadcast(side) if side.count() * row_bytes <= limit_bytes else side


def sums_before(rows: DataFrame, order_col: str, value: str, out_col: str, scratch: Scratch) -> DataFrame:
    """rows with the sum of `value` over all rows before in order of order_col, a number that few rows share a BLOCK of."""
    block = F.floor(F.col(order_col) / BLOCK)
    rows = rows.withColumn("block", block)
    totals = rows.groupBy("block").agg(F.sum(value).alias("total"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = scratch.store(totals.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start")), "block-starts")
    own = Window.partitionBy("block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return within.join(starts, "block").withColumn(out_col, F.col("start") + F.col("within")).drop("block", "start", "within")


def placed_bytes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, separator: str = SEPARATOR) -> tuple[DataFrame, int]:
    """place (of the first byte) and bytes of the sequence in rows of about ROW bytes, whatever texts they belong to, and its number of bytes.

    Texts are sorted by id, then by their own order, each followed by the separator; null ones are left out. The last
    separator is no part of the sequence, though of the rows. Texts are shuffled once; a task counts its bytes as it joins them.
    """
    mark = separator.encode()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes"))
    whole = texts.agg(F.sum(F.octet_length("bytes").cast("bigint") + len(mark)).alias("n")).first().n or 0

    def joined(batches):
        part, within, held, room = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for value in batch.column(0):
                for body in (memoryview(value.as_buffer()), memoryview(mark)):
                    for a in range(0, len(body), ROW):
                        held.append(body[a : a + ROW])
                        room += len(held[-1])
                        if room >= ROW:
                            yield row(part, within, held)
                            within, held, room = within + room, [], 0
        if held:
            yield row(part, within, held)

    def row(part: int, within: int, held: list) -> pa.RecordBatch:
        value = b"".join(held)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "within": pa.array([within], pa.int64()), "size": pa.array([len(value)], pa.int64()), "bytes": [value]})

    number = max(docs.sparkSession.sparkContext.defaultParallelism, -(-whole // SORTED))
    # the first bytes only: the bounds of ranges come from a sample that the driver holds
    ranged = texts.repartitionByRange(number, "id", F.substring("bytes", 1, 32)).sortWithinPartitions("id", "bytes")
    rows = scratch.store(ranged.select("bytes").mapInArrow(joined, "part bigint, within bigint, size bigint, bytes binary"), "ordered-bytes")
    totals = rows.groupBy("part").agg(F.sum("size").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = scratch.store(totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start")), "part-starts")
    return rows.join(F.broadcast(starts), "part").select((F.col("start") + F.col("within")).alias("place"), "bytes"), max(0, whole - len(mark))


def cut_pieces(batches: Iterator[pa.RecordBatch], size: int, total: int) -> Iterator[tuple[list[int], list[int] | None, list[bytes]]]:
    """Numbers, places and bytes of what rows of bytes (place, bytes) hold of each piece, about ROOM bytes at a time; places of None: pieces that are whole.

    Rows that follow each other are read on, so that of a stretch of the sequence only the first and the last piece are not whole.
    """
    whole: tuple[list, list, list] = ([], [], [])
    loose: tuple[list, list, list] = ([], [], [])
    held: list = []  # of the piece begun at `start`
    start, end, room = 0, -1, 0

    def close() -> None:
        piece, at = divmod(start, size)
        value = b"".join(held)
        for column, x in zip(whole if len(value) == size else loose, (piece, at, value), strict=True):
            column.append(x)
        held.clear()

    for batch in batches:
        for place, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = memoryview(value.as_buffer())[: max(0, total - place)]
            if held and place != end:
                close()
            a, end = 0, place + len(body)
            while a < len(body):
                if not held:
                    start = place + a
                upto = min(len(body), a + size - (place + a) % size)
                held.append(body[a:upto])
                room += upto - a
                a = upto
                if (place + a) % size == 0:
                    close()
                if room >= ROOM:
                    for pieces, places, parts in (whole, loose):
                        if pieces:
                            yield pieces, None if pieces is whole[0] else places, parts
                    whole, loose, room = ([], [], []), ([], [], []), 0
    if held:
        close()
    for pieces, places, parts in (whole, loose):
        if pieces:
            yield pieces, None if pieces is whole[0] else places, parts


class Identity:
    """What over_pieces asks of the work of a task: batches of `schema` for some pieces (numbers and bytes), and what is left when all were given."""

    schema = PIECES

    def step(self, pieces: list[int], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield filled(self.schema, len(pieces), piece=pa.array(pieces, pa.int64()), bytes=pa.array(parts, pa.binary()))

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def over_pieces(docs: DataFrame, id_col: str, text_col: str, work: Callable[[], Identity], schema: pa.Schema, *, size: int, scratch: Scratch, name: str, **options: str) -> DataFrame:
    """The sequence cut at multiples of `size` bytes and given to the work of each task, stored under name and name-seams with options of the writer.

    Tasks cut what they read and work on it at once. Only pieces over the border of what two tasks read are
    put together by a shuffle: some for each file.
    """
    rows, total = placed_bytes(docs, id_col, text_col, scratch)
    wide = schema.append(pa.field("at", pa.int64())).append(pa.field("loose", pa.binary()))

    def cut(batches):
        own = work()
        for pieces, places, parts in cut_pieces(batches, size, total):
            if places is None:
                for batch in own.step(pieces, parts):
                    yield filled(wide, len(batch), **dict(zip(schema.names, batch.columns, strict=True)))
            else:
                yield filled(wide, len(pieces), piece=pa.array(pieces, pa.int64()), at=pa.array(places, pa.int64()), loose=pa.array(parts, pa.binary()))
        for batch in own.rest():
            yield filled(wide, len(batch), **dict(zip(schema.names, batch.columns, strict=True)))

    def seams(batches):
        own = work()
        for batch in batch_slices(batches, 1):
            yield from own.step(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from own.rest()

    stored = scratch.store(rows.mapInArrow(cut, spark_schema(wide)), name, **options)
    scratch.drop("ordered-bytes", "part-starts")
    parts = stored.where("loose IS NOT NULL").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "loose"))).alias("parts"))  # at most `size` bytes
    joined = parts.select("piece", F.array_join(F.col("parts.loose").cast("array<string>"), "").cast("binary").alias("bytes"))  # bytes as they are
    mended = scratch.store(joined.mapInArrow(seams, spark_schema(schema)), f"{name}-seams", **options)
    return stored.where("loose IS NULL").select(*schema.names).unionByName(mended)


def corpus_pieces(docs: DataFrame, id_col: str, text_col: str = "text", *, size: int = 1 << 16, scratch: Scratch) -> DataFrame:
    """piece and bytes: the sequence cut at multiples of `size` bytes."""
    return over_pieces(docs, id_col, text_col, Identity, PIECES, size=size, scratch=scratch, name="pieces")


class Encoding:
    """The work of encode_corpus."""

    schema = ENCODED

    def __init__(self, trie: Trie, step: int, tokens: int):
        self.trie, self.chunk, self.type = trie, step, np.dtype(symbol_type(tokens))
        self.stretch, self.following, self.before = -1, -1, 0

    def step(self, pieces: list[int], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
        ids, chunks, rows = self.trie.encode(np.frombuffer(b"".join(parts), np.uint8), offsets, self.chunk)
        tokens, places = np.diff(chunks[rows]), []
        for piece, n in zip(pieces, tokens.tolist(), strict=True):
            if piece != self.following:
                self.stretch, self.before = piece, 0
            places.append((self.stretch, self.before))
            self.following, self.before = piece + 1, self.before + n
        stretch, before = zip(*places, strict=True)
        yield filled(
            self.schema, len(pieces), piece=pa.array(pieces, pa.int64()), stretch=pa.array(stretch, pa.int64()), before=pa.array(before, pa.int64()), tokens=pa.array(tokens, pa.int64()),
            sizes=pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(np.diff(chunks), pa.int32())), width=pa.array(np.full(len(pieces), self.type.itemsize), pa.int32()), ids=binaries(ids.astype(self.type), chunks[rows]),
        )

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def encode_corpus(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str = "text", *, size: int | None = None, chunks_in_piece: int = 32, scratch: Scratch) -> DataFrame:
    """piece, chunk (the piece's first), offset (tokens before the piece), tokens (their number), sizes (those of each chunk) and ids (each of `width` bytes, lowest first) by longest match in chunks of the whole sequence.

    Chunks are cut at multiples of `size` bytes of the sequence and run from one text into the next.
    """
    step = size or chunk_size(max(map(len, vocabulary), default=1) or 1)
    trie = docs.sparkSession.sparkContext.broadcast(Trie(vocabulary))
    encoded = over_pieces(docs, id_col, text_col, lambda: Encoding(trie.value, step, max(256, len(vocabulary))), ENCODED, size=step * chunks_in_piece, scratch=scratch, name="encoded", compression="zstd")
    counts = encoded.groupBy("stretch").agg(F.sum("tokens").alias("n"))
    starts = scratch.store(sums_before(counts, "stretch", "n", "stretch_start", scratch).select("stretch", "stretch_start"), "offsets")
    offset = (F.col("stretch_start") + F.col("before")).alias("offset")
    return encoded.join(beside_pieces(starts), "stretch").select("piece", (F.col("piece") * chunks_in_piece).alias("chunk"), offset, "tokens", "sizes", "width", "ids")


def corpus_chunks(encoded: DataFrame) -> DataFrame:
    """chunk, tokens and offset of every chunk of an encoded corpus."""
    each = encoded.select("chunk", "offset", F.posexplode("sizes").alias("k", "tokens"), "sizes")  # the ids are not read
    before = F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0).cast("bigint"), lambda n, x: n + x)
    return each.select((F.col("chunk") + F.col("k")).alias("chunk"), F.col("tokens").cast("bigint").alias("tokens"), (F.col("offset") + before).alias("offset"))


# ── merges over the whole sequence, without words ──────────────────────────────────────────


def _run_lengths(rows: DataFrame, place: str, within: list[str]) -> DataFrame:
    """rows (first, last, trail, whole) in order of `place` with prior (last symbol of the row before), run (which run of

    equal symbols over several rows the row's end belongs to, from 1) and upto (the run's length up to there).
    """
    own = Window.partitionBy(*within).orderBy(place)
    rows = rows.withColumn("prior", F.lag("last").over(own))
    begins = F.col("prior").isNull() | ~F.col("whole") | (F.col("first") != F.col("prior"))
    rows = rows.withColumn("run", F.sum(begins.cast("int")).over(own))
    return rows.withColumn("upto", F.sum("trail").over(Window.partitionBy(*within, "run").orderBy(place)))


def _with_neighbours(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """piece, first, last, prior (last symbol before the piece), following (first symbol after it) and odd: whether the run

    of equal symbols that ends before the piece has an odd length. No piece is empty.
    """
    edges = _run_lengths(edges.withColumns({"block": F.floor(F.col("piece") / BLOCK), "whole": F.col("trail") == F.col("n")}), "piece", ["block"])
    ends = edges.groupBy("block").agg(
        F.min_by("first", "piece").alias("first"), F.max_by("last", "piece").alias("last"), F.max_by("upto", "piece").alias("trail"),
        (F.min_by("whole", "piece") & (F.max("run") == 1)).alias("whole"),
    )
    order = Window.partitionBy("all").orderBy("block")  # a row for each block
    blocks = _run_lengths(ends.withColumn("all", F.lit(0)), "block", ["all"])
    around = blocks.select("block", F.col("prior").alias("block_prior"), F.lead("first").over(order).alias("block_following"), F.coalesce(F.lag("upto").over(order) % 2 == 1, F.lit(False)).alias("block_odd"))
    own = Window.partitionBy("block").orderBy("piece")
    joined = edges.join(scratch.store(around, "blocks"), "block")
    goes_on = F.col("whole") & (F.col("run") == 1) & (F.col("first") == F.col("block_prior"))  # from the block before
    joined = joined.withColumn("odd", (F.col("upto") % 2 == 1) != (F.coalesce(goes_on, F.lit(False)) & F.col("block_odd")))
    return joined.select(
        "piece", "first", "last", F.coalesce("prior", "block_prior").alias("prior"), F.coalesce(F.lead("first").over(own), "block_following").alias("following"),
        F.coalesce(F.lag("odd").over(own), "block_odd").alias("odd"),
    )


def edges_of(ids: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """first and last symbol, number of symbols (n), and length of the run of equal symbols at the end (trail) of rows of symbols, none of them empty."""
    last, trail = ids[at[1:] - 1], []
    for a, b, symbol in zip(at[:-1].tolist(), at[1:].tolist(), last.tolist(), strict=True):
        back = 16
        while not len(other := np.flatnonzero(ids[max(a, b - back) : b] != symbol)) and back < b - a:
            back *= 16
        trail.append(min(back, b - a) - 1 - int(other[-1]) if len(other) else b - a)
    return {"first": pa.array(ids[at[:-1]].astype(np.int32)), "last": pa.array(last.astype(np.int32)), "n": pa.array(np.diff(at), pa.int32()), "trail": pa.array(trail, pa.int32())}


def _edges(state: DataFrame) -> DataFrame:
    """piece, first and last symbol, number of symbols, and length of the run of equal symbols at the end, of pieces with lists of ids."""

    def ends(batches):
        for batch in batch_slices(batches, 1):
            lists = batch.column(1)
            found = edges_of(lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.values()], ["piece", *found])

    return state.mapInArrow(ends, "piece bigint, first int, last int, n int, trail int")


def symbol_type(symbols: int) -> str:
    """How symbols below that number are stored: in one byte, two or four."""
    return "<u1" if symbols <= 1 << 8 else "<u2" if symbols <= 1 << 16 else "<u4"


class PairCounts:
    """How often pairs (a * 2**16 + b) stand in rows of symbols below `symbols`, those with symbol 0 left out."""

    def __init__(self, symbols: int, most: int = 1 << 20):
        self.symbols, self.most = symbols, most
        self.table = np.zeros(symbols * symbols, np.int64) if symbols * symbols <= most else None
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, at: np.ndarray) -> None:
        if self.table is None:
            pairs, _ = pair_keys(ids, at)
            pairs, counts = summed(pairs, np.ones(len(pairs), np.int64))
            self.pairs, self.counts = summed(np.r_[self.pairs, pairs], np.r_[self.counts, counts])
            return
        wide = ids.astype(np.int64)
        keys = wide[:-1] * self.symbols + wide[1:]
        self.table += np.bincount(keys, minlength=len(self.table))
        np.subtract.at(self.table, keys[at[1:-1] - 1], 1)  # from one row to the next

    def full(self) -> bool:
        return len(self.pairs) >= self.most

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and counts so far; counting begins anew."""
        if self.table is not None:
            square = self.table.reshape(self.symbols, self.symbols)
            square[0, :] = square[:, 0] = 0
            found = np.flatnonzero(self.table)
            self.pairs, self.counts = ((found // self.symbols) << 16) + found % self.symbols, self.table[found]
            self.table[:] = 0
        out = self.pairs, self.counts
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


class Measuring:
    """The work of train_sequence: pieces with their edges, and the pairs inside them counted over a task."""

    schema = STATE

    def __init__(self, symbols: int = 256):
        self.type, self.counts = symbol_type(symbols), PairCounts(symbols)

    def step(self, pieces: list[int], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield from self.rows(pieces, [np.frombuffer(p, np.uint8) for p in parts])

    def rows(self, pieces: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not pieces:
            return
        ids, at = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        self.counts.add(ids, at)
        yield filled(self.schema, len(pieces), piece=pa.array(pieces, pa.int64()), symbols=binaries(ids.astype(self.type), at), **edges_of(ids, at))
        if self.counts.full():
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        pairs, counts = self.counts.taken()
        for a in range(0, len(pairs), 1 << 16):
            yield filled(self.schema, len(pairs[a : a + (1 << 16)]), pair=pa.array(pairs[a : a + (1 << 16)]), count=pa.array(counts[a : a + (1 << 16)]))


def _sequence_pairs(state: DataFrame, around: DataFrame) -> DataFrame:
    """pair (a * 2**16 + b) and count over the sequence: those inside pieces and those over their borders."""
    inside = state.where("pair IS NOT NULL").select("pair", F.col("count").alias("n"))
    border = around.where("prior > 0 AND first > 0").select((F.col("prior").cast("bigint") * 65536 + F.col("first")).alias("pair"), F.lit(1).cast("bigint").alias("n"))
    return inside.unionByName(border).groupBy("pair").agg(F.sum("n").alias("count"))


class Replacing:
    """Merges that share no symbol, as safe_prefix gives them, in one go over a row of symbols."""

    def __init__(self, merges: list[Merge], self_pair: str):
        self.pairs = {(m.a, m.b): m.new_id for m in merges}
        self.collapse, self.equal = self_pair == "collapse", any(m.a == m.b for m in merges)
        self.second, self.new = np.full(merges[-1].new_id + 1, -1, np.int32), np.zeros(merges[-1].new_id + 1, np.int32)
        for m in merges:
            self.second[m.a], self.new[m.a] = m.b, m.new_id

    def apply(self, ids: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(self.second[ids[:-1]] == ids[1:])
        if not len(places):
            return ids
        gone = places + 1
        if self.equal:  # a single pair of equal symbols: runs
            starts = np.r_[True, gone[:-1] != places[1:]]
            if self.collapse:
                places = places[starts]
            else:  # of a run every other pair, from its left end
                inside = np.arange(len(places)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
                places = places[inside % 2 == 0]
                gone = places + 1
        kept = np.ones(len(ids), bool)
        kept[gone] = False
        out = ids.copy()
        out[places] = self.new[ids[places]]
        return out[kept]

    def piece(self, ids: np.ndarray, prior: int | None, following: int | None, odd: bool | None) -> np.ndarray:
        """A piece after the merges, with the symbols beside it and whether the run before it is of odd length; empty where the symbol before takes all of it."""
        first, same = int(ids[0]), prior is not None and prior == int(ids[0])
        if (prior, first) in self.pairs and (not same or odd or self.collapse):
            # the symbol before takes what is in front
            ids = ids[1:] if not same or not self.collapse else ids[np.argmax(np.r_[ids != first, True]) :]
            if not len(ids):
                return ids
        last = int(ids[-1])
        out = self.apply(ids)
        if (last, following) in self.pairs and int(out[-1]) == last:
            out = out.copy()
            out[-1] = self.pairs[last, following]
        return out


def _rewritten(state: DataFrame, around: DataFrame, merges: list[Merge], self_pair: str, scratch: Scratch) -> DataFrame:
    """The sequence after merges that share no symbol, measured; pieces that end up empty are left out."""
    table = Replacing(merges, self_pair)
    symbols = merges[-1].new_id + 1
    before = symbol_type(merges[0].new_id)

    def run(batches):
        own = Measuring(symbols)
        for batch in batch_slices(batches, 1):
            sides = zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True)
            rows = [table.piece(np.frombuffer(value.as_buffer(), before).astype(own.type), *side) for value, side in zip(batch.column(1), sides, strict=True)]
            keep = [k for k, r in enumerate(rows) if len(r)]
            yield from own.rows(batch.column(0).take(pa.array(keep, pa.int64())).to_pylist(), [rows[k] for k in keep])
        yield from own.rest()

    # of the neighbours only those count that take part in a merge
    pairs = F.array(*[F.lit((m.a << 16) + m.b).cast("bigint") for m in merges])
    joins = lambda a, b: F.coalesce(F.array_contains(pairs, F.col(a).cast("bigint") * 65536 + F.col(b)), F.lit(False))
    touched = scratch.store(around.where(joins("prior", "first") | joins("last", "following")).select("piece", "prior", "following", "odd"), "touched")
    told = state.where("piece IS NOT NULL").select("piece", "symbols").join(beside_pieces(touched), "piece", "left").select("piece", "symbols", "prior", "following", "odd")
    return told.mapInArrow(run, spark_schema(STATE))


def train_sequence(docs: DataFrame, target: int, id_col: str, text_col: str = "text", *, size: int = 1 << 16, self_pair: str = "greedy", ranked: int = 256) -> list[Merge]:
    """Merges over the sequence itself, where pairs run across spaces, lines and texts, until the vocabulary has `target` tokens or no pair occurs twice.

    Each round goes through the sequence once: a task rewrites its pieces and counts the pairs of what comes out.
    """
    scratch = Scratch(docs.sparkSession, "sequence-training")
    state = over_pieces(docs, id_col, text_col, Measuring, STATE, size=size, scratch=scratch, name="sequence")
    merges: list[Merge] = []
    while 256 + len(merges) < target:
        edges = state.where("piece IS NOT NULL").select("piece", "first", "last", "n", "trail")
        around = scratch.store(_with_neighbours(edges, scratch), "around")
        rows = _sequence_pairs(state, around).orderBy(F.desc("count"), "pair").limit(ranked).collect()
        pairs = [(r.pair >> 16, r.pair & 0xFFFF, r["count"]) for r in rows]
        sure = pairs if len(pairs) < ranked else [p for p in pairs if p[2] > pairs[-1][2]] or pairs[:1]
        chosen = safe_prefix(sure, target - 256 - len(merges))
        if not chosen:
            break
        new = [Merge(a, b, 256 + len(merges) + k, n) for k, (a, b, n) in enumerate(chosen)]
        merges += new
        if 256 + len(merges) < target:
            state = scratch.replace(_rewritten(state, around, new, self_pair, scratch), "sequence")
        scratch.drop("sequence-seams", "around", "blocks", "touched")
    scratch.drop()
    return merges
