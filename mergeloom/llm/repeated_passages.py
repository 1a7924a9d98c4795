"""Passages that occur more than once, found by prefix-free parsing.

A rolling hash of eight bytes sets triggers: of any TRIGGER_WINDOW places in a row the one
with the least hash (the last of equal ones) is a trigger. Triggers cut a text into phrases. They depend on
what stands around them only, so equal strings of `length` bytes have their first trigger
at the same place: t bytes before it, the end of a phrase, and length - t after it, the beginning of the
phrases that follow (the parse). All strings between two triggers are one *record*: the
range of t, and the bytes they cover.

Corpus order of these strings is put together from two suffix orders: phrases from their ends
leftwards (dictionary), and what follows from a trigger on (parse). Strings with the same t are equal when
they agree in t bytes of the first and in length - t bytes of the second, so they are the
classes of both orders' common prefixes, combined. Only records that can matter are ordered:

* records whose parse begins (`length - TRIGGER_WINDOW + 1` bytes, its *head*) nowhere else are dropped by counting;
* records that occur twice as a whole repeat throughout, and one of them stands for all;
* the rest is ordered head by head, many heads in a task. A head with more than `most_records`
  different records is not held in one task: its strings are counted one by one instead.

Of each record the first and the last repeated string suffice, since a record's strings begin
less than `length` bytes apart and overlap.

Defined results for odd input
-----------------------------
* A null text is empty. Texts shorter than `length` bytes repeat nothing and lose nothing.
* Repeated rows and equal texts repeat each other whole; null ids are handled like any other.
* Cuts may fall inside a character; what is kept is returned as bytes.
* Texts of any length are read whole; an empty table gives an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.words import mixed, row_slices, text_bytes

#: Bytes that the rolling hash sees, and places in a row of which one is a trigger.
GRAM, TRIGGER_WINDOW = 8, 128
#: Places hashed at once; their numbers fit PLACE_BITS bits.
PLACES, PLACE_BITS = 1 << 22, 24
SPAN = "struct<start:bigint,length:bigint>"


def window_triggers(data: np.ndarray, most: int) -> np.ndarray:
    """For each place i < most the trigger among the TRIGGER_WINDOW places from i on."""
    n, width = most + TRIGGER_WINDOW - 1, TRIGGER_WINDOW
    grams = np.ndarray((n,), "<u8", data[: n + GRAM - 1].tobytes(), strides=(1,))
    last = np.uint64((1 << PLACE_BITS) - 1)
    keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (mixed(grams) & ~last) | (last - np.arange(n, dtype=np.uint64))
    blocks = keys.reshape(-1, width)  # least of a window: the end of one block and the beginning of the next
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:most], before[width - 1 : width - 1 + most])
    return (last - (least & last)).astype(np.int64)


def parse(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records of texts that stand one after the other: first and last start, trigger, and how many each text has.

    A string may start at any place of a text that has `length` bytes left.
    """
    starts, triggers = [], []
    for begin in range(0, max(0, len(data) - length + 1), PLACES):
        most = min(PLACES, len(data) - length + 1 - begin)
        trigger = window_triggers(data[begin : begin + most + TRIGGER_WINDOW + GRAM - 2], most) + begin
        new = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        starts.append(new + begin)
        triggers.append(trigger[new])
    ends, sizes = offsets[1:], np.diff(offsets)
    texts = np.flatnonzero(sizes >= length)
    if not len(texts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(sizes), np.int64)
    starts, triggers = np.concatenate(starts), np.concatenate(triggers)
    # a record also begins with each text, and ends with its last string
    lows, lasts = offsets[:-1][texts], ends[texts] - length
    cuts = np.unique(np.r_[starts, lows])
    owner = np.searchsorted(lows, cuts, "right") - 1
    inside = (owner >= 0) & (cuts <= lasts[np.maximum(owner, 0)])
    trigger = triggers[np.searchsorted(starts, cuts, "right") - 1]
    following = np.r_[cuts[1:], len(data)]
    first, owner, trigger = cuts[inside], owner[inside], trigger[inside]
    last = np.minimum(following[inside] - 1, lasts[owner])
    joined = np.r_[False, (trigger[1:] == trigger[:-1]) & (owner[1:] == owner[:-1])]  # one record over two stretches of places
    if joined.any():
        groups = np.flatnonzero(~joined)
        last = last[np.r_[groups[1:], len(first)] - 1]
        first, owner, trigger = first[groups], owner[groups], trigger[groups]
    counts = np.zeros(len(sizes), np.int64)
    counts[texts] = np.bincount(owner, minlength=len(texts))
    return first, last, trigger, counts


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (bytes, null as empty) and text_key, 128 bits of its SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    return rows.withColumn("text_key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def parsed_texts(keyed: DataFrame, length: int) -> DataFrame:
    """row (a number of its own), text_key, and heads and records of each text that has any.

    A head is known by 64 bits of a digest, a record by that and 96 more.
    """
    head = length - TRIGGER_WINDOW + 1

    def run(batches):
        number = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for batch in batches:
            for a, b in row_slices(batch.column(1), 1 << 20):
                data, offsets = text_bytes(batch.column(1).slice(a, b - a))
                first, last, trigger, counts = parse(data, offsets, length)
                body = data.tobytes()
                heads = b"".join([blake2b(body[t : t + head], digest_size=8).digest() for t in trigger.tolist()])
                whole = b"".join([blake2b(body[i:k], digest_size=12).digest() for i, k in zip(first.tolist(), (last + length).tolist(), strict=True)])
                digests = np.frombuffer(whole, np.dtype([("high", "<i8"), ("low", "<i4")]))
                keep = np.flatnonzero(counts)
                ends = pa.array(np.r_[0, np.cumsum(counts[keep])].astype(np.int32))
                columns = [np.frombuffer(heads, "<i8"), digests["high"].copy(), digests["low"].copy()]
                lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]
                rows = pa.array(np.arange(number, number + len(keep)))
                number += len(keep)
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(a, b - a).take(pa.array(keep)), *lists], ["row", "text_key", "heads", "high", "low"])

    return keyed.select("text_key", "text").mapInArrow(run, "row bigint, text_key binary, heads array<bigint>, high array<bigint>, low array<int>")


def record_bytes(texts: DataFrame, length: int) -> DataFrame:
    """head, high, low, several, least_t, most_t and body of the wanted records of each text (text, wanted)."""

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(0), 1 << 20):
                part = batch.slice(a, b - a)
                data, offsets = text_bytes(part.column(0))
                first, last, trigger, counts = parse(data, offsets, length)
                wanted = part.column(1)
                fields = wanted.flatten()
                at = np.repeat(np.cumsum(counts) - counts, wanted.value_lengths().to_numpy()) + fields.field("place").to_numpy()
                first, last, trigger, body = first[at], last[at], trigger[at], data.tobytes()
                bodies = [body[i:k] for i, k in zip(first.tolist(), (last + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[fields.field(c) for c in ("head", "high", "low", "several")], pa.array((trigger - last).astype(np.int32)), pa.array((trigger - first).astype(np.int32)), pa.array(bodies, pa.binary())],
                    ["head", "high", "low", "several", "least_t", "most_t", "body"],
                )

    return texts.select("text", "wanted").mapInArrow(run, "head bigint, high bigint, low int, several boolean, least_t int, most_t int, body binary")


def suffix_order(rows: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in lexicographic order, and how many bytes each shares with the one before it in that order.

    first: numbers that come before the bytes; rows that differ there share -1.
    """
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    columns = padded.view(">u8").T
    order = np.lexsort([*columns[::-1], *([first] if first is not None else [])])
    one, two = rows[order[1:]], rows[order[:-1]]
    apart = one != two
    shared = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    if first is not None:
        shared = np.where(first[order[1:]] == first[order[:-1]], shared, -1)
    return order, np.r_[-1, shared]


def classes(order: np.ndarray, shared: np.ndarray, size: int) -> np.ndarray:
    """For each row the number of the class of rows that agree with it in `size` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < size)
    return out


def repeated_strings(heads: np.ndarray, least_t: np.ndarray, most_t: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each record the least and the largest t of its strings that another record has too; -1 for none."""
    m = len(heads)
    ends = np.zeros((m, TRIGGER_WINDOW - 1), np.uint8)  # of phrases, from the trigger leftwards
    parse_ = np.zeros((m, length), np.uint8)
    for k, (body, t) in enumerate(zip(bodies, most_t.tolist(), strict=True)):
        row = np.frombuffer(body, np.uint8)
        ends[k, :t] = row[:t][::-1]
        parse_[k, : len(row) - t] = row[t:]
    dictionary, following = suffix_order(ends), suffix_order(parse_, heads)
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    for t in range(TRIGGER_WINDOW):
        rows = np.flatnonzero((least_t <= t) & (t <= most_t))
        if len(rows) < 2:
            continue
        key = classes(*following, length - t)[rows] * (m + 1) + classes(*dictionary, t)[rows]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = rows[order[np.r_[same, False] | np.r_[False, same]]]
        high[again] = t
        low[again] = np.where(low[again] < 0, t, low[again])
    return low, high


FOUND = "head bigint, high bigint, low int, t0 int, t1 int"


def ordered_heads(records: DataFrame, length: int, together: int = 8000) -> DataFrame:
    """FOUND for single records with repeated strings. records: all different ones of each head, heads of bounded size."""

    def run(batches):
        def chunks() -> Iterator[pa.Table]:
            held, rows = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                rows += batch.num_rows
                if rows >= together:
                    table = pa.Table.from_batches(held).combine_chunks()
                    heads = table.column("head").to_numpy()
                    whole = int(np.searchsorted(heads, heads[-1], "left"))  # the last head may go on
                    if whole:
                        yield table.slice(0, whole)
                    held, rows = table.slice(whole).to_batches(), len(heads) - whole
            if rows:
                yield pa.Table.from_batches(held)

        for table in chunks():
            low, high = repeated_strings(*[table.column(c).to_numpy() for c in ("head", "least_t", "most_t")], table.column("body").to_pylist(), length)
            keep = np.flatnonzero((low >= 0) & ~table.column("several").to_numpy(zero_copy_only=False))
            columns = [table.column(c).take(pa.array(keep)).combine_chunks() for c in ("head", "high", "low")]
            found = pa.Table.from_arrays([*columns, pa.array(low[keep].astype(np.int32)), pa.array(high[keep].astype(np.int32))], ["head", "high", "low", "t0", "t1"])
            yield from found.to_batches()

    return records.repartition("head").sortWithinPartitions("head").mapInArrow(run, FOUND)


def counted_strings(records: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """As ordered_heads for heads of any size: each string of each record is counted by its digest."""
    t = F.explode(F.sequence("least_t", "most_t")).alias("t")
    strings = records.select("head", "high", "low", "several", "most_t", "body", t)
    string = F.substring("body", F.col("most_t") - F.col("t") + 1, F.lit(length))
    strings = scratch.store(strings.select("head", "high", "low", "several", "t", F.unhex(F.sha2(string, 256)).alias("string")), "strings")
    several = scratch.store(strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string"), "repeated-strings")
    found = strings.where("NOT several").join(with_small_side(several, several.count(), 48), "string", "left_semi")
    return found.groupBy("head", "high", "low").agg(F.min("t").cast("int").alias("t0"), F.max("t").cast("int").alias("t1"))


def spans_of(data: np.ndarray, offsets: np.ndarray, marks: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that marked records cover, joined where they touch, and the text of each."""
    first, last, trigger, counts = parse(data, offsets, length)
    sizes = marks.value_lengths().to_numpy()
    fields = marks.flatten()
    at = np.repeat(np.cumsum(counts) - counts, sizes) + fields.field("place").to_numpy()
    text = np.repeat(np.arange(len(sizes)), sizes)
    t0, t1 = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("t0", "t1"))
    whole = np.isnan(t1.astype(float))
    begin = np.where(whole, first[at], trigger[at] - np.nan_to_num(t1.astype(float)).astype(np.int64))
    end = np.where(whole, last[at], trigger[at] - np.nan_to_num(t0.astype(float)).astype(np.int64)) + length
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], end[order], text[order]
    furthest = np.maximum.accumulate(end)
    new = np.r_[True, (begin[1:] > furthest[:-1]) | (text[1:] != text[:-1])]
    groups = np.flatnonzero(new)
    return begin[groups], furthest[np.r_[groups[1:], len(begin)] - 1], text[groups]


def cut_texts(texts: DataFrame, length: int) -> DataFrame:
    """id, n_bytes, spans and kept of texts with marks (structs of place, t0, t1; null: all of the record's strings)."""

    def run(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                data, offsets = text_bytes(part.column(1))
                begin, end, text = spans_of(data, offsets, part.column(2), length)
                keep = np.ones(len(data) + 1, np.int8)
                for i, k in zip(begin.tolist(), end.tolist(), strict=True):
                    keep[i:k] = 0
                keep = keep[:-1].astype(bool)
                sizes = np.r_[0, np.cumsum(keep)][offsets]
                body = data[keep]
                kept = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                ends = np.searchsorted(text, np.arange(len(part) + 1))
                fields = [pa.array(begin - offsets[text]), pa.array(end - begin)]
                spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), spans, kept], ["id", "n_bytes", "spans", "kept"])

    return texts.select("id", "text", "marks").mapInArrow(run, f"id bigint, n_bytes bigint, spans array<{SPAN}>, kept binary")


def repeated_records(keyed: DataFrame, parsed: DataFrame, rows: DataFrame, length: int, most_records: int, scratch: Scratch) -> DataFrame:
    """row, place, t0 and t1 of all records with repeated strings (t0 and t1 null: all of them).

    rows: row and text_key of the parsed texts, which are dropped on the way.
    """
    heads = parsed.select(F.explode("heads").alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head")
    heads = scratch.store(heads, "heads")
    each = F.posexplode(F.arrays_zip("heads", "high", "low")).alias("place", "z")
    records = parsed.select("row", each).select(F.col("z.heads").alias("head"), F.col("z.high").alias("high"), F.col("z.low").alias("low"), "row", "place")
    records = scratch.store(records.join(with_small_side(heads, heads.count(), 24), "head", "left_semi"), "records")
    scratch.drop("heads", "parsed")
    name = ["head", "high", "low"]
    different = records.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min_by("place", "row").alias("place"))
    different = scratch.store(different, "different")
    # heads with several records of which one at least stands alone
    mixed_heads = different.groupBy("head").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("n")).where("size > 1 AND n = 1").select("head", "size")
    mixed_heads = scratch.store(mixed_heads, "mixed-heads")
    open_ = different.join(with_small_side(mixed_heads, mixed_heads.count(), 24), "head")
    wanted = F.struct("place", "head", "high", "low", (F.col("n") > 1).alias("several"))
    by_row = open_.groupBy("row").agg(F.collect_list(wanted).alias("wanted"))
    by_text = scratch.store(by_row.join(rows, "row").select("text_key", "wanted"), "wanted")
    n_texts = by_text.count()
    texts = keyed.select("text_key", "text")
    if n_texts:  # few texts: only these are dealt out
        texts = texts.join(with_small_side(by_text.select("text_key").distinct(), n_texts, 40), "text_key", "left_semi")
    bodies = record_bytes(texts.join(by_text, "text_key"), length).dropDuplicates(name)
    bodies = scratch.store(bodies, "bodies")
    found = [different.where("n > 1").select(*name, F.lit(None).cast("int").alias("t0"), F.lit(None).cast("int").alias("t1"))]
    large = scratch.store(mixed_heads.where(F.col("size") > most_records).select("head"), "large-heads")
    n_large = large.count()
    side = with_small_side(large, n_large, 24)
    found.append(ordered_heads(bodies.join(side, "head", "left_anti") if n_large else bodies, length))
    if n_large:
        found.append(counted_strings(bodies.join(side, "head", "left_semi"), length, scratch))
    whole = found[0]
    for df in found[1:]:
        whole = whole.unionByName(df)
    whole = scratch.store(whole, "found")
    scratch.drop("bodies", "different", "mixed-heads", "wanted", "large-heads", "strings", "repeated-strings")
    marks = scratch.store(records.join(with_small_side(whole, whole.count(), 48), name).select("row", "place", "t0", "t1"), "marks")
    scratch.drop("records", "found")
    return marks


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200, most_records: int = 4_000, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: id, n_bytes, spans (removed: structs of start and length in bytes), kept (the other bytes).

    Removed is each byte covered by a string of `length` bytes that also starts elsewhere in these texts.
    """
    if length < TRIGGER_WINDOW + GRAM - 1:
        raise ValueError(f"length must be {TRIGGER_WINDOW + GRAM - 1} at least")
    scratch = scratch or Scratch(docs.sparkSession, "repeated-passages")
    keyed = keyed_texts(docs, id_col, text_col)
    parsed = scratch.store(parsed_texts(keyed, length), "parsed")
    rows = scratch.store(parsed.select("row", "text_key"), "rows")
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_key")
    copies = scratch.store(copies, "copies")
    n_copies = copies.count()
    marks = repeated_records(keyed, parsed, rows, length, most_records, scratch)
    by_row = marks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "t0", "t1"))).alias("marks"))
    by_text = by_row.join(rows, "row").join(with_small_side(copies, n_copies, 40), "text_key", "left_anti")
    by_text = scratch.store(by_text.select("text_key", "marks"), "marks-by-text")
    scratch.drop("rows", "marks")
    # copies go whole, texts without marks stay whole; the others are cut
    kinds = copies.select("text_key", F.lit(True).alias("whole")).unionByName(by_text.select("text_key", F.lit(False).alias("whole")))
    told = keyed.join(with_small_side(kinds, n_copies + by_text.count(), 40), "text_key", "left")
    size, nothing = F.octet_length("text").cast("bigint"), F.col("whole").isNull()
    uncut = told.where("whole IS NULL OR whole").select(
        "id",
        size.alias("n_bytes"),
        F.when(nothing, F.array().cast(f"array<{SPAN}>")).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("length")))).alias("spans"),
        F.when(nothing, F.col("text")).otherwise(F.lit(b"")).alias("kept"),
    )
    cut = cut_texts(told.where("NOT whole").select("id", "text_key", "text").join(by_text, "text_key"), length)
    return uncut.unionByName(cut).withColumnRenamed("id", id_col)
