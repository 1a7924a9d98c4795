"""Words of giant texts: a text is cut into parts that different tasks look at, then again where words begin.

Whether a word begins at a place follows from a few characters around it, save inside a run of
digits, where it follows from how many digits of the run come before, modulo 3. So a part is a
finite automaton's transition table: for each of the three states it may be entered in, where its
first word begins, and the state it leaves behind. Tables compose; a running sum over a text's
parts gives each the state it is entered in, and with it the place of the cut. The words of the
resulting pieces, one after the other, are those of the whole text, wherever it was cut.

Defined results for odd input: a null or short text is one piece; an empty one too; bytes that are
not UTF-8 are read as U+FFFD in texts that are cut; a word longer than a part is whole in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from mergeloom.functions import text as T
from mergeloom.sources.storage import Scratch

LETTER, DIGIT, SPACE, _, _, LINE, OTHER = range(7)
#: Code points up to U+10FFFF.
POINTS = 0x110000
#: Bytes on either side of a part that its first and last places depend on: four characters.
HALO = 16
#: Apostrophes, and the endings that stay with the word before them.
APOSTROPHES = (0x27, 0x2019)
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

_CLASSES: dict[str, np.ndarray] = {}


def classes(spark: SparkSession) -> np.ndarray:
    """The class of each code point, as the regular expressions of this session's JVM have it; made once for a session."""
    key = spark.sparkContext.applicationId
    if key not in _CLASSES:
        points = spark.range(POINTS).where("id not between 55296 and 57343")
        of = points.select("id", T.character_class(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")).alias("k")).toArrow()
        table = np.full(POINTS, OTHER, np.uint8)
        table[of["id"].to_numpy()] = of["k"].to_numpy()
        _CLASSES[key] = table
    return _CLASSES[key]


def _later(values: np.ndarray, n: int, fill: int) -> np.ndarray:
    return np.concatenate([values[n:], np.full(min(n, len(values)), fill, values.dtype)])


def _contractions(points: np.ndarray, k: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where an apostrophe begins an ending: after a letter, and no letter comes after the ending."""
    small = np.where((points >= 65) & (points <= 90), points + 32, points)
    found = np.zeros(len(points), bool)
    for ending in ENDINGS:
        here = _later(k, len(ending) + 1, OTHER) != LETTER
        for j, c in enumerate(ending):
            here &= _later(small, j + 1, 0) == ord(c)
        found |= here
    return found & (before == LETTER) & np.isin(points, APOSTROPHES)


class Cuts:
    """Where words begin in `points`, of which those from begin to end are the part itself and others stand around it."""

    def __init__(self, points: np.ndarray, begin: int, end: int, table: np.ndarray, pretokenizer: str):
        own = slice(begin, end)
        if pretokenizer == "byte":
            kinds = np.full(POINTS, 0, np.uint8)
            kinds[:128] = 3
            kinds[[*range(65, 91), *range(97, 123)]], kinds[48:58], kinds[32], kinds[10] = 0, 1, 2, 4
            k = kinds[points].astype(np.int8)
            p = np.concatenate([[-1], k[:-1]]).astype(np.int8)
            self.fixed = np.select([p == -1, (k == 4) | (p == 4), k == 2, p == 2], [True, True, p != 2, k == 3], k != p)[own]
            self.inside = np.zeros(end - begin, bool)
        else:
            k = table[points].astype(np.int8)
            p = np.concatenate([[-1], k[:-1]]).astype(np.int8)
            short = _contractions(points, k, p)
            after = np.concatenate([[False], short[:-1]])
            rules = [
                (p == -1) | (k == LINE) | (p == LINE), k == SPACE, (p == SPACE) | short | after | (k == OTHER) | (p == OTHER),
            ]
            self.fixed = np.select(rules, [True, p != SPACE, False], ((k == LETTER) != (p == LETTER)) | ((k == DIGIT) != (p == DIGIT)))[own]
            self.inside = ((k == DIGIT) & (p == DIGIT))[own]
        at = np.arange(end - begin)
        self.anchor = np.maximum.accumulate(np.where(self.inside, -1, at)) if end > begin else at
        last = int(self.anchor[-1]) if end > begin else -1
        #: The part is inside one run of digits; how many digits it ends with.
        self.whole = last < 0
        self.digits = end - begin if self.whole else (end - begin - last if pretokenizer == "unicode" and k[end - 1] == DIGIT else 0)

    def starts(self, state: int) -> np.ndarray:
        """Places where a word begins, if `state` digits modulo 3 come before the part without a gap."""
        at = np.arange(len(self.fixed))
        place = np.where(self.anchor >= 0, at - self.anchor, at + state)
        return np.flatnonzero(self.fixed | (self.inside & (place % 3 == 0)))


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)


def _char_begin(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _parts(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """giant (a number of the row), part, before, body, after, and rest, the row's other columns, with its first part."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("giant"), F.make_valid_utf8(text_col).cast("binary").alias("value"), rest.alias("rest"))
    fields = [StructField("giant", LongType()), StructField("part", IntegerType())] + [StructField(c, BinaryType()) for c in ("before", "body", "after")]
    schema = StructType([*fields, StructField("rest", rows.schema["rest"].dataType)])

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                buffer = batch.column(1)[row].as_buffer()
                data, other = np.frombuffer(buffer, np.uint8), batch.column(2).slice(row, 1)
                begin, part = 0, 0
                while begin < len(data):
                    end = _char_begin(data, min(len(data), begin + size))
                    first, last = _char_begin(data, max(0, begin - HALO)), _char_begin(data, min(len(data), end + HALO))
                    sides = [pa.array([buffer.slice(a, b - a).to_pybytes()], pa.binary()) for a, b in ((min(first, begin), begin), (begin, end), (end, last))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), pa.array([part], pa.int32()), *sides, pa.nulls(1, other.type) if part else other], [f.name for f in schema]
                    )
                    begin, part = end, part + 1

    return rows.mapInArrow(cut, schema)


def cut_at_words(
    docs: DataFrame, text_col: str = "text", pretokenizer: str = "unicode", *, part_bytes: int = 1 << 20, piece_col: str = "piece", scratch: Scratch | None = None
) -> DataFrame:
    """docs, a row for each piece of a text: texts of more than part_bytes bytes are cut where words begin.

    piece_col numbers the pieces of a row from 0; the other columns are repeated. Pieces have about
    part_bytes bytes; they lie on shared storage.
    """
    if piece_col in docs.columns:
        raise ValueError(f"docs has a column {piece_col}")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "cut-at-words")
    table = spark.sparkContext.broadcast(classes(spark) if pretokenizer == "unicode" else None)

    @F.arrow_udf("struct<first: array<int>, digits: bigint, whole: boolean>")
    def transitions(before: pa.Array, body: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for a, b, c in zip(before.to_pylist(), body.to_pylist(), after.to_pylist(), strict=True):
            left, own = _points(a), _points(b)
            cuts = Cuts(np.concatenate([left, own, _points(c)]), len(left), len(left) + len(own), table.value, pretokenizer)
            ends = np.r_[0, np.cumsum(1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000))]
            first = [ends[at[0]].item() if len(at) else None for at in map(cuts.starts, range(3))]
            out.append({"first": first, "digits": cuts.digits, "whole": cuts.whole})
        return pa.array(out, pa.struct([("first", pa.list_(pa.int32())), ("digits", pa.int64()), ("whole", pa.bool_())]))

    giant = F.coalesce(F.octet_length(text_col) > part_bytes, F.lit(False))
    # the parts are written before numbers of rows are used a second time
    parts = scratch.store(_parts(docs.where(giant), text_col, part_bytes), "parts")
    tables = scratch.store(parts.repartition("giant", "part").select("giant", "part", transitions("before", "body", "after").alias("t")).select("giant", "part", "t.*"), "tables")

    # a text has at most 2 GB and so a bounded number of parts
    order = Window.partitionBy("giant").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    states = tables.withColumn("run", F.coalesce(F.sum(F.when(F.col("whole"), F.col("digits")).otherwise(0)).over(earlier), F.lit(0)))
    base = F.last(F.when(~F.col("whole"), F.col("digits") - F.col("run")), ignorenulls=True).over(earlier)
    states = states.withColumn("state", (F.coalesce(base, F.lit(0)) + F.col("run")) % 3)
    states = states.withColumn("cut", F.get("first", F.col("state").cast("int")))
    cuts = states.select("giant", "part", "cut", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))

    # what comes before a part's cut belongs to the piece before
    found = parts.select("giant", "part", "body").join(cuts, ["giant", "part"])
    head = F.struct((F.col("upto") - 1).alias("piece"), F.substring("body", F.lit(1), F.col("cut")).alias("bytes"))
    tail = F.struct(F.col("upto").alias("piece"), F.substring("body", F.coalesce("cut", F.lit(0)) + 1, F.octet_length("body")).alias("bytes"))
    each = found.select("giant", "part", F.explode(F.when(F.col("cut") > 0, F.array(head, tail)).otherwise(F.array(tail))).alias("p"))
    pieces = each.groupBy("giant", "p.piece").agg(F.array_sort(F.collect_list(F.struct("part", F.col("p.bytes").cast("string").alias("s")))).alias("s"))
    texts = pieces.select("giant", (F.col("piece") - 1).cast("int").alias("piece"), F.array_join("s.s", "").alias("text"))
    whole = texts.join(parts.where("part = 0").select("giant", "rest"), "giant")
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return docs.where(~giant).withColumn(piece_col, F.lit(0)).unionByName(whole.select(*columns, F.col("piece").alias(piece_col)))
