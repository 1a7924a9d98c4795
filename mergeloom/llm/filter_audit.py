"""How filters of documents act on each other, over all orders of applying them, by edges of the subset lattice.

Whether a filter drops a document depends on the set of filters before it only, not on their
order. So for n filters the n! orders are paths through the lattice of subsets, along
n * 2**(n-1) edges (filters already applied, next filter). Documents are counted by part and
by the set of filters they fail, which is a row or few for each part; these counts are
added up on the edges, and the edges joined to the steps of all orders. An edge (S, f) lies
on |S|! * (n - 1 - |S|)! orders, which gives the sums over all orders.

Defined results for odd input
-----------------------------
* A null text is empty; a null part is the empty string.
* A null id is neither smaller nor larger than another: such a row is no earlier copy and has none.
* Repeated ids: rows of one id and text are not earlier than each other.
* Marks: a document has a mark if any row of the marks with its id says so; ids without a row have none.
* No document: no rows. Every part has a row for each order and step, zeros included.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side

WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def text_failures(text: Column) -> list[Column]:
    """What makes a text fail: few words, few distinct words, many capitals, odd characters."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 65 * F.size(words).cast("bigint"),
        100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint"),
        text.rlike(r"[#$%&*|]"),
    ]


def with_earlier_copy(rows: DataFrame, id_col: str, digest_col: str, scratch: Scratch) -> DataFrame:
    """rows with `copy`: whether a row of a smaller id has the same digest."""
    several = rows.where(F.col(id_col).isNotNull()).groupBy(digest_col).agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"))
    several = scratch.store(several.where("least < most").select(digest_col, "least"), "several")
    marked = rows.join(with_small_side(several, several.count(), 64), digest_col, "left")
    return marked.withColumn("copy", F.coalesce(F.col("least") < F.col(id_col), F.lit(False))).drop("least")


def with_marks(rows: DataFrame, id_col: str, marks: DataFrame, names: list[str]) -> DataFrame:
    """rows with boolean columns `names`, true where marks (id_col and names) say so; rows without an id take no part in the join."""
    by_id = marks.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
    by_id = by_id.where(" OR ".join(names))
    known, unknown = rows.where(F.col(id_col).isNotNull()), rows.where(F.col(id_col).isNull())
    joined = known.join(by_id, id_col, "left").select(*rows.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])
    return joined.unionByName(unknown.select("*", *[F.lit(False).alias(n) for n in names]))


def lattice_edges(patterns: DataFrame, n: int, marks: list[str]) -> DataFrame:
    """part, subset, filter and counts for each edge of the lattice of n filters.

    patterns: part, fails (bit k: fails filter k), marks (booleans) and n, the number of documents.
    """
    edges = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for f in range(n) for s in range(1 << n) if not s >> f & 1])
    rows = patterns.withColumn("edge", F.explode(edges)).select("part", "edge.*", "fails", "n", *marks)
    bit = F.col("bit")
    alive, failing = F.col("fails").bitwiseAND(F.col("subset")) == 0, F.col("fails").bitwiseAND(bit) != 0
    number = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return rows.groupBy("part", "subset", "filter").agg(
        number(alive & ~failing).alias("kept"),
        number(alive & failing).alias("removed"),
        number(~alive & failing).alias("redundant"),
        number(F.col("fails") == bit).alias("unique_fails"),
        *[number(alive & failing & F.col(m)).alias(f"{m}_lost") for m in marks],
    )


def order_steps(spark: SparkSession, letters: str) -> DataFrame:
    """filter_order, step (from 1), and the edge, subset and filter, of each step of all orders."""
    rows = []
    for order in itertools.permutations(range(len(letters))):
        name = "".join(letters[f] for f in order)
        rows += [(name, k + 1, sum(1 << g for g in order[:k]), f) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, filter int")


def audit_orders(patterns: DataFrame, letters: str, marks: list[str], scratch: Scratch) -> DataFrame:
    """Counts of each step of each order of the filters, for each part of patterns (see lattice_edges).

    shapley: what a step's filter removes, summed over all orders.
    """
    n = len(letters)
    edges = scratch.store(lattice_edges(patterns, n, marks), "edges")
    paths = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("subset") + 1)
    sums = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * paths).alias("shapley"))
    steps = order_steps(edges.sparkSession, letters)  # n * n! rows
    whole = edges.join(sums, ["part", "filter"]).join(F.broadcast(steps), ["subset", "filter"])
    lost = [f"{m}_lost" for m in marks]
    return whole.select("part", "filter_order", "step", *COUNTS, *lost, "shapley")


def filter_audit(docs: DataFrame, marks: DataFrame, mark_names: list[str], *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The audit of five filters, A to E: those of text_failures and being a copy of a document with a smaller id.

    marks: id_col and boolean columns mark_names. Result: part, filter_order, step, kept,
    removed, redundant, unique_fails, <mark>_lost for each mark, shapley.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    fails = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col(text_col)))), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), fails.alias("fails"), digest.alias("digest"))
    rows = scratch.store(rows, "rows")
    rows = with_earlier_copy(rows, "id", "digest", scratch).withColumn("fails", F.col("fails") + F.when(F.col("copy"), 16).otherwise(0))
    own = marks.select(F.col(id_col).cast("bigint").alias("id"), *mark_names)
    rows = with_marks(rows.select("id", "part", "fails"), "id", own, mark_names)
    patterns = scratch.store(rows.groupBy("part", "fails", *mark_names).agg(F.count(F.lit(1)).alias("n")), "patterns")
    out = audit_orders(patterns, "ABCDE", mark_names, scratch)
    scratch.drop("rows", "several")
    return out
