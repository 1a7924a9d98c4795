"""Periodic runs of words by the linear-time method for ordered alphabets.

A run is a longest stretch of words with a smallest period p. Under one of the two orders of
the words each run has a Lyndon root: a place j whose next smaller suffix starts at j + p. So
the runs are among the pairs (j, next smaller suffix of j) of both orders, and a pair's
common extension to the right says how far its run reaches.

Both come from one pass from left to right. The places whose next smaller suffix is still
open form a chain of ever smaller suffixes; a new place closes those that are greater than
its own. Comparisons never read a word twice to the right: the match that has reached
farthest, of place i with an earlier place j, is kept. A place within its reach lies
over a mirror place i - j before, whose comparisons are known; they are taken over, or, if they
ran up to the end of the reach, go on from there. Words are only ever compared with each
other; there is no suffix tree or array, and nothing is hashed.

Defined results for odd input
-----------------------------
* A null or empty text has no words, no runs and an empty collapsed text.
* Null ids and repeated rows are handled like any other row.
* Texts of any length are read whole, one at a time; an empty table gives an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.words import row_slices

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def next_smaller_suffixes(words: Sequence, descending: bool = False) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller suffix (or the end) and how many words both suffixes share.

    descending: greater words count as smaller. A suffix that is a beginning of another is smaller in either order.
    """
    n = len(words)
    after, shared = [n] * n, [0] * n  # next smaller suffix, and words shared with it
    before, held = [-1] * n, [0] * n  # last smaller suffix, and words shared with it
    reach = distance = 0  # words[i:reach] == words[i - distance:reach - distance] for the place i that has matched farthest
    for i in range(1, n):
        j, k, size = i - 1, -1, 0
        if i < reach:
            mirror, room = i - distance, reach - i
            while True:
                image = j - distance
                closed = after[image] == mirror
                size = shared[image] if closed else held[mirror]
                if size >= room:
                    size = room
                    break
                if not closed:
                    before[i], held[i] = j, size
                    break
                after[j], shared[j] = i, size
                j = before[j]
            if size < room:
                continue
        word, ends = words[i], False
        while j >= 0:
            # j shares `size` words with i at least
            if size or words[j] == word:
                k = i + size
                gap = i - j
                while k < n and words[k] == words[k - gap]:
                    k += 1
                size = k - i
                if k >= reach:
                    reach, distance = k, gap
                smaller = k == n or ((words[k] > words[k - gap]) if descending else (words[k] < words[k - gap]))
            else:
                smaller = (word > words[j]) if descending else (word < words[j])
            if not smaller:
                before[i], held[i] = j, size
                break
            # close j, and those further down that differ from i where j does
            while True:
                after[j], shared[j] = i, size
                common, j = held[j], before[j]
                if common <= size or j < 0:
                    break
            if j >= 0 and common < size:
                before[i], held[i] = j, common
                break
    return after, shared


def find_runs(words: Sequence, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of each run of least_length words and least_exponent periods, by start, then period."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    found: set[tuple[int, int, int]] = set()
    n = len(words)
    if n < max(least_length, least_exponent):
        return []
    for descending in (False, True):
        after, shared = next_smaller_suffixes(words, descending)
        for j, right in enumerate(shared):
            i = after[j]
            p = i - j
            # the run's first root counts, left of which it has less than p words
            if not right or right + 2 * p <= least_exponent * p or (j >= p and after[j - p] == j and shared[j - p] >= p):
                continue
            at = j
            while at and words[at - 1] == words[at - 1 + p]:
                at -= 1
            length = i + right - at
            if length >= least_length and length >= least_exponent * p:
                found.add((at, length, p))
    return sorted(found)


def kept_words(words: Sequence, runs: list[tuple[int, int, int]]) -> list:
    """The words of which no run says that they repeat its first period."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep, strict=True) if k] if runs else list(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """One row for each row of docs: id, n_words, runs (structs of start, length, period by start, then period), collapsed.

    collapsed: the words, joined by a space, that do not repeat the first period of a run.
    """

    def search(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1), 1 << 20):
                sizes, starts, lengths, periods, counts, texts = [], [], [], [], [0], []
                for text in batch.column(1).slice(a, b - a):
                    words = (text.as_py() or b"").split()
                    runs = find_runs(words, least_length, least_exponent)
                    sizes.append(len(words))
                    for column, values in zip((starts, lengths, periods), zip(*runs, strict=True), strict=False):
                        column.extend(values)
                    counts.append(len(starts))
                    texts.append(b" ".join(kept_words(words, runs)))
                fields = [pa.array(x, pa.int64()) for x in (starts, lengths, periods)]
                runs = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), runs, pa.array(texts, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(search, f"id bigint, n_words bigint, runs array<{RUN}>, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.decode("collapsed", "UTF-8").alias("collapsed"))
