"""Vocabulary training: word bag, pair counts, best pair, merges.

Pairs never cross words, so a corpus is its bag of words. Counts are exact 64-bit sums
from partial aggregation; a merge is one string replacement in the bag.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mergeloom.functions import symbols as S
from mergeloom.functions.text import display_bytes, words
from mergeloom.operators.batches import MergeTable, pair_keys, picked, summed, symbol_ids, symbol_strings
from mergeloom.operators.segments import cut_at_words
from mergeloom.sources.storage import Scratch


class Merge(NamedTuple):
    a: int
    b: int
    new_id: int
    count: int


MERGES = "merge_idx int, a int, b int, new_id int, count bigint"


def word_bag(docs: DataFrame, text_col: str = "text", pretokenizer: str = "unicode", part_bytes: int | None = None) -> DataFrame:
    """word and freq: how often each word stands in the texts. part_bytes: longer texts are cut first (cut_at_words)."""
    if part_bytes is not None:
        docs = cut_at_words(docs.select(text_col), text_col, pretokenizer, part_bytes=part_bytes)
    return docs.select(F.explode(words(F.col(text_col), pretokenizer)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def symbol_bag(bag: DataFrame) -> DataFrame:
    """The bag with each word's bytes as symbols."""
    return bag.select("word", "freq", S.of_text(F.col("word")).alias("symbols"))


def pair_counts(bag: DataFrame) -> DataFrame:
    """pair (two symbols) and count over a symbol bag; overlapping pairs count, those with token 0 do not."""
    return bag.select(F.explode(S.adjacent_pairs(F.col("symbols"))).alias("pair"), "freq").groupBy("pair").agg(F.sum("freq").alias("count"))


def with_ids(pairs: DataFrame) -> DataFrame:
    """a, b and count of pairs."""
    return pairs.select(S.first_id(F.col("pair")).alias("a"), S.first_id(F.substr("pair", F.lit(2))).alias("b"), "count")


def top_pairs(bag: DataFrame, n: int) -> DataFrame:
    """The n most frequent pairs; on equal counts the smaller pair of ids first."""
    return with_ids(pair_counts(bag).orderBy(F.desc("count"), "pair").limit(n))


def safe_prefix(ranked: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """As many of the ranked pairs (a, b, count) as give the same merges together as one by one.

    The pairs taken share no symbol, and each has a larger count than any pair after it
    that touches a symbol taken; a pair of equal symbols is only taken alone.
    """
    taken: list[tuple[int, int, int]] = []
    used: set[int] = set()
    for k, (a, b, n) in enumerate(ranked):
        own = {a, b}
        if len(taken) >= most or n < 2 or used & own or (taken and a == b):
            break
        touched = used | own
        rivals = [r for r in ranked[k + 1 :] if r[2] == n and touched & {r[0], r[1]}]
        if taken and rivals:
            break
        taken.append((a, b, n))
        used = touched
        if a == b or rivals:
            break
    return taken


class Board:
    """The most frequent pairs with their exact counts, and `last`, a bound (count, pair) that every pair off the board comes after.

    A pair is a * 2**16 + b. Merging only lowers the counts of known pairs, so that a pair off the board stays
    off it; new pairs are counted whole in the round that makes their symbol. So the board stays exact by the
    changes of its own pairs and by the new pairs before `last`.
    """

    def __init__(self, counts: dict[int, int], last: tuple[int, int] | None):
        self.counts, self.last = counts, last
        self.least = max(2, last[0]) if last else 2

    def holds(self, pair: int, count: int) -> bool:
        return count >= 2 and (self.last is None or (-count, pair) <= (-self.last[0], self.last[1]))

    def change(self, changes: dict[int, int]) -> None:
        for pair, n in changes.items():
            count = self.counts.get(pair, 0) + n
            if self.holds(pair, count):
                self.counts[pair] = count
            else:
                self.counts.pop(pair, None)

    def chosen(self, most: int) -> list[tuple[int, int, int]]:
        """Pairs (a, b, count) that can be merged together (safe_prefix); pairs off the board may share the last count."""
        ranked = sorted(self.counts.items(), key=lambda p: (-p[1], p[0]))
        sure = ranked if self.last is None else [p for p in ranked if p[1] > self.last[0]] or ranked[:1]
        return safe_prefix([(pair >> 16, pair & 0xFFFF, n) for pair, n in sure], most)


class Round(NamedTuple):
    """What a round of training did: merges taken, words read for it and their bytes."""

    merges: int
    words: int
    bytes: int


def _as_pair(a: int, b: int) -> int:
    return (a << 16) + b


def pair_key() -> Column:
    """The pair of a column of two symbols."""
    return (S.first_id(F.col("pair")).cast("bigint") * 65536 + S.first_id(F.substr("pair", F.lit(2)))).alias("pair")


def count_board(state: DataFrame, size: int) -> Board:
    """The `size` most frequent pairs of a symbol bag, or all that occur twice if there are no more."""
    ranked = pair_counts(state).where("count > 1").select(pair_key(), "count").orderBy(F.desc("count"), "pair").limit(size + 1).collect()
    last = (ranked[size - 1]["count"], ranked[size - 1].pair) if len(ranked) > size else None
    return Board({r.pair: r["count"] for r in ranked[:size]}, last)


def index_words(state: DataFrame, least: int) -> DataFrame:
    """pair, freq and symbols: each word under each of its pairs that the bag has `least` times, sorted by pair.

    What is written from it has disjoint ranges of pairs in its files, so a reader of few pairs opens few of them.
    """
    frequent = pair_counts(state).where(F.col("count") >= least).select("pair")
    each = state.select(F.explode(F.array_distinct(S.adjacent_pairs(F.col("symbols")))).alias("pair"), "freq", "symbols")
    kept = each.join(frequent, "pair").select(pair_key(), "freq", "symbols")
    return kept.repartitionByRange("pair", F.xxhash64("symbols")).sortWithinPartitions("pair")


def merged_words(state: DataFrame, merges: list[Merge], self_pair: str) -> DataFrame:
    """A symbol bag (freq, symbols) after merges."""
    table = MergeTable([m[:3] for m in merges], self_pair)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), symbol_strings(*table.apply_rows(*symbol_ids(batch.column(1))))], ["freq", "symbols"])

    return state.select("freq", "symbols").mapInArrow(run, "freq bigint, symbols string")


def pair_changes(rows: DataFrame, roots: list[int], done: list[Merge], chosen: list[Merge], board: Board, self_pair: str) -> DataFrame:
    """pair and change of count by the chosen merges, for pairs on the board and new ones that may come onto it.

    rows: pair, freq and symbols of words before the merges `done`. A word may stand under several pairs; the first of
    roots that it holds counts (a pair of null: the word stands there once).
    """
    before, now = MergeTable([m[:3] for m in done], self_pair), MergeTable([m[:3] for m in chosen], self_pair)
    known, first_new = np.array(sorted(board.counts), np.int64), chosen[0].new_id
    order = np.argsort(roots)
    sorted_roots = np.array(roots, np.int64)[order]

    def once(pairs: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if pairs.null_count:
            return np.arange(len(pairs))
        keys, row = pair_keys(ids, offsets)
        at = np.minimum(np.searchsorted(sorted_roots, keys), len(sorted_roots) - 1)
        hit = sorted_roots[at] == keys
        first = np.full(len(pairs), len(roots), np.int64)
        np.minimum.at(first, row[hit], order[at[hit]])
        return np.flatnonzero(np.r_[np.array(roots, np.int64), -1][first] == pairs.to_numpy())

    def run(batches):
        for batch in batches:
            freq = batch.column(1).to_numpy()
            ids, offsets = symbol_ids(batch.column(2))
            keep = once(batch.column(0), ids, offsets)
            if len(keep) < len(freq):
                ids, offsets = picked(ids, offsets[keep], np.diff(offsets)[keep]), np.r_[0, np.cumsum(np.diff(offsets)[keep])]
                freq = freq[keep]
            one = before.apply_rows(ids, offsets)
            two = now.apply_rows(*one)
            keys, values = [], []
            for sign, side in ((-1, one), (1, two)):
                key, row = pair_keys(*side)
                keys.append(key)
                values.append(sign * freq[row])
            pair, change = summed(np.concatenate(keys), np.concatenate(values))
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            wanted = (change != 0) & ((known[at] == pair) | (pair >> 16 >= first_new) | (pair & 0xFFFF >= first_new))
            yield pa.RecordBatch.from_arrays([pa.array(pair[wanted]), pa.array(change[wanted])], ["pair", "change"])

    changes = rows.select("pair", "freq", "symbols").mapInArrow(run, "pair bigint, change bigint").groupBy("pair").agg(F.sum("change").alias("change"))
    return changes.where((F.col("change") < 0) | (F.col("change") >= board.least))


def root_of(pair: tuple[int, int], made: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """A pair of symbols that are not `made` (by merges) which every word with `pair` held before these merges."""
    a, b = pair
    while a in made or b in made:
        a, b = made[a] if a in made else made[b]
    return a, b


def train_merges(bag: DataFrame, target: int, *, self_pair: str = "greedy", board_size: int = 4096, index_from: int = 48, renew_after: int = 512, rounds: list[Round] | None = None) -> list[Merge]:
    """Merges until the vocabulary has `target` tokens or no pair occurs twice.

    bag: word and freq. All pairs are counted once for many merges: that gives a board of the most
    frequent ones, which rounds keep exact (Board). A round takes merges from the board that cannot influence each other
    (safe_prefix) and reads only words that hold one of their pairs, from an index of words by pair, if at
    least index_from merges are to come. The words themselves are rewritten, and counted anew, after renew_after merges or when no
    pair of the board can be the most frequent any more. The driver holds the board and gets the changes of its pairs.
    rounds: a list that gets a Round for each round. Raises ValueError for an empty bag.
    """
    if target > S.MOST_TOKENS:
        raise ValueError(f"at most {S.MOST_TOKENS} tokens")
    spark = bag.sparkSession
    scratch = Scratch(spark, "training")
    state = scratch.store(symbol_bag(bag).select("freq", "symbols"), "bag")
    if state.isEmpty():
        raise ValueError("the corpus is empty")
    merges: list[Merge] = []
    while 256 + len(merges) < target:
        left = target - 256 - len(merges)
        board = count_board(state, min(board_size, max(256, 16 * left)))
        done: list[Merge] = []
        index = None
        while len(done) < renew_after and (chosen := board.chosen(left - len(done))):
            new = [Merge(a, b, 256 + len(merges) + k, n) for k, (a, b, n) in enumerate(chosen)]
            merges += new
            if len(done) + len(new) == left:
                break
            if index is None and left - len(done) >= index_from:
                index = scratch.store(index_words(state, board.least), "index")
            made = {m.new_id: (m.a, m.b) for m in done}
            roots = list(dict.fromkeys(_as_pair(*root_of((m.a, m.b), made)) for m in new))
            holds = lambda r: F.col("pair") == r if index is not None else F.contains("symbols", F.lit(S.symbol(r >> 16) + S.symbol(r & 0xFFFF)))
            rows = (index if index is not None else state.withColumn("pair", F.lit(None).cast("bigint"))).where(reduce(or_, map(holds, roots)))
            seen = Observation()
            rows = rows.observe(seen, F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.octet_length("symbols")), F.lit(0)).alias("bytes"))
            found = pair_changes(rows, roots, done, new, board, self_pair).toArrow()  # pairs of the board, and new ones as frequent
            board.change(dict(zip(found["pair"].to_pylist(), found["change"].to_pylist(), strict=True)))
            done += new
            if rounds is not None:
                rounds.append(Round(len(new), seen.get["words"], seen.get["bytes"]))
        if not done or 256 + len(merges) == target:
            break
        state = scratch.replace(merged_words(state, done, self_pair), "bag")
        scratch.drop("index")
    scratch.drop()
    return merges


def apply_merges(bag: DataFrame, merges: list[Merge], self_pair: str = "greedy") -> DataFrame:
    """A symbol bag after merges, in order."""
    expression = F.col("symbols")
    for m in merges:
        expression = S.merged(expression, m.a, m.b, m.new_id, self_pair)
    return bag.withColumn("symbols", expression)


def merges_frame(spark, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], MERGES)


def token_bytes(merges: list[Merge]) -> list[bytes]:
    """The bytes of each token id: 256 single bytes, then each merge's two parts joined."""
    out = [bytes([b]) for b in range(256)]
    for m in merges:
        out.append(out[m.a] + out[m.b])
    return out


def vocabulary(spark, merges: list[Merge]) -> DataFrame:
    """token_id, bytes and display of every token."""
    return spark.createDataFrame([(k, bytearray(b), display_bytes(b)) for k, b in enumerate(token_bytes(merges))], "token_id int, bytes binary, display string")


def progress(bag: DataFrame, merges: list[Merge], *, seconds: float = 0.0, keep_every: int = 8) -> DataFrame:
    """For each merge its number, token, count, the symbols left in the corpus after it, and how far training is (bag: a symbol bag).

    ratio: symbols before all merges for one left; percent: share of the merges done;
    seconds_left: what the rest takes at the pace of the merges so far, which took `seconds` in all.
    """
    spark, parts = bag.sparkSession, token_bytes(merges)
    scratch = Scratch(spark, "progress")
    total = bag.agg(F.sum(F.col("freq") * F.char_length("symbols")).alias("n")).first().n or 0
    left: list[int] = []
    for k in range(0, len(merges), keep_every):  # the plan holds so many merges at most
        stages = list(_stages(merges[k : k + keep_every]))
        left += bag.agg(*[F.sum(F.col("freq") * F.char_length(e)).alias(f"n{i}") for i, e in enumerate(stages)]).first()
        if k + keep_every < len(merges):
            bag = scratch.replace(bag.withColumn("symbols", stages[-1]), "bag")
    scratch.drop()
    n = len(merges)
    rows = [
        (k + 1, n, display_bytes(parts[m.new_id]), m.count, int(left[k]), round(total / left[k], 4) if left[k] else None, round(100.0 * (k + 1) / n, 1), round(seconds * (n - k - 1) / n, 3))
        for k, m in enumerate(merges)
    ]
    return spark.createDataFrame(rows, "merge_index int, total_merges int, merge_string string, best_count bigint, symbol_count bigint, ratio double, percent double, seconds_left double")


def _stages(merges: list[Merge]):
    expression = F.col("symbols")
    for m in merges:
        expression = S.merged(expression, m.a, m.b, m.new_id)
        yield expression
