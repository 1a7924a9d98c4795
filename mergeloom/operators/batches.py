"""Encoding and decoding of whole Arrow batches with numpy, without a Python step for each byte or token."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array in a row, and where each value begins and the last ends; null has none."""
    values = pc.fill_null(values, b"").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def picked(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of pool one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(begins - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]


def slices(values: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Parts of an array of bytes or of lists that hold about `most` bytes or elements each, one value at least."""
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield values[at:upto]
        at = upto


def batch_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut as `slices` cuts that column."""
    for batch in batches:
        at = 0
        for part in slices(batch.column(column)):
            yield batch.slice(at, len(part))
            at += len(part)


def lists_of(values: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of int between offsets, null where `like` is."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pc.is_null(like))


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of the numbers between offsets, for each two that follow each other."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((values.itemsize * offsets).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def symbol_ids(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbol strings (see mergeloom.functions.symbols) in a row, and where each string's begin and the last end."""
    data, offsets = flat_bytes(strings.cast(pa.binary()))
    four = data.reshape(-1, 4).astype(np.int32)  # U+10000 to U+1FFFF have four bytes
    return ((four[:, 1] & 15) << 12) | ((four[:, 2] & 63) << 6) | (four[:, 3] & 63), offsets // 4


def symbol_strings(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Symbol strings of ids."""
    four = np.empty((len(ids), 4), np.uint8)
    four[:, 0], four[:, 1], four[:, 2], four[:, 3] = 0xF0, 0x90 | ids >> 12, 0x80 | ids >> 6 & 63, 0x80 | ids & 63
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(four.tobytes())])


def pair_keys(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids within each row as a * 2**16 + b, without those that hold id 0, and the row of each."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    near = np.flatnonzero((row[1:] == row[:-1]) & (ids[1:] > 0) & (ids[:-1] > 0))
    return (ids[near].astype(np.int64) << 16) + ids[near + 1], row[near]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the exact sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


class MergeTable:
    """Merges by rank, for many texts at once.

    self_pair: how a run of a pair of equal symbols is read, see mergeloom.functions.symbols.merged.
    """

    def __init__(self, merges: list[tuple[int, int, int]], self_pair: str = "greedy"):
        self.size, self.collapse = max([256, *(m[2] + 1 for m in merges)]), self_pair == "collapse"
        self.merges = merges
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        self.keys, self.ranks = np.unique(keys, return_index=True)  # a pair is merged when it first comes up

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of symbols; -1 for none."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def apply(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every merge once, in order, from left to right within each text: ids, and where each text's begin and the last end.

        Places wait by the rank of their pair; a merge looks only at those that wait for it
        and gives its neighbours a new rank, which counts if it is still to come.
        """
        n = len(data)
        symbol = data.astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = offsets[1:] > offsets[:-1]
        after[offsets[1:][full] - 1] = -1
        before[offsets[:-1][full]] = -1
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray, above: int) -> None:
            rank = self.rank(symbol[places], symbol[after[places]])
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            first = np.searchsorted(rank, above, "right")
            cuts = np.r_[first, first + np.flatnonzero(np.diff(rank[first:])) + 1, len(rank)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < b:
                    r = int(rank[a])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(places[a:b])

        wait(np.flatnonzero(after >= 0), -1)
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.merges[r]
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places] & (symbol[places] == a) & (after[places] >= 0)]
            places = places[symbol[after[places]] == b]
            gone = last = after[places]
            if a == b and len(places):
                starts = np.r_[True, after[places[:-1]] != places[1:]]
                if self.collapse:  # a whole run
                    places, last = places[starts], gone[np.r_[starts[1:], True]]
                else:  # of a run every other pair, from its left end
                    inside = np.arange(len(places)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
                    places = places[inside % 2 == 0]
                    gone = last = after[places]
            symbol[places], alive[gone] = new, False
            after[places] = after[last]
            right = after[places]
            before[right[right >= 0]] = places[right >= 0]
            left = before[places]
            near = np.unique(np.r_[places[right >= 0], left[left >= 0]])
            if len(near):
                wait(near, r)
        return symbol[alive], np.r_[0, np.cumsum(alive)][offsets]


    def apply_rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As apply, for many short rows: in each step every row takes the first of its merges that are still to come."""
        later = np.int64(len(self.merges))  # no merge
        news = np.array([m[2] for m in self.merges], np.int32)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        taken = np.full(len(offsets) - 1, -1, np.int64)  # the last merge of each row
        finished: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(symbol: np.ndarray, row: np.ndarray, places: np.ndarray) -> np.ndarray:
            """The merge of each place and the next one, if it is still to come in their row."""
            rank = np.full(len(places), later)
            inside = np.flatnonzero(places < len(symbol) - 1)
            inside = inside[row[places[inside]] == row[places[inside] + 1]]
            found = self.rank(symbol[places[inside]], symbol[places[inside] + 1])
            rank[inside] = np.where(found > taken[row[places[inside]]], found, later)
            return rank

        symbol = ids.astype(np.int32)
        rank = ranks(symbol, row, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sizes = np.diff(np.r_[first, len(row)])
            least = np.minimum.reduceat(rank, first)
            done = np.repeat(least == later, sizes)
            if done.any():
                finished.append((row[done], symbol[done]))
                symbol, row, rank = symbol[~done], row[~done], rank[~done]
                least, sizes = least[least < later], sizes[least < later]
                if not len(symbol):
                    break
            taken[row[np.r_[0, np.cumsum(sizes)[:-1]]]] = least
            here = rank == np.repeat(least, sizes)
            places = np.flatnonzero(here)
            gone = np.zeros(len(symbol) + 1, bool)
            gone[places + 1] = True
            equal = symbol[places] == symbol[places + 1]
            if equal.any():  # runs of a pair of equal symbols: the first place of each pair or of the whole run
                starts = np.r_[True, places[1:] != places[:-1] + 1] | ~equal
                inside = np.arange(len(places)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
                heads = starts if self.collapse else inside % 2 == 0
                if not self.collapse:
                    gone[places[~heads] + 1] = False
                    gone[places[heads] + 1] = True
                places = places[heads]
            symbol[places] = news[rank[places]]
            kept = ~gone[:-1]
            at = np.cumsum(kept) - 1
            symbol, row, rank, places = symbol[kept], row[kept], rank[kept], at[places]
            # a merge that is over is over for the whole row
            rank = np.where(rank > taken[row], rank, later)
            near = np.unique(np.r_[places, places[places > 0] - 1])
            rank[near] = ranks(symbol, row, near)
        row = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in finished]])
        symbol = np.concatenate([np.zeros(0, np.int32), *[f[1] for f in finished]])
        order = np.argsort(row, kind="stable")
        return symbol[order], np.searchsorted(row[order], np.arange(len(offsets)))


class Trie:
    """A vocabulary as transitions between nodes, for many places at once."""

    #: Nodes of a trie whose transitions are also kept as a table (4 MB).
    SMALL = 4096

    def __init__(self, vocabulary: list[bytes]):
        children: dict[tuple[int, int], int] = {}
        token = [-1]
        for k, value in enumerate(vocabulary):
            at = 0
            for byte in value:
                at = children.setdefault((at, byte), len(token))
                if at == len(token):
                    token.append(-1)
            if value:
                token[at] = k  # of equal tokens the last counts
        self.token = np.array(token, np.int32)
        keys = np.array([node * 256 + byte for node, byte in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(children.values()), np.int32)[order]
        self.inner = np.zeros(len(token), bool)  # nodes that others follow
        self.inner[self.keys >> 8] = True
        self.table: np.ndarray | None = None  # a small trie's nodes by key, 0 for none
        if len(token) <= self.SMALL:
            self.table = np.zeros(256 * len(token), np.int32)
            self.table[self.keys] = self.to

    def after(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that follow nodes by bytes, 0 for none."""
        key = node.astype(np.int64) * 256 + byte
        if self.table is not None:
            return self.table[key]
        if not len(self.keys):
            return np.zeros(len(key), np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and length of the longest token at each place that ends by the place's entry of ends; else the byte."""
        lengths = np.ones(len(data), np.int32)
        first = self.after(np.zeros(256, np.int32), np.arange(256))  # by byte
        single, goes_on = self.token[first], self.inner[first] & (first > 0)
        ids = np.where((first > 0) & (single >= 0), single, np.arange(256, dtype=np.int32))[data]
        place = np.flatnonzero(goes_on[data])
        node, n = first[data[place]], 1
        while len(place):
            inside = place + n < ends[place]
            place, node = place[inside], node[inside]
            node = self.after(node, data[place + n])
            place, node, n = place[node > 0], node[node > 0], n + 1
            token = self.token[node]
            whole = token >= 0
            ids[place[whole]], lengths[place[whole]] = token[whole], n
            place, node = place[self.inner[node]], node[self.inner[node]]
        return ids, lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match from left to right in chunks of `size` bytes of each value.

        Ids of all chunks; where each chunk's begin and the last end; and where each value's chunks begin and the last end.
        """
        counts = -(-np.diff(offsets) // size)
        value = np.repeat(np.arange(len(counts)), counts)
        chunk = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
        begins = offsets[value] + chunk * size
        ends = np.minimum(begins + size, offsets[value + 1])
        ids, lengths = self.longest(data, np.repeat(ends, ends - begins))
        on_path = np.ones(len(data), bool)
        wide = np.flatnonzero(lengths > 1)
        reach = wide + lengths[wide]
        # a token that none before reaches into is on the path, and so is the next one from the end of a token on the path
        head = np.r_[True, wide[1:] >= np.maximum.accumulate(reach)[:-1]] if len(wide) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        while len(at):  # all of them step by step together
            place, end = wide[at] + 1, reach[at]
            while len(place):
                on_path[place] = False
                more = place + 1 < end
                place, end = place[more] + 1, end[more]
            at = np.searchsorted(wide, reach[at])
            at = at[at < len(wide)]
            at = at[~head[at]]
        before = np.r_[0, np.cumsum(on_path)]
        return ids[on_path], np.r_[before[begins], before[-1]], np.r_[0, np.cumsum(counts)]
