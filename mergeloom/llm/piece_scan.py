"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The model at hand is of the BPE kind. A row of pieces is the BPE encoding of its text when
no two neighbours in it are such that BPE, given their text alone, would have joined
across the border between them. That makes encoding a path problem: states are (place,
last piece), a step to a piece costs its score, or minus infinity where BPE would not leave
it next to the last one, and the one path left is BPE's. Whether two pieces may stand
side by side is found by undoing their merges, latest first.

A chunk is a matrix: the best score from each piece that may cross its first border to
each that may cross its last, minus infinity where there is no way. Matrices combine
associatively under (max, +), in a tree of bounded groups; once the pieces at all borders
are known, each chunk is traced back by itself. Giant documents are cut into chunks that
Spark deals to different tasks. Other texts are cut where no piece can cross, before a run
of spaces; equal words are traced once for a batch, and long runs without such a cut are
chunked.

Defined results for odd input
-----------------------------
* A null text has null ids; an empty one has none. Texts of any length are encoded whole.
* Characters without a piece become byte pieces; decoding what was encoded gives the text
  back exactly, leading spaces included.
* Of two equal merges the one further left comes first, as in the library.
* Null ids and repeated rows keep their own rows; an empty table gives an empty result.
* Columns other than those named by the arguments are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch
from mergeloom.llm.words import KnownWords, Words, find_words, hash_words, mixed, row_slices, text_bytes

SPACE = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NOWHERE = -np.inf
#: Rank of what no merge makes, and a limit above all ranks.
BASE, NO_LIMIT = -1, 1 << 40
#: Characters of the chunks within a task, and lanes that are followed at once.
INNER, LANES = 64, 8192
#: Matrices that are combined in one task.
FAN = 64


class Chunk(NamedTuple):
    """Characters codes[before : before + size], with up to longest - 1 more on both sides; last: the text ends with it."""

    codes: np.ndarray
    before: int
    size: int
    last: bool


class States(NamedTuple):
    """Pieces that may cross a border: where they begin and end, seen from the border, and their symbols."""

    begins: np.ndarray
    ends: np.ndarray
    symbols: np.ndarray


class Pieces:
    """A model's pieces as symbols, with the merges that make them.

    Symbols are the pieces' ids, then numbers for single characters that only occur
    within pieces, one for all other characters, and one that stands before a text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.size = sp.get_piece_size()
        self.text: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[piece] = i
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.longest = max(map(len, normal))
        #: Whether no piece has a space after another character, so that texts may be cut there.
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in normal)
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p} - normal.keys()):
            symbols[c] = size + len(symbols) - len(normal)
        self.other = size + len(symbols) - len(normal)
        self.start = self.other + 1
        scores = np.array([sp.get_score(i) for i in range(size)])
        merged = sorted((p for p in normal if len(p) > 1), key=lambda p: -scores[normal[p]])
        self._merges(symbols, {p: r for r, p in enumerate(merged)})
        #: Weight of a step to a symbol; characters without a piece weigh as much as the worst piece.
        self.scores = np.r_[scores, np.full(self.start + 1 - size, scores[list(normal.values())].min())]
        self._prefixes(symbols)
        self.asked = np.full(1 << 20, -1, np.int64)
        self.answers = np.zeros(1 << 20, bool)
        self._forget()

    def _merges(self, symbols: dict[str, int], ranks: dict[str, int]) -> None:
        """rank, left and right of each symbol by its last merge, and the rank that joins each pair of symbols."""
        n = self.start + 1
        self.rank = np.full(n, BASE, np.int64)
        self.left = self.right = np.zeros(0)
        left, right, self.reached = np.zeros(n, np.int64), np.zeros(n, np.int64), set()
        keys, values = [], []
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    values.append(rank)
            parts = list(piece)
            while len(parts) > 1:
                found = [ranks.get(a + b, NO_LIMIT) for a, b in zip(parts, parts[1:], strict=False)]
                at = found.index(min(found))
                if found[at] == NO_LIMIT:
                    break  # BPE never makes this piece
                if len(parts) == 2:
                    i = symbols[piece]
                    self.rank[i], left[i], right[i] = rank, symbols[parts[0]], symbols[parts[1]]
                    self.reached.add(piece)
                parts[at : at + 2] = ["".join(parts[at : at + 2])]
        order = np.argsort(keys)
        self.left, self.right = left, right
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def _prefixes(self, symbols: dict[str, int]) -> None:
        """Hashes of the beginnings of pieces by length, with the symbol that each is, or -1."""
        prefixes: list[set[str]] = [set() for _ in range(self.longest + 1)]
        for p in symbols:
            for n in range(1, len(p) + 1):
                prefixes[n].add(p[:n])
        self.prefix_hashes, self.prefix_symbols = [], []
        for n in range(1, self.longest + 1):
            names = sorted(prefixes[n])
            h = np.zeros(len(names), np.uint64)
            codes = np.array([[ord(c) for c in p] for p in names], np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = (h + codes[:, k] + np.uint64(1)) * FACTOR
            h = mixed(h)
            order = np.argsort(h)
            self.prefix_hashes.append(h[order])
            self.prefix_symbols.append(np.array([symbols[p] if p in symbols and (n == 1 or p in self.reached) else -1 for p in names], np.int32)[order])

    def arcs(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols that begin at each place of codes and end by the place's entry of ends: places, length - 1; -1 for none."""
        out = np.full((len(codes), self.longest), -1, np.int32)
        out[:, 0] = self.other
        place, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                inside = place + n <= ends[place]
                place, h = place[inside], h[inside]
                if not len(place):
                    break
                h = (h + codes[place + n - 1].astype(np.uint64) + np.uint64(1)) * FACTOR
                key, table = mixed(h), self.prefix_hashes[n - 1]
                at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                known = table[at] == key
                place, h, at = place[known], h[known], at[known]
                out[place, n - 1] = self.prefix_symbols[n - 1][at]
        return out

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves symbol a before symbol b: no merge across their border comes before those that made them."""
        n, out = self.start + 1, np.zeros(len(a), bool)
        open_, limit = np.arange(len(a)), np.full(len(a), NO_LIMIT)
        while len(open_):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joined = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            rank_a, rank_b = self.rank[a], self.rank[b]
            whole = (rank_a == BASE) & (rank_b == BASE)
            out[open_[whole & ~joined]] = True
            go = ~joined & ~whole
            a, b, open_, rank_a, rank_b = a[go], b[go], open_[go], rank_a[go], rank_b[go]
            later = rank_a > rank_b  # the later merge is undone; of equal ones the right
            limit = np.where(later, rank_a, rank_b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_undone with a memory of answers."""
        key = a.astype(np.int64) * (self.start + 1) + b
        with np.errstate(over="ignore"):
            slot = (key.view(np.uint64) * FACTOR >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.asked[slot] != key)
        out = self.answers[slot]
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            found = self._undone(*np.divmod(asked, self.start + 1))
            out[new] = found[back]
            self.asked[slot[new]], self.answers[slot[new]] = key[new], out[new]
        return out

    def _words(self, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (longest first, one after the other in codes), in the words' order, and each word's number of ids."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        arcs = self.arcs(codes, np.repeat(ends, sizes))
        borders = begins + np.arange(len(sizes))  # a word has one border more than characters
        last = np.full(len(codes) + len(sizes), -1, np.int32)
        last[borders] = self.start
        for i in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            open_ = np.arange(np.searchsorted(-sizes, -i, "right"))
            for n in range(1, min(i, self.longest) + 1):
                symbol = arcs[begins[open_] + i - n, n - 1]
                there = np.flatnonzero(symbol >= 0)
                before = last[borders[open_[there]] + i - n]
                fits = self.side_by_side(before, symbol[there])
                last[borders[open_[there[fits]]] + i] = symbol[there[fits]]
                open_ = np.delete(open_, there[fits])
                if not len(open_):
                    break
        return self._traced(last, borders, np.zeros(len(sizes), np.int64), sizes, codes, begins)

    def _traced(self, last: np.ndarray, borders: np.ndarray, enter: np.ndarray, at: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from `enter` to `at` of each lane, lane by lane, and how many each has; characters without a piece in bytes."""
        found, lanes, places = [], [], []
        open_ = np.flatnonzero(at > enter)
        while len(open_):
            symbol = last[borders[open_] + at[open_]]
            at = at.copy()
            at[open_] -= self.lengths[symbol]
            found.append(symbol)
            lanes.append(open_)
            places.append(begins[open_] + at[open_])
            open_ = open_[at[open_] > enter[open_]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
        symbol, lane, place = (np.concatenate(x[::-1]) for x in (found, lanes, places))
        order = np.argsort(lane, kind="stable")
        symbol, lane, place = symbol[order].astype(np.int64), lane[order], place[order]
        return self.spelled(symbol, codes[place], np.bincount(lane, minlength=len(borders)))

    def spelled(self, symbols: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, those that are no piece by the bytes of their character (codes), and the lanes' counts."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, counts
        spelt = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in codes[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(s) for s in spelt]
        ends = np.cumsum(width)
        out = np.repeat(symbols, width)
        for k, s in zip(odd.tolist(), spelt, strict=True):
            out[ends[k] - width[k] : ends[k]] = s
        lane = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(lane, weights=width, minlength=len(counts)).astype(np.int64)

    def states(self, arcs: np.ndarray, border: int) -> States:
        """Pieces that begin before the border and end there or later, in a fixed order."""
        first = max(0, border - self.longest)
        place, n = np.nonzero(arcs[first:border] >= 0)
        keep = first + place + n + 1 >= border
        place, n = first + place[keep], n[keep]
        return States(place - border, place + n + 1 - border, arcs[place, n])

    def _sides(self, chunk: Chunk) -> tuple[np.ndarray, States, States]:
        """Arcs of a chunk's window and the states at its two borders; a text's own borders have one state each."""
        arcs = self.arcs(chunk.codes, np.full(len(chunk.codes), len(chunk.codes)))
        outer = States(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([self.start], np.int32))
        return arcs, self.states(arcs, chunk.before) if chunk.before else outer, outer if chunk.last else self.states(arcs, chunk.before + chunk.size)

    def _follow(self, chunks: list[tuple[np.ndarray, int, int]], lanes: np.ndarray, enter: np.ndarray, symbol: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each lane and place of its chunk the last symbol of the way there (-1: none) and the way's score.

        chunks: arcs and `before`, of chunks of one size; lanes: the chunk of each lane; enter,
        symbol: where its first symbol ends and which it is.
        """
        arcs = np.stack([a[before : before + size] for a, before, _ in chunks])
        last = np.full((len(lanes), size + 1), -1, np.int32)
        score = np.full((len(lanes), size + 1), NOWHERE)
        every = np.arange(len(lanes))
        last[every, enter], score[every, enter] = symbol, 0
        for i in range(1, size + 1):
            open_ = np.flatnonzero(last[:, i] < 0)
            for n in range(1, min(i, self.longest) + 1):
                if not len(open_):
                    break
                to = arcs[lanes[open_], i - n, n - 1]
                before = last[open_, i - n]
                there = np.flatnonzero((to >= 0) & (before >= 0))
                fits = there[self.side_by_side(before[there], to[there])]
                own = open_[fits]
                last[own, i], score[own, i] = to[fits], score[own, i - n] + self.scores[to[fits]]
                open_ = np.delete(open_, fits)
        return last, score

    def _batches(self, chunks: list[Chunk], width: list[int]):
        """Numbers of chunks of one size, with about LANES lanes together."""
        groups: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            groups.setdefault(c.size, []).append(k)
        for size, own in groups.items():
            ends = np.cumsum([width[k] for k in own])
            part = ends // LANES
            for p in np.unique(part).tolist():
                yield [own[k] for k in np.flatnonzero(part == p).tolist()], size

    def matrices(self, chunks: list[Chunk]) -> list[np.ndarray]:
        """For each chunk the best scores from the states at its first border to those at its last."""
        sides = [self._sides(c) for c in chunks]
        out: list[np.ndarray] = [np.zeros((0, 0))] * len(chunks)
        for own, size in self._batches(chunks, [len(s[1].ends) for s in sides]):
            enter = [sides[k][1] for k in own]
            lanes = np.repeat(np.arange(len(own)), [len(s.ends) for s in enter])
            ends, symbols = np.concatenate([s.ends for s in enter]), np.concatenate([s.symbols for s in enter])
            past = ends > size  # a chunk at the text's end may be shorter than a piece; none passes the end
            last, score = self._follow([(sides[k][0], chunks[k].before, size) for k in own], lanes, np.minimum(ends, size), symbols, size)
            score[past] = NOWHERE
            rows = np.r_[0, np.cumsum([len(s.ends) for s in enter])]
            for j, k in enumerate(own):
                mine, leave = slice(rows[j], rows[j + 1]), sides[k][2]
                if chunks[k].last:
                    out[k] = score[mine, size : size + 1]
                    continue
                at = size + leave.begins
                before, so_far = last[mine][:, np.maximum(at, 0)], score[mine][:, np.maximum(at, 0)]
                ok = (before >= 0) & (at >= 0)
                i, s = np.nonzero(ok)
                ok[i, s] = self.side_by_side(before[i, s], leave.symbols[s])
                out[k] = np.where(ok, so_far + self.scores[leave.symbols], NOWHERE)
        return out

    def traces(self, chunks: list[Chunk], enter: list[int], leave: list[int]) -> list[np.ndarray]:
        """For each chunk the ids that begin in it, on the way from one state to another (numbers of states)."""
        sides = [self._sides(c) for c in chunks]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chunks)
        for own, size in self._batches(chunks, [1] * len(chunks)):
            ends = np.array([sides[k][1].ends[enter[k]] for k in own])
            symbols = np.array([sides[k][1].symbols[enter[k]] for k in own])
            last, _ = self._follow([(sides[k][0], chunks[k].before, size) for k in own], np.arange(len(own)), ends, symbols, size)
            at = np.array([size if chunks[k].last else size + sides[k][2].begins[leave[k]] for k in own])
            codes = np.concatenate([chunks[k].codes for k in own])
            starts = np.cumsum([len(chunks[k].codes) for k in own]) - [len(chunks[k].codes) - chunks[k].before for k in own]
            ids, counts = self._traced(last.ravel(), np.arange(len(own)) * (size + 1), ends, at, codes, starts)
            stops = np.cumsum(counts)
            for k, a, b, upto in zip(own, (stops - counts).tolist(), stops.tolist(), at.tolist(), strict=True):
                out[k] = ids[a:b]
                if not chunks[k].last:
                    symbol = sides[k][2].symbols[leave[k]]
                    crossing, _ = self.spelled(np.array([symbol], np.int64), chunks[k].codes[chunks[k].before + upto :][:1], np.ones(1, np.int64))
                    out[k] = np.r_[out[k], crossing]
        return out

    def chunked(self, codes: np.ndarray, size: int, before: int = 0, upto: int | None = None, last: bool = True) -> list[Chunk]:
        """Chunks of `size` characters of codes[before:upto]; the last may be shorter and ends the text if `last`."""
        upto, k = len(codes) if upto is None else upto, self.longest
        return [
            Chunk(codes[max(0, a - k) : min(len(codes), a + size + k)], min(a, k), min(size, upto - a), last and a + size >= upto)
            for a in range(before, upto, size)
        ]

    def long_runs(self, runs: list[np.ndarray], size: int) -> list[np.ndarray]:
        """Ids of long runs by chunks."""
        return self.traced_between([self.chunked(codes, size) for codes in runs], [0] * len(runs), [0] * len(runs))

    def traced_between(self, chunks: list[list[Chunk]], enter: list[int], leave: list[int]) -> list[np.ndarray]:
        """Ids of rows of chunks, given the states where each row is entered and left."""
        every = [c for own in chunks for c in own]
        found = iter(self.matrices(every))
        cuts = [states_at_borders(list(islice(found, len(own))), a, b) for own, a, b in zip(chunks, enter, leave, strict=True)]
        traced = iter(self.traces(every, [s for c in cuts for s in c[:-1]], [s for c in cuts for s in c[1:]]))
        return [np.concatenate(list(islice(traced, len(own)))) for own in chunks]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of texts with the spaces in front of them, cut where no piece crosses: data, begin, end, spaces; and each text's number of words.

        A text has one space more in front. Spaces at its end are a word without letters.
        """
        array = pa.array(texts, pa.binary())
        found = find_words(array, b" " if self.cuts_at_spaces else b"")
        offsets = text_bytes(array)[1]
        full = np.flatnonzero(found.counts)
        stops = np.cumsum(found.counts)
        before = np.r_[0, found.ends[:-1]] if len(found.ends) else found.ends
        before[(stops - found.counts)[full]] = offsets[full] - 1
        last = offsets[:-1] - 1
        last[full] = found.ends[stops[full] - 1]
        behind = np.where(offsets[1:] > offsets[:-1], offsets[1:] - last, 0)
        behind[full] = (offsets[1:] - last)[full]
        tails = np.flatnonzero(behind)
        put = lambda x, y: np.insert(x, stops[tails], y)
        return found.data, put(found.starts, 0), put(found.ends, 0), put(found.starts - before, behind[tails]), found.counts + (behind > 0)

    def _forget(self) -> None:
        #: Characters that each symbol has; what no piece is has one.
        self.lengths = np.ones(self.start + 1, np.int64)
        self.lengths[: self.size] = [max(1, len(t.decode("utf-8", "replace"))) for t in self.text]
        self.known = KnownWords()
        self.held = 0
        self.ids = np.zeros(0, np.int32)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str], chunk: int) -> None:
        """Trace new words and keep their ids."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(-sizes, kind="stable")
        short = order[sizes[order] <= chunk]
        codes = np.frombuffer("".join([new[k] for k in short.tolist()]).encode("utf-32-le"), np.uint32)
        pool, lengths = self._words(sizes[short], codes)
        at, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        at[short], n[short] = np.cumsum(lengths) - lengths, lengths
        long = np.flatnonzero(sizes > chunk)
        if len(long):
            runs = self.long_runs([np.frombuffer(new[k].encode("utf-32-le"), np.uint32) for k in long.tolist()], chunk)
            n[long] = [len(ids) for ids in runs]
            at[long] = len(pool) + np.cumsum(n[long]) - n[long]
            pool = np.concatenate([pool, *runs])
        self.at, self.count = np.r_[self.at, at + len(self.ids)], np.r_[self.count, n]
        self.ids = np.r_[self.ids, pool.astype(np.int32)]
        self.held += int(sizes.sum())

    def encode(self, texts: list[bytes], chunk: int = INNER) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin and the last end.

        Words met before are not traced again, until the kept ones pass a fixed size.
        """
        if self.held > 4_000_000:
            self._forget()
        data, begins, ends, spaces, counts = self.words(texts)
        words = Words(data, begins, ends, counts)
        with np.errstate(over="ignore"):
            keys = mixed(hash_words(words, False) + spaces.astype(np.uint64) * FACTOR)
        slot, new = self.known.slots(words, keys, spaces)
        if len(new):
            whole = data.tobytes()
            spans = zip(begins[new].tolist(), ends[new].tolist(), spaces[new].tolist(), strict=True)
            self._learn([SPACE * n + whole[a:b].decode("utf-8", "replace").replace(" ", SPACE) for a, b, n in spans], chunk)
        n = self.count[slot]
        return picked(self.ids, self.at[slot], n), np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of rows of ids, given where each row ends, without the space that encoding put in front."""
        sizes = self.sizes[ids]
        data = picked(self.pool, self.begins[ids], sizes)
        stops = np.r_[0, np.cumsum(sizes)][ends]
        starts = np.r_[0, stops[:-1]]
        full = stops > starts
        keep = np.ones(len(data), bool)
        keep[starts[full]] = False
        offsets = np.r_[0, np.cumsum(stops - starts - full)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    """One table of pieces for each Python worker."""
    return Pieces(model_file)


def picked(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of pool one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(begins - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of matrices in order, by halves."""
    while len(matrices) > 1:
        pairs = [(a[:, :, None] + b[None]).max(axis=1) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def states_at_borders(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The state at each border of the best way through chunks in order, from one state to another."""
    reach = [np.where(np.arange(matrices[0].shape[0]) == enter, 0.0, NOWHERE)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    cuts = [leave]
    for m, r in zip(matrices[::-1], reach[-2::-1], strict=True):
        cuts.append(int(np.argmax(r + m[:, cuts[-1]])))
    return cuts[::-1]


MATRIX = "row bigint, chunk bigint, n_in int, matrix binary"


def _unpacked(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float64).reshape(n, -1) for n, m in zip(frame["n_in"], frame["matrix"], strict=True)]


def borders_of_chunks(matrices: DataFrame, scratch: Scratch) -> DataFrame:
    """row, chunk, enter and leave (numbers of states) for the matrices (MATRIX) of each row's chunks.

    Groups of FAN neighbouring matrices are multiplied until one is left for each row;
    from there the states at the borders are handed down again, group by group. No task
    gets more than FAN matrices of a row.
    """

    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = combined(_unpacked(frame.sort_values("chunk")))
        return pd.DataFrame({"row": [key[0]], "chunk": [key[1]], "n_in": [m.shape[0]], "matrix": [m.tobytes()]})

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        cuts = states_at_borders(_unpacked(frame), int(frame["enter"].iloc[0]), int(frame["leave"].iloc[0]))
        return pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "enter": cuts[:-1], "leave": cuts[1:]})

    levels = [matrices]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        group = F.floor(F.col("chunk") / FAN).alias("chunk")
        levels.append(scratch.store(levels[-1].groupBy("row", group).applyInPandas(multiply, MATRIX), "piece-products"))
    cuts = levels[-1].select("row", "chunk", F.lit(0).cast("bigint").alias("enter"), F.lit(0).cast("bigint").alias("leave"))
    for level in levels[-2::-1]:
        above = cuts.select("row", F.col("chunk").alias("above"), "enter", "leave")
        held = level.withColumn("above", F.floor(F.col("chunk") / FAN)).join(above, ["row", "above"])
        cuts = held.groupBy("row", "above").applyInPandas(walk, "row bigint, chunk bigint, enter bigint, leave bigint")
    return cuts


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_file: str, giant_chars: int = 65_536, chunk_chars: int = 8192
) -> DataFrame:
    """id, row (a number that tells rows apart) and ids (array of int) for each row of docs.

    Texts of more than giant_chars characters are cut into chunks of chunk_chars that go
    to different tasks.
    """
    scratch = Scratch(docs.sparkSession, "piece-scan")
    listed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    giant = F.coalesce(F.length("text") > giant_chars, F.lit(False))

    def encode(batches):
        pieces = pieces_of(model_file)
        for batch in batches:
            for a, b in row_slices(batch.column(2)):
                texts = batch.column(2)[a:b].to_pylist()
                ids, at = pieces.encode([t or b"" for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], lists], ["id", "row", "ids"])

    plain = listed.where(~giant).select("id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(encode, "id bigint, row bigint, ids array<int>")

    def cut(batches):
        pieces = pieces_of(model_file)
        for batch in batches:
            for i, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = SPACE + text.decode("utf-8", "replace").replace(" ", SPACE)
                for n, c in enumerate(pieces.chunked(np.frombuffer(whole.encode("utf-32-le"), np.uint32), chunk_chars)):
                    values = ((i, pa.int64()), (row, pa.int64()), (n, pa.int64()), (c.before, pa.int32()), (c.size, pa.int32()), (c.last, pa.bool_()), (c.codes.tobytes(), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], ["id", "row", "chunk", "before", "size", "last", "codes"])

    def inner(pieces: Pieces, row: dict) -> list[Chunk]:
        return pieces.chunked(np.frombuffer(row["codes"], np.uint32), INNER, row["before"], row["before"] + row["size"], row["last"])

    def matrix(batches):
        pieces = pieces_of(model_file)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                chunks = [inner(pieces, r) for r in part.to_pylist()]
                found = iter(pieces.matrices([c for own in chunks for c in own]))
                out = [combined(list(islice(found, len(own)))) for own in chunks]
                columns = [pa.array([m.shape[0] for m in out], pa.int32()), pa.array([m.tobytes() for m in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["row", "chunk", "n_in", "matrix"])

    def trace(batches):
        pieces = pieces_of(model_file)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                rows = part.to_pylist()
                out = pieces.traced_between([inner(pieces, r) for r in rows], [r["enter"] for r in rows], [r["leave"] for r in rows])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("id", "row", "chunk")), pa.array(out, pa.list_(pa.int32()))], ["id", "row", "chunk", "ids"])

    big = listed.where(giant).select("id", "row", F.col("text").cast("binary").alias("text"))
    chunks = big.mapInArrow(cut, "id bigint, row bigint, chunk bigint, before int, size int, last boolean, codes binary")
    chunks = scratch.store(chunks.repartition("row", "chunk"), "piece-chunks")
    window = ["before", "size", "last", "codes"]
    matrices = scratch.store(chunks.select("row", "chunk", *window).mapInArrow(matrix, MATRIX), "piece-matrices")
    cuts = borders_of_chunks(matrices, scratch)
    traced = chunks.join(cuts, ["row", "chunk"]).select("id", "row", "chunk", *window, "enter", "leave")
    traced = traced.mapInArrow(trace, "id bigint, row bigint, chunk bigint, ids array<int>")
    joined = traced.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = joined.select("id", "row", F.flatten("parts.ids").alias("ids"))
    return plain.unionByName(whole).withColumnRenamed("id", id_col)
def decode_documents(rows: DataFrame, ids_col: str = "ids", *, model_file: str, out_col: str = "decoded", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep and the text of ids_col; null ids give a null text."""

    def decode(batches):
        pieces = pieces_of(model_file)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column(part.num_columns - 1)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = pieces.decode(lists.flatten().to_numpy(), np.cumsum(counts)).cast(pa.string())
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*batch.schema.names[:-1], out_col])

    kept = rows.select(*keep, ids_col)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), f"`{out_col}` string"])
    return kept.mapInArrow(decode, kinds)
