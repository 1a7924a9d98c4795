"""Words of a batch of texts found and hashed with numpy, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space that separates words, \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
MULTIPLIER = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


class Words(NamedTuple):
    """Words of a batch: bytes data[starts[k]:ends[k]]; counts has the number for each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


@lru_cache(maxsize=1)
def lower_case() -> np.ndarray:
    """Each byte, those of A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over each other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array one after the other, and where each text begins and the last ends."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(texts: pa.Array, separators: bytes = SPACE) -> Words:
    """Maximal runs of bytes that are not separators, text by text; a null text has none."""
    data, offsets = text_bytes(texts)
    wordly = np.ones(256, bool)
    wordly[list(separators)] = False
    inside = wordly[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (border[:-1] | ~before))
    ends = np.flatnonzero(inside & (border[1:] | ~after)) + 1
    return Words(data, starts, ends, np.diff(np.searchsorted(starts, offsets)))


#: The first k bytes of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", data.tobytes() + bytes(8), strides=(1,))


def hash_words(words: Words, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; if folded alike for upper and lower case of A-Z.

    Eight bytes at a time go into two sums, each of which is mixed before the next eight, so
    that a word's hash is no linear function of its bytes. Long words have a cryptographic digest.
    """
    data = lower_case()[words.data] if folded else words.data
    sizes = words.ends - words.starts
    block_at = eights(data)
    with np.errstate(over="ignore"):
        one, two = mixed(sizes.astype(np.uint64)), mixed(sizes.astype(np.uint64) + np.uint64(MULTIPLIER))
        at = np.flatnonzero(sizes <= LONG_WORD)
        for begin in range(0, LONG_WORD, 8):
            if not len(at):
                break
            left = sizes[at] - begin
            block = block_at[words.starts[at] + begin] & MASKS[np.minimum(left, 8)]
            one[at] = mixed(one[at] ^ block)
            two[at] = mixed(two[at] * np.uint64(MULTIPLIER) + block)
            at = at[left > 8]
        out = mixed(one + two * np.uint64(MULTIPLIER))
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(data[words.starts[k] : words.ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Numbers:
    """Numbers of 64-bit hashes: sorted arrays, and a dictionary of the last RECENT ones, which keeps memory low."""

    RECENT = 50_000

    def __init__(self):
        self.recent: dict[int, int] = {}
        self.known, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for those not added yet."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            found = self.known[at] == hashes
            out[found] = self.numbers[at[found]]
        rest = np.flatnonzero(out < 0)
        out[rest] = [self.recent.get(h, -1) for h in hashes[rest].tolist()]
        return out

    def add(self, hashes: list[int], first: int) -> None:
        """Number new hashes from first on."""
        self.recent.update(zip(hashes, range(first, first + len(hashes)), strict=True))
        if len(self.recent) > self.RECENT:
            known = np.r_[self.known, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))]
            numbers = np.r_[self.numbers, np.fromiter(self.recent.values(), np.int32, len(self.recent))]
            order = np.argsort(known)
            self.known, self.numbers, self.recent = known[order], numbers[order], {}


class KnownWords:
    """Numbers of words by their hash, each confirmed by the word's bytes; words whose hash is another's are known by their bytes.

    `beside` is a number that tells words of the same bytes apart.
    """

    def __init__(self):
        self.numbers, self.clashes = Numbers(), {}
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint8), 0, 0
        self.begins, self.sizes, self.beside = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _keep(self, words: Words, which: np.ndarray, beside: np.ndarray) -> None:
        sizes = words.ends[which] - words.starts[which]
        n, total = self.held + len(which), self.used + int(sizes.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(total, np.uint8)])
        if n > len(self.begins):
            self.begins, self.sizes, self.beside = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.begins, self.sizes, self.beside))
        self.begins[self.held : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.held : n], self.beside[self.held : n] = sizes, beside[which]
        self.pool[self.used : total] = words.data[places(words.starts[which], sizes)]
        self.used, self.held = total, n

    def _others(self, words: Words, slots: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """Which words differ from the one that their number stands for."""
        sizes = words.ends - words.starts
        same = (self.sizes[slots] == sizes) & (self.beside[slots] == beside)
        at, size = slots[same], sizes[same]
        owner = np.flatnonzero(same)
        here, there = eights(words.data), eights(self.pool[: self.used])
        mine, kept, left = words.starts[same], self.begins[at], size
        while len(owner):
            apart = (here[mine] ^ there[kept]) & MASKS[np.minimum(left, 8)] != 0
            same[owner[apart]] = False
            more = (left > 8) & ~apart
            owner, mine, kept, left = owner[more], mine[more] + 8, kept[more] + 8, left[more] - 8
        return np.flatnonzero(~same)

    def slots(self, words: Words, hashes: np.ndarray, beside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and which words got the new numbers, in their order."""
        beside = np.zeros(len(hashes), np.int64) if beside is None else beside
        distinct, inverse = np.unique(hashes, return_inverse=True)
        first = np.zeros(len(distinct), np.int64)
        first[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        number = self.numbers.find(distinct)
        new = np.flatnonzero(number < 0)
        number[new] = self.held + np.arange(len(new))
        self.numbers.add(distinct[new].tolist(), self.held)
        added = first[new]
        self._keep(words, added, beside)
        slots = number[inverse]
        for k in self._others(words, slots, beside).tolist():
            word = (words.data[words.starts[k] : words.ends[k]].tobytes(), int(beside[k]))
            if word not in self.clashes:
                self.clashes[word] = self.held
                added = np.r_[added, k]
                self._keep(words, np.array([k]), beside)
            slots[k] = self.clashes[word]
        return slots, added


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges of these starts and sizes, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, text by text, and how many each text has.

    A text of fewer words, one at least, has its whole sequence as its only run.
    """
    ends = np.cumsum(counts)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(runs.sum())
    starts = np.repeat(ends - counts - (np.cumsum(runs) - runs), runs) + np.arange(total)
    last = np.repeat(ends, runs)
    padded = np.r_[hashes, np.zeros(size, np.uint64)]
    with np.errstate(over="ignore"):
        value = np.repeat(np.minimum(counts, size), runs).astype(np.uint64)
        for k in range(size):
            here = starts + k
            value = mixed(value * np.uint64(MULTIPLIER) + np.where(here < last, padded[here], np.uint64(0)))
        return value, runs


def minima(values: np.ndarray, counts: np.ndarray, hashes: int, seed: int = 1) -> np.ndarray:
    """The least value of each universal hash a * x + b over each text's values; all ones where it has none.

    values are well-mixed unsigned integers of 32 or 64 bits, and so are the minima.
    """
    kind, block = values.dtype.type, 512
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(kind)[:, None]
    b = (rng.integers(0, 1 << 63, hashes, dtype=np.uint64) >> np.uint64(9)).astype(kind)[:, None]
    out = np.full((len(counts), hashes), np.iinfo(kind).max, kind)
    room = np.empty((hashes, block), kind)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        for k, (begin, end) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            for at in range(begin, end, block):
                part = values[at : min(end, at + block)]
                hashed = room[:, : len(part)]
                np.multiply(a, part, out=hashed)
                np.add(hashed, b, out=hashed)
                np.minimum(out[k], hashed.min(axis=1), out=out[k])
    return out


def row_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto
