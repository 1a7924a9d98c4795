"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized and cut into pieces of at most `capacity` tokens; only the
pieces' lengths and checksums are kept. Full pieces are sequences by themselves. The
rest is dealt at random into groups of bounded size. Within a group pieces are packed
best-fit as they come; then moves and one-for-one and two-for-one exchanges between
underfull sequences raise the sum of squared fills until sequences run empty. Where the
search ends short of that, large pieces are left without small ones to go with: so what is
underfull is pooled over groups with a share of the full sequences and packed once more,
largest first, and searched again.

Defined results for odd input
-----------------------------
* A null or empty text is a document of one token, the end token.
* Null ids and repeated rows are packed like any other row, each in its own place.
* Texts of any length are cut; an empty table gives an empty result.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.words import KnownWords, Words, find_words, hash_words, lower_case, places, row_slices

#: The steps before BPE by which a tokenizer file is known to be of the kind that PLAIN and BEFORE_BPE repeat.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What SPLIT finds in plain words once they are in lower case, and the line feeds between them.
BEFORE_BPE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+|\n")
END_OF_WORD = "</w>"

PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, moved boolean"


class Parts(dict):
    """Numbers of the parts of words, given when first asked for; line feed is 0. fresh: those not tokenized yet, in order."""

    def __init__(self):
        self["\n"], self.fresh = 0, []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.fresh.append(part)
        return number


def plain_words(words: Words, which: np.ndarray, most: int = 256) -> np.ndarray:
    """Which of them hold only visible ASCII characters and letters of Latin-1, in `most` bytes at most.

    NFC leaves such words alone, and each of their characters has one in lower case.
    """
    sizes = words.ends[which] - words.starts[which]
    data = words.data[places(words.starts[which], sizes)]
    before = np.r_[np.uint8(0), data[:-1]]
    second = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)  # not the signs of multiplication and division
    fine = (data > 0x20) & (data < 0x7F) | (data == 0xC3) | second & (data < 0xC0)
    fine[:-1] &= (data[:-1] != 0xC3) | second[1:]
    ends = np.cumsum(sizes)
    fine[ends[data[ends - 1] == 0xC3] - 1] = False
    fine[(ends - sizes)[data[ends - sizes] >= 0x80]] &= data[(ends - sizes)[data[ends - sizes] >= 0x80]] == 0xC3
    return (np.add.reduceat(~fine, ends - sizes, dtype=np.int64) == 0) & (sizes <= most)


class WordEncoder:
    """Ids of texts for tokenizers that lower-case, drop white space and join nothing across it.

    A text's ids are then those of its words one after the other. Words are found and
    hashed in bulk and compared with the word known by that hash; each new one is tokenized once and its ids
    kept in a pool, which is emptied when it holds more than `most` words or eight times as many ids or bytes.
    Words alike but for case share their ids, save those that hold one of the file's
    added tokens, which are found before lower-casing: these are kept by their exact bytes.
    Where the file is of the kind named by NORMALIZER and SPLIT, plain words come to the library's BPE
    already in lower case and split, each distinct part once: the last id of a part is one that ends a word.
    """

    #: Words tokenized in one call, with a separator between them.
    TOGETHER = 100

    def __init__(self, tokenizer_file: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokenizer.model._resize_cache(0)  # each word comes once
        self.separator = "7"
        self.separator_id = self._ids([self.separator])[0][0]
        with open(tokenizer_file, encoding="utf-8") as file:
            kind = json.load(file)
        self.bare = None
        before = {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
        if kind["normalizer"] == NORMALIZER and kind["pre_tokenizer"] == before and kind["model"].get("end_of_word_suffix") == END_OF_WORD:
            kind |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTE_LEVEL]}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(kind))
            self.bare.model._resize_cache(0)
            vocabulary = self.bare.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[k for t, k in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.known = KnownWords()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.used = self.held = 0
        self._empty_parts()

    def _empty_parts(self) -> None:
        self.parts = Parts()
        self.part_ids = np.zeros(0, np.uint32)
        self.part_begins, self.part_lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ids(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        tokenizer = self.bare if bare else self.tokenizer
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words that hold the separator are tokenized alone."""
        out: list[np.ndarray] = [None] * len(words)
        alone = [k for k, w in enumerate(words) if self.separator in w or len(w) > 256]
        joined = sorted(set(range(len(words))) - set(alone))
        groups = [joined[k : k + self.TOGETHER] for k in range(0, len(joined), self.TOGETHER)]
        for group, ids in zip(groups, self._ids([f" {self.separator} ".join([words[k] for k in g]) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) != len(group) - 1:  # not the kind of tokenizer that this is for
                alone += group
                continue
            for k, a, b in zip(group, np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                out[k] = ids[a:b]
        for k, ids in zip(alone, self._ids([words[k] for k in alone]), strict=True):
            out[k] = ids
        return out

    def _plain(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain words, and how many each has."""
        if len(self.parts) > self.most:
            self._empty_parts()
        sizes = words.ends[which] - words.starts[which] + 1
        at = places(words.starts[which], sizes)
        ends = np.cumsum(sizes) - 1
        at[ends] = 0
        data = words.data[at]
        data[ends] = ord("\n")
        parts = BEFORE_BPE.findall(data.tobytes().decode().lower())
        number = np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))
        new, self.parts.fresh = self.parts.fresh, []
        if new:
            ids = np.concatenate(self._ids([" ".join(new[k : k + self.TOGETHER]) for k in range(0, len(new), self.TOGETHER)], bare=True))
            upto = np.flatnonzero(self.ends_word[ids]) + 1
            lengths = np.diff(upto, prepend=0)
            self.part_begins = np.r_[self.part_begins, len(self.part_ids) + upto - lengths]
            self.part_lengths = np.r_[self.part_lengths, lengths]
            self.part_ids = np.r_[self.part_ids, ids]
            if len(self.part_lengths) != len(self.parts) or upto[-1] != len(ids):
                raise ValueError("parts of words and ids that end a word differ in number")
        size = self.part_lengths[number]
        return self.part_ids[places(self.part_begins[number], size)], np.diff(np.cumsum(size)[number == 0], prepend=0)

    def _learn(self, words: Words, new: np.ndarray, exact: np.ndarray) -> None:
        """Keep the ids of the words `new`; exact: words that hold an added token."""
        plain = plain_words(words, new) & ~np.isin(new, exact) if self.bare else np.zeros(len(new), bool)
        lengths, begins = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        ids, sizes = self._plain(words, new[plain]) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        others = new[~plain]
        each = self._words([words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.starts[others].tolist(), words.ends[others].tolist(), strict=True)])
        lengths[plain], lengths[~plain] = sizes, [len(x) for x in each]
        begins[plain], begins[~plain] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(lengths[~plain]) - lengths[~plain]
        n, total = self.held, int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(new) > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.pool[self.used : self.used + total] = np.concatenate([ids, *each])
        self.lengths[n : n + len(new)] = lengths
        self.begins[n : n + len(new)] = self.used + begins
        self.used, self.held = self.used + total, n + len(new)

    def _folded(self, words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words in lower case and their hashes; those that hold an added token as they are, and which these are."""
        data = lower_case()[words.data]
        spans = np.array([m.span() for m in self.added.finditer(words.data)] if self.added else [], np.int64).reshape(-1, 2)
        at = np.searchsorted(words.starts, spans[:, 0], "right") - 1
        inside = (at >= 0) & (spans[:, 1] <= words.ends[at])  # not from one text into the next
        exact = np.unique(at[inside])
        for k in exact.tolist():
            data[words.starts[k] : words.ends[k]] = words.data[words.starts[k] : words.ends[k]]
        folded = words._replace(data=data)
        hashes = hash_words(folded, False)
        for k in exact.tolist():
            word = words.data[words.starts[k] : words.ends[k]].tobytes()
            hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"exact").digest(), "little")
        return folded, hashes, exact

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin and the last ends."""
        words = find_words(texts)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if self.held > self.most or max(self.used, self.known.used) > 8 * self.most:
            self._empty()
        folded, hashes, exact = self._folded(words)
        slot, new = self.known.slots(folded, hashes)
        if len(new):
            self._learn(words, new, exact)
        lengths = self.lengths[slot]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.begins[slot] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(words.counts)]]


@lru_cache(maxsize=2)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(tokenizer_file)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """Rows of PIECES: each document's ids and end_id, cut at multiples of capacity."""
    end = array("I", [end_id]).tobytes()

    def pieces(batches):
        encoder = word_encoder(tokenizer_file)
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                out = []
                flat, at = encoder.encode(batch.column(1)[a:b])
                for i, u, v in zip(batch.column(0)[a:b].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = flat[u:v].tobytes() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        out.append((i, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(pieces, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, decreasing: bool = False) -> list[list[int]]:
    """Bins of indices: as they come or longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when a bin has r tokens of room
    for k in (np.argsort(-lengths, kind="stable") if decreasing else np.arange(len(lengths))).tolist():
        size = int(lengths[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        if room > size:
            by_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills.

    From the least filled on, each underfull bin gives to those at least as full: an item
    moves, or is exchanged for a smaller one, or two are exchanged for one smaller than both
    together, until the giver is empty or nothing improves. Passes end when as few bins are
    left as the total length allows, or one changes nothing. Emptied bins stay, as empty lists.
    """
    bins = [list(b) for b in bins]
    fills = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    items = [np.array(b, np.int64) for b in bins]
    counts = np.array([len(b) for b in bins], np.int64)
    least, left, changed = -(-int(lengths.sum()) // capacity), sum(map(bool, bins)), True
    while left > least and changed:
        changed = False
        underfull = np.flatnonzero((fills > 0) & (fills < capacity))
        for giver in underfull[np.argsort(fills[underfull], kind="stable")].tolist():
            if left <= least:
                break
            takers = np.flatnonzero((fills >= fills[giver]) & (fills < capacity))
            takers = takers[takers != giver]
            if not len(takers) or not bins[giver]:
                continue
            # the takers' items: whose they are, which, how long; and the room of each bin
            owner, place = np.repeat(takers, counts[takers]), np.concatenate([items[k] for k in takers.tolist()])
            size, room = lengths[place], np.zeros(len(bins), np.int64)
            room[takers] = capacity - fills[takers]
            touched = {giver}
            while bins[giver]:
                step = _improvement(sorted(bins[giver], key=lambda i: -lengths[i]), lengths, size, room[owner])
                if step is None:
                    break
                give, at, back = step
                to, returned = int(owner[at]), [int(place[at])] if back else []
                gain = int(lengths[give].sum()) - int(lengths[returned].sum())
                bins[giver] = [i for i in bins[giver] if i not in give] + returned
                bins[to] = [i for i in bins[to] if i not in returned] + give
                if back:
                    place[at], size[at] = give[0], lengths[give[0]]
                more = np.array(give[1:] if back else give, np.int64)
                owner, place, size = np.r_[owner, np.full(len(more), to)], np.r_[place, more], np.r_[size, lengths[more]]
                fills[giver] -= gain
                fills[to] += gain
                room[to] -= gain
                touched.add(to)
                changed = True
            for k in touched:
                items[k], counts[k] = np.array(bins[k], np.int64), len(bins[k])
            left -= not bins[giver]
    return bins


def _improvement(own: list[int], lengths: np.ndarray, size: np.ndarray, room: np.ndarray) -> tuple[list[int], int, bool] | None:
    """What a giver gives (its items, longest first), the place of a taker's item, and whether that one comes back."""
    for give in [[i] for i in own] + [own[k : k + 2] for k in range(len(own) - 1)]:
        amount = int(lengths[give].sum())
        fit = np.flatnonzero(room >= amount)
        if len(give) == 1 and len(fit):
            return give, int(fit[np.argmin(room[fit])]), False
        swap = np.flatnonzero((size < amount) & (amount <= size + room) & (room > 0))
        if len(swap):
            return give, int(swap[np.argmax(amount - size[swap])]), True
    return None


def pack_group(rows: pd.DataFrame, capacity: int, decreasing: bool) -> pd.DataFrame:
    """Pack one bounded group; sequence_id is the group's number and the bin's place in it, moved tells what the search moved.

    Rows are ordered first, so that the result does not depend on how they were delivered.
    """
    rows = rows.sort_values(["id", "piece", "start", "length", "ids_crc32"], na_position="last", kind="stable", ignore_index=True)
    lengths = rows["length"].to_numpy(np.int64)
    first = best_fit(lengths, capacity, decreasing)
    bins = local_search(first, lengths, capacity)
    was = np.zeros(len(lengths), np.int64)
    was[np.concatenate(first)] = np.repeat(np.arange(len(first)), [len(b) for b in first])
    order = np.concatenate([np.array(b, np.int64) for b in bins])
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    out = rows.iloc[order].copy()
    out["sequence_id"] = (rows["part"].to_numpy(np.int64)[order] << 32) + number
    ends = np.cumsum(lengths[order])
    firsts = np.r_[0, np.flatnonzero(np.diff(number)) + 1]
    out["offset"] = ends - lengths[order] - np.repeat((ends - lengths[order])[firsts], np.diff(np.r_[firsts, len(order)]))
    out["moved"] = was[order] != number
    return out.drop(columns="part")


def _dealt(pieces: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """Pack materialized pieces in groups that they are dealt to by a hash of their place."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)) + (level << 24)
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(lambda rows: pack_group(rows, capacity, level > 0), PACKED)


def pack(pieces: DataFrame, capacity: int, group_rows: int, partners: float, scratch: Scratch) -> DataFrame:
    """Pack stored pieces; what stays underfull in a first round is pooled with some full sequences and packed again."""
    whole = F.col("length") == capacity
    full = pieces.where(whole).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "moved": F.lit(False)})
    rest = pieces.where(~whole)
    packed = scratch.store(_dealt(rest, 0, max(1, -(-rest.count() // group_rows)), capacity), "packed")
    drawn = F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 20)) < int(partners * (1 << 20))
    again = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where((F.col("fill") < capacity) | drawn).select("sequence_id")
    again = scratch.store(again, "again")
    side = with_small_side(again, again.count(), 16)
    pool = scratch.store(packed.join(side, "sequence_id", "left_semi").select(*pieces.columns), "pool")
    pooled = scratch.store(_dealt(pool, 1, max(1, -(-pool.count() // group_rows)), capacity), "pooled")
    scratch.drop("pool")
    return full.unionByName(packed.join(side, "sequence_id", "left_anti").select(*packed.columns)).unionByName(pooled)


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer_file: str,
    capacity: int = 4096,
    end_id: int = 1,
    group_rows: int = 20_000,
    partners: float = 0.1,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, moved (by the search).

    group_rows: pieces packed together in a task, which bounds its memory and time.
    partners: share of the full sequences that are packed once more with all underfull ones.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.store(token_pieces(docs, id_col, text_col, tokenizer_file, capacity, end_id), "pieces")
    return pack(pieces, capacity, group_rows, partners, scratch).withColumnRenamed("id", id_col)
