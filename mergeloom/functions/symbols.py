"""Symbol strings: token id k is the character U+10000 + k, so pairs and merges are string operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 0x10000
#: The largest vocabulary: ids that fit 16 bits.
MOST_TOKENS = 65_536
_LATIN = "".join(map(chr, range(256)))
_SYMBOLS = "".join(chr(BASE + b) for b in range(256))
NUL = chr(BASE)


def symbol(token_id: int) -> str:
    return chr(BASE + token_id)


def of_text(text: Column) -> Column:
    """The symbols of a text's UTF-8 bytes."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _LATIN, _SYMBOLS)


def first_id(symbols: Column) -> Column:
    return F.ascii(symbols) - BASE


def adjacent_pairs(symbols: Column) -> Column:
    """All overlapping pairs of neighbours, without those that hold token 0."""
    each = F.filter(F.split(symbols, ""), lambda c: c != "")
    left, right = F.slice(each, 1, F.char_length(symbols) - 1), F.slice(each, 2, F.char_length(symbols) - 1)
    pairs = F.zip_with(left, right, lambda a, b: F.concat(a, b))
    return F.when(F.char_length(symbols) > 1, F.filter(pairs, lambda p: ~F.contains(p, F.lit(NUL))))


def merged(symbols: Column, a: int, b: int, new: int, self_pair: str = "greedy") -> Column:
    """Replace the pair (a, b) by new, from left to right.

    self_pair: how a run of a pair of equal symbols is read. "greedy" replaces two at a
    time, "collapse" replaces the whole run of two or more by one.
    """
    if a == b and self_pair == "collapse":
        return F.regexp_replace(symbols, f"(?:{symbol(a)}){{2,}}", symbol(new))
    return F.replace(symbols, F.lit(symbol(a) + symbol(b)), F.lit(symbol(new)))
