"""Text functions: classes of characters, words, paragraphs, sizes, durations and token display."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that end a line and are a word each.
NEWLINE = r"\n\r\x{85}\x{2028}\x{2029}"
#: The classes of characters, in order of their numbers.
CLASSES = ("LETTER", "DIGIT", "WHITESPACE", "PUNCTUATION", "SYMBOL", "NEWLINE", "OTHER")
_CLASS_PATTERNS = {
    "NEWLINE": f"[{NEWLINE}]",
    "LETTER": r"[\p{L}\p{M}]",
    "DIGIT": r"\p{N}",
    "WHITESPACE": rf"(?![{NEWLINE}])\p{{IsWhite_Space}}",
    "PUNCTUATION": r"\p{P}",
    "SYMBOL": r"\p{S}",
    "OTHER": rf"(?![\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}\p{{IsWhite_Space}}{NEWLINE}])[\s\S]",
}
#: Words by byte classes: letters (with all bytes from 0x80), digits, spaces, others, line feeds.
BYTE_WORDS = r"\n| *(?:[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+)| +|[^A-Za-z0-9 \n\x{80}-\x{10FFFF}]+"


def _unicode_words() -> str:
    c = _CLASS_PATTERNS
    letter, space, other = c["LETTER"], f"(?:{c['WHITESPACE']})", f"(?:{c['OTHER']})"
    contraction = rf"['\x{{2019}}](?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])(?!{letter})"
    unit = rf"(?:{letter}+(?:{contraction})*|\p{{N}}{{1,3}}|[\p{{P}}\p{{S}}]+)"
    return rf"{c['NEWLINE']}|{space}*(?:{unit}|{other}+{unit}?)(?:{other}+{unit}?)*|{space}+"


#: Words by Unicode classes, contractions kept with their word, digits in threes.
UNICODE_WORDS = _unicode_words()


def words(text: Column, pretokenizer: str = "unicode") -> Column:
    """The words of a text; joined they are the text again. pretokenizer: "unicode" or "byte"."""
    return F.regexp_extract_all(text, F.lit({"unicode": UNICODE_WORDS, "byte": BYTE_WORDS}[pretokenizer]), F.lit(0))


def count_class(text: Column, name: str) -> Column:
    """How many characters of a text have a class."""
    return F.regexp_count(text, F.lit(_CLASS_PATTERNS[name]))


def character_class(character: Column) -> Column:
    """The number of a character's class."""
    out = F.lit(CLASSES.index("OTHER"))
    for name in ("SYMBOL", "PUNCTUATION", "WHITESPACE", "DIGIT", "LETTER", "NEWLINE"):
        out = F.when(character.rlike(f"^{_CLASS_PATTERNS[name]}$"), CLASSES.index(name)).otherwise(out)
    return out


def byte_class(byte: Column) -> Column:
    """0 letter (and all from 0x80), 1 digit, 2 space, 3 other, 4 line feed."""
    letter = byte.between(65, 90) | byte.between(97, 122) | (byte >= 128)
    return F.when(letter, 0).when(byte.between(48, 57), 1).when(byte == 32, 2).when(byte == 10, 4).otherwise(3)


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """NFC; texts of ASCII do not leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)


def normalize(text: Column, form: str) -> Column:
    """A Unicode normalization form: NFC, NFD, NFKC or NFKD."""

    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in values.to_pylist()], pa.string())

    return F.when(text.rlike(r"[^\x00-\x7F]"), run(text)).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Parts between two or more line feeds that hold more than white space."""
    return F.filter(F.split(text, "\n\n+"), lambda p: p.rlike(r"[^\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"))


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def format_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / float(1 << 20)))
    )


def _minutes(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 60).cast("bigint"), F.round(seconds % 60).cast("bigint")


def format_duration(seconds: Column) -> Column:
    """Training time: tenths of a second below a minute, then minutes and seconds."""
    m, s = _minutes(seconds)
    text = F.concat(m.cast("string"), F.lit("m"))
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(s > 0, F.concat(text, F.lit(" "), s.cast("string"), F.lit("s"))).otherwise(text)


def format_estimate(seconds: Column) -> Column:
    """Time left: whole seconds, minutes and seconds, or hours and minutes."""
    m, s = _minutes(seconds)
    h, rest = F.floor(m / 60).cast("string"), m % 60
    short, long = F.concat(m.cast("string"), F.lit("m")), F.concat(h, F.lit("h"))
    return (
        F.when(seconds < 60, F.concat(F.round(seconds).cast("bigint").cast("string"), F.lit("s")))
        .when((m < 60) & (s > 0), F.concat(short, F.lit(" "), s.cast("string"), F.lit("s")))
        .when(m < 60, short)
        .when(rest > 0, F.concat(long, F.lit(" "), rest.cast("string"), F.lit("m")))
        .otherwise(long)
    )


def display_byte(byte: Column) -> Column:
    """A byte for display: printable ASCII as it is, space, line feed and others by a sign or in hexadecimal."""
    return (
        F.when(byte == 32, "▁")
        .when(byte == 10, "\\n")
        .when(byte.between(33, 126), F.chr(byte))
        .otherwise(F.concat(F.lit("<0x"), F.lpad(F.hex(byte.cast("bigint")), 2, "0"), F.lit(">")))
    )


_SIGNS = {0x20: "▁", 0x0A: "\\n"}
_SEQUENCE = re.compile(rb"[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xFF][\x80-\xBF]{3}|[\x00-\xFF]", re.DOTALL)


def display_bytes(value: bytes) -> str:
    """Bytes for display: valid UTF-8 characters as they are, other bytes in hexadecimal."""
    out = []
    for part in _SEQUENCE.findall(value):
        if part[0] < 0x80:
            out.append(_SIGNS.get(part[0]) or (chr(part[0]) if 0x21 <= part[0] <= 0x7E else f"<0x{part[0]:02X}>"))
            continue
        try:
            out.append(part.decode("utf-8"))
        except UnicodeDecodeError:
            out += [f"<0x{b:02X}>" for b in part]
    return "".join(out)


@F.arrow_udf(StringType())
def display(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else display_bytes(v) for v in values.to_pylist()], pa.string())


def escape_whitespace(text: Column) -> Column:
    for c, sign in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), (" ", "·")):
        text = F.replace(text, F.lit(c), F.lit(sign))
    return text


def token_span(token_id: Column, text: Column) -> Column:
    """A token as an HTML span, whose form is fixed; the text is not escaped."""
    t = token_id.cast("string")
    return F.concat(F.lit('<span class="token" title="Token ID: '), t, F.lit('">'), escape_whitespace(text), F.lit('<span class="token-id">#'), t, F.lit("</span></span>"))
