"""Properties and conversions of characters and texts.

Class tests are JVM regular expressions on one character; names, numeric values,
compositions and case folding come from Python's tables by Arrow functions. Questions that
need tables neither has (confusables, restricted identifiers, ages) are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType

#: Regular expressions of one-character properties.
PROPERTIES = {
    "letter": r"\p{L}", "uppercase": r"\p{Lu}", "lowercase": r"\p{Ll}", "titlecase": r"\p{Lt}", "digit": r"\p{Nd}", "number": r"\p{N}",
    "punctuation": r"\p{P}", "symbol": r"\p{S}", "mark": r"\p{M}", "separator": r"\p{Z}", "control": r"\p{Cc}", "format": r"\p{Cf}",
    "whitespace": r"\p{IsWhite_Space}", "space": r"\p{Zs}", "alphabetic": r"\p{IsAlphabetic}", "alphanumeric": r"[\p{IsAlphabetic}\p{N}]",
    "numeric": r"\p{N}", "private_use": r"\p{Co}", "identifier_start": r"[\p{L}\p{Nl}_]", "identifier_continue": r"[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]",
    "pattern_whitespace": r"[\t-\r \x{85}\x{200E}\x{200F}\x{2028}\x{2029}]",
}
#: General categories in the order of their numbers, from 0 (unassigned).
CATEGORIES = "Cn Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co".split()
#: Scripts in the order of their numbers, from 0.
SCRIPTS = (
    "UNKNOWN COMMON INHERITED LATIN GREEK CYRILLIC ARMENIAN HEBREW ARABIC SYRIAC THAANA DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU "
    "KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR GEORGIAN HANGUL ETHIOPIC CHEROKEE CANADIAN_ABORIGINAL OGHAM RUNIC KHMER MONGOLIAN "
    "HIRAGANA KATAKANA BOPOMOFO HAN YI OLD_ITALIC GOTHIC DESERET TAGALOG HANUNOO BUHID TAGBANWA LIMBU TAI_LE LINEAR_B UGARITIC SHAVIAN OSMANYA "
    "CYPRIOT BRAILLE BUGINESE COPTIC NEW_TAI_LUE GLAGOLITIC TIFINAGH SYLOTI_NAGRI OLD_PERSIAN KHAROSHTHI BALINESE CUNEIFORM PHOENICIAN PHAGS_PA "
    "NKO SUNDANESE LEPCHA OL_CHIKI VAI SAURASHTRA KAYAH_LI REJANG LYCIAN CARIAN LYDIAN CHAM TAI_THAM TAI_VIET AVESTAN EGYPTIAN_HIEROGLYPHS "
    "SAMARITAN LISU BAMUM JAVANESE MEETEI_MAYEK IMPERIAL_ARAMAIC OLD_SOUTH_ARABIAN INSCRIPTIONAL_PARTHIAN INSCRIPTIONAL_PAHLAVI OLD_TURKIC "
    "KAITHI BATAK BRAHMI MANDAIC CHAKMA MEROITIC_CURSIVE MEROITIC_HIEROGLYPHS MIAO SHARADA SORA_SOMPENG TAKRI CAUCASIAN_ALBANIAN BASSA_VAH "
    "DUPLOYAN ELBASAN GRANTHA KHOJKI KHUDAWADI LINEAR_A MAHAJANI MANICHAEAN MENDE_KIKAKUI MODI MRO NABATAEAN OLD_NORTH_ARABIAN OLD_PERMIC "
    "PAHAWH_HMONG PALMYRENE PAU_CIN_HAU PSALTER_PAHLAVI SIDDHAM TIRHUTA WARANG_CITI AHOM ANATOLIAN_HIEROGLYPHS HATRAN MULTANI OLD_HUNGARIAN "
    "SIGNWRITING ADLAM BHAIKSUKI MARCHEN NEWA OSAGE TANGUT MASARAM_GONDI NUSHU SOYOMBO ZANABAZAR_SQUARE DOGRA GUNJALA_GONDI HANIFI_ROHINGYA "
    "MAKASAR MEDEFAIDRIN OLD_SOGDIAN SOGDIAN ELYMAIC NANDINAGARI NYIAKENG_PUACHUE_HMONG WANCHO CHORASMIAN DIVES_AKURU KHITAN_SMALL_SCRIPT YEZIDI "
    "CYPRO_MINOAN OLD_UYGHUR TANGSA TOTO VITHKUQI"
).split()


def version(spark) -> dict[str, str]:
    """Versions of the tables in use."""
    return {"python": unicodedata.unidata_version, "jvm": spark._jvm.System.getProperty("java.version")}


def has(character: Column, name: str) -> Column:
    return character.rlike(f"^{PROPERTIES[name]}$")


def is_assigned(character: Column) -> Column:
    return ~character.rlike(r"^\p{Cn}$")


def category(character: Column) -> Column:
    """The number of a character's general category."""
    out = F.lit(0)
    for k, name in enumerate(CATEGORIES[1:], 1):
        out = F.when(character.rlike(rf"^\p{{{name}}}$"), k).otherwise(out)
    return out


def script_name(cp: Column) -> Column:
    """The script of a code point by the JVM's table (LATIN, HAN, ...)."""
    return F.reflect(F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), cp.cast("int"))


def script(character: Column) -> Column:
    """The number of a character's script; 0 for one that is not listed."""
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in SCRIPTS]), script_name(F.ascii(character))) - 1, F.lit(0)).cast("int")


def block(character: Column) -> Column:
    """The name of a character's block by the JVM's table (BASIC_LATIN, CYRILLIC, ...); null outside all blocks."""
    return F.reflect(F.lit("java.lang.Character$UnicodeBlock"), F.lit("of"), F.ascii(character).cast("int"))


def in_block(character: Column, block: str) -> Column:
    """Whether a character lies in a block, named as Java does (BasicLatin, Cyrillic, ...)."""
    return character.rlike(rf"^\p{{In{block}}}$")


def is_valid_codepoint(cp: Column) -> Column:
    return cp.between(0, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)


def is_surrogate(cp: Column) -> Column:
    return cp.between(0xD800, 0xDFFF)


def is_noncharacter(cp: Column) -> Column:
    return cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(0xFFFE) == 0xFFFE)


def codepoints(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def to_utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def from_utf16(value: Column) -> Column:
    return F.decode(value, "UTF-16LE")


def is_well_formed(cps: Column) -> Column:
    """Whether code points are a text's: none is a surrogate or out of range."""
    return F.forall(cps, is_valid_codepoint)


def is_cased(character: Column) -> Column:
    return F.lower(character) != F.upper(character)


def count_graphemes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\X"))


def count_words(text: Column) -> Column:
    """Runs of letters, marks and digits."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+(?:['\x{2019}][\p{L}\p{M}]+)*"))


def count_sentences(text: Column) -> Column:
    return F.size(F.sentences(text))


def is_suspicious(text: Column) -> Column:
    """Whether letters of more than one script stand in a text."""
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c.rlike(r"^\p{L}$"))
    found = F.array_distinct(F.transform(letters, lambda c: script_name(F.ascii(c))))
    return F.size(F.array_except(found, F.array(F.lit("COMMON"), F.lit("INHERITED"), F.lit("UNKNOWN")))) > 1


def _by_character(kind: DataType, f: Callable) -> Callable[[Column], Column]:
    arrow = {StringType(): pa.string(), DoubleType(): pa.float64(), LongType(): pa.int64(), BooleanType(): pa.bool_()}[kind]

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None or not v else f(v) for v in values.to_pylist()], arrow)

    return run


name = _by_character(StringType(), lambda c: unicodedata.name(c, "") or None)
numeric_value = _by_character(DoubleType(), lambda c: unicodedata.numeric(c, None))
digit_value = _by_character(LongType(), lambda c: unicodedata.digit(c, None))
combining_class = _by_character(LongType(), unicodedata.combining)
case_fold = _by_character(StringType(), str.casefold)
title = _by_character(StringType(), str.title)
decomposed = _by_character(StringType(), lambda c: unicodedata.normalize("NFD", c))
composed = _by_character(StringType(), lambda c: unicodedata.normalize("NFC", c))


def is_normalized(text: Column, form: str = "NFC") -> Column:
    """Whether a text is in a normalization form: NFC, NFD, NFKC or NFKD."""

    @F.arrow_udf(BooleanType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.is_normalized(form, v) for v in values.to_pylist()], pa.bool_())

    return run(text)


def normalize_bytes(value: Column, form: str = "NFC") -> Column:
    """UTF-8 bytes in a normalization form; invalid ones become U+FFFD."""

    @F.arrow_udf(BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize(form, v.decode("utf-8", "replace")).encode() for v in values.to_pylist()], pa.binary())

    return run(value)



@F.arrow_udf(StringType())
def from_name(values: pa.Array) -> pa.Array:
    out = []
    for v in values.to_pylist():
        try:
            out.append(unicodedata.lookup(v) if v else None)
        except KeyError:
            out.append(None)
    return pa.array(out, pa.string())


def can_compose(a: Column, b: Column) -> Column:
    """Whether two characters join to one under NFC."""
    return F.char_length(composed(F.concat(a, b))) == 1
