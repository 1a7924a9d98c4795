"""Language identification by compression against per-language dictionaries.

Each language gets a raw-content zstandard dictionary made of sample passages. Texts
are reduced to their lower-cased letters, with a space for whatever stands between. A
text is cut into blocks; every block is compressed against every dictionary, and the
language with the smallest sum of sizes wins. The margin to the runner-up tells how
sure that is; a narrow margin rejects the text.

Defined results for odd input
-----------------------------
* A null text, or one without a letter, gets `und`, score 0 and is rejected.
* Rows with null id, null text or null language are not learned from; every row is predicted.
* Ties in size go to the language with more training rows, then to the smaller name.
* Whole texts are compressed, of any length; repeated rows get equal results.
* An empty table gives an empty result; without a learned language every text is `und`.
* Columns other than those named by the arguments are not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.words import row_slices

UNDETERMINED = "und"
RESULT = "id bigint, lang_pred string, score double, margin double, rejected boolean"


def letters_only(text: Column) -> Column:
    """Lower-cased words of letters with a space between them; empty where there is no letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


class LanguageModel(NamedTuple):
    """Languages, the one with most training rows first, and their dictionaries' contents."""

    languages: list[str]
    contents: list[bytes]


def learn_languages(
    labelled: DataFrame, *, sample_rows: int = 256, sample_bytes: int = 512, dictionary_bytes: int = 96 << 10, most_languages: int = 256
) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows (columns id, text, lang).

    Rows per language are counted over all rows; the most_languages with most rows are
    learned. Sampled are about sample_rows rows of each language by a hash of the id, copies of
    a text once, of a long text its first sample_bytes letters; a dictionary holds such
    passages up to dictionary_bytes.
    """
    rows = labelled.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return LanguageModel([], [])
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 2 * sample_rows / r.n)))])
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    passage = F.substr(letters_only(F.col("text")), F.lit(1), F.lit(sample_bytes))
    sample = rows.where(at < share[F.col("lang")]).select("lang", passage.alias("text"), at.alias("at"), "id")
    sample = sample.groupBy("lang", "text").agg(F.min(F.struct("at", "id")).alias("first"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    texts: dict[str, list[bytes]] = {r.lang: [] for r in counts}
    for r in sample.withColumn("bytes", before).where(F.col("bytes") <= dictionary_bytes + sample_bytes).orderBy("lang", "first").collect():
        own, text = texts[r.lang], r.text.encode()
        if sum(map(len, own)) + len(text) <= dictionary_bytes:
            own.append(text)
    known = [r.lang for r in counts if texts[r.lang]]
    return LanguageModel(known, [b"\n".join(texts[x]) for x in known])


class Sizes:
    """Compressed sizes of texts against each dictionary of a model."""

    def __init__(self, model: LanguageModel, level: int, block_bytes: int):
        import zstandard

        self.block_bytes = block_bytes
        self.compressors = []
        for content in model.contents:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=dictionary, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def of(self, text: bytes) -> list[int]:
        blocks = [text[k : k + self.block_bytes] for k in range(0, len(text), self.block_bytes)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]


def identify_language(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    level: int = 6,
    block_bytes: int = 4096,
    least_margin: float = 0.005,
) -> DataFrame:
    """One row for each row of docs: id, lang_pred, score, margin, rejected.

    margin: by which share of the runner-up's size the winner is smaller.
    score: margin / (margin + 0.05), between 0 and 1; 1 where only one language is known.
    rejected: the margin is under least_margin, or the text has no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages times dictionary_bytes

    def predict(batches):
        languages = shared.value.languages
        sizes = Sizes(shared.value, level, block_bytes)
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                out = []
                for i, text, letters in zip(*(c[a:b].to_pylist() for c in batch.columns), strict=True):
                    if not letters or not languages:
                        out.append((i, UNDETERMINED, 0.0, 0.0, True))
                        continue
                    got = sizes.of(text)
                    best = int(np.argmin(got))
                    rest = [n for k, n in enumerate(got) if k != best]
                    margin = 1 - got[best] / min(rest) if rest else 1.0
                    out.append((i, languages[best], margin / (margin + 0.05) if rest else 1.0, margin, margin < least_margin))
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "lang_pred", "score", "margin", "rejected"]
                )

    text = F.col(text_col)
    has_letter = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), letters_only(text).cast("binary").alias("text"), has_letter.alias("letters"))
    return rows.mapInArrow(predict, RESULT).withColumnRenamed("id", id_col)


def labelled_rows(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows to learn from, as learn_languages takes them."""
    return docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
