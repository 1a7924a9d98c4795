"""Toxicity of texts restored by a noisy-channel decoder.

Tokens that look disguised (leetspeak, single characters set apart, letters repeated)
span a lattice of readings; the Viterbi path under a character language model of the
whole corpus is the restored token. Word features are learned from labelled rows and
scored on restored texts.

Defined results for odd input
-----------------------------
* A null or empty text has no words and gets the score of the model's intercept.
* Rows with a null id, label or text are not learned from; every row is scored.
* Whole texts are read, of any length; repeated rows get equal scores.
* Without labelled rows of both kinds every score is 0; an empty table gives an empty result.
* Columns other than those named by the arguments are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side
from mergeloom.llm.words import find_words, hash_words, minima, row_slices, shingles, text_bytes

#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "(": "c"}
#: Runs of letters; the rest separates words.
LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = re.escape("".join(c for c in LEET if not c.isdigit()))
#: Tokens to restore: single characters set apart, letters mixed with digits or signs, one letter three times or more.
DISGUISED = re.compile(
    rf"(?<![^\W_])(?:[^\W_][ ._*\-]{{1,2}}){{3,}}[^\W_](?![^\W_])"
    rf"|(?:[^\W\d_]+[\d{_SIGN}]+|[\d{_SIGN}]+(?=[^\W\d_]))[^\W_{_SIGN}\d]*[\w{_SIGN}]*"
    rf"|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*"
)
#: Letter codes of the language model: 0 border, 1 to 26 a to z, 27 any other letter.
CODES = 28
LETTER_OF = {chr(96 + k): k for k in range(1, 27)}


_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STAND_IN = _DIGIT | np.isin(_BYTES, [ord(c) for c in LEET])
_AT_END = _DIGIT | np.isin(_BYTES, [ord("@"), ord("$")])
_APART = np.isin(_BYTES, [ord(c) for c in "._*-"])
_FIRST = (_BYTES < 128) | (_BYTES >= 192)  # not a later byte of a character
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def suspicious_spans(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and begin, end and text number of the spans that may hold a disguised token.

    Spans are words (between white space) with a stand-in beside a letter, a letter three
    times in a row or characters set apart, and runs of four or more words of a single
    character each.
    """
    words = find_words(texts)
    if not len(words.starts):
        none = np.zeros(0, np.int64)
        return b"", none, none, none
    data = np.r_[words.data, np.zeros(6, np.uint8)]
    n = len(words.data)
    low, letter = _FOLDED[data], _LETTER[data]
    alnum = letter | _DIGIT[data]
    apart = _APART[data]
    at = lambda mask, k: mask[k : n + k]
    marks = at(_STAND_IN[data], 0) & at(letter, 1) | at(letter, 0) & at(_AT_END[data], 1)
    marks |= at(letter, 0) & (at(low, 0) == at(low, 1)) & (at(low, 0) == at(low, 2))
    wide = (data >= 192)[:n] & (at(data, 0) == at(data, 2)) & (at(data, 0) == at(data, 4))
    marks |= wide & (at(data, 1) == at(data, 3)) & (at(data, 1) == at(data, 5))
    marks |= at(alnum, 0) & at(apart, 1) & at(alnum, 2) & at(apart, 3) & at(alnum, 4)
    seen = np.r_[0, np.cumsum(marks)]
    # a mark at the last byte of a word looks past it
    marked = seen[words.ends - 1] > seen[words.starts]
    characters = np.r_[0, np.cumsum(at(alnum, 0) & _FIRST[words.data])]
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    thin = (characters[words.ends] - characters[words.starts] == 1) & (words.ends - words.starts <= 6)
    begins = thin & ~(np.r_[False, thin[:-1]] & np.r_[False, text[1:] == text[:-1]])
    first = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[thin], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    last = first + sizes - 1
    long = sizes >= 4
    alone = np.flatnonzero(marked)
    starts = np.r_[words.starts[alone], words.starts[first[long]]]
    ends = np.r_[words.ends[alone], words.ends[last[long]]]
    owner = np.r_[text[alone], text[first[long]]]
    order = np.argsort(starts, kind="stable")
    return words.data.tobytes(), starts[order], ends[order], owner[order]


def count_quadruples(texts: pa.Array) -> np.ndarray:
    """Counts of four letter codes in a row, words bordered by three borders before and one after."""
    texts = pc.fill_null(texts, b"").cast(pa.binary())
    data, _ = text_bytes(pc.binary_join_element_wise(texts, pa.scalar(b""), pa.scalar(b" ")))  # no word runs on into the next text
    code = np.zeros(256, np.int64)
    for upper, lower, k in zip(range(65, 91), range(97, 123), range(1, 27), strict=True):
        code[upper] = code[lower] = k
    code[128:] = 27
    codes = np.r_[0, 0, 0, code[data], 0]
    a, b, c, d = codes[:-3].copy(), codes[1:-2].copy(), codes[2:-1], codes[3:]
    # nothing before a border within the window counts
    b[c == 0] = 0
    a[b == 0] = 0
    keep = (c != 0) | (d != 0)
    return np.bincount((((a * CODES + b) * CODES + c) * CODES + d)[keep], minlength=CODES**4)


def character_model(docs: DataFrame, text_col: str, *, weight: float = 0.4) -> np.ndarray:
    """Log-probability of a letter code after three, by interpolated counts over all texts.

    Each task sums its texts' counts; Spark sums the tasks'. The result has CODES**4 entries.
    """

    def counts(batches):
        total = np.zeros(CODES**4, np.int64)
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                total += count_quadruples(batch.column(0)[a:b])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(counts, "code bigint, n bigint")
    summed = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most CODES**4 rows
    four = np.zeros(CODES**4)
    four[summed["code"].to_numpy()] = summed["n"].to_numpy()
    four = four.reshape(CODES, CODES, CODES, CODES)
    out = np.full(CODES, 1 / CODES)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = four.sum(axis=axes) if axes else four
        total = n.sum(axis=-1, keepdims=True)
        share = total / (total + 5.0)
        out = share * (n / np.maximum(total, 1)) * (1 - weight / 4) + (1 - share * (1 - weight / 4)) * out
    return np.log(out).astype(np.float32)


class Decoder:
    """Viterbi decoding of disguised tokens; kept readings are cached by token."""

    #: Log-probability of the channel's acts: a stand-in, a dropped repeat, a dropped separator, a kept sign.
    STAND_IN, REPEAT, SEPARATOR, KEPT = -0.7, -0.3, -0.2, -9.0

    def __init__(self, model: np.ndarray):
        self.model = array("f", model.ravel().tobytes())
        self.decode = lru_cache(50_000)(self._decode)

    def _readings(self, token: str):
        """For each character: (letter or '' to drop it, log-probability of the channel)."""
        token = token.lower()
        for k, c in enumerate(token):
            options = []
            if c in LEET:
                options += [(x, self.STAND_IN) for x in LEET[c]] + [(" ", self.KEPT)]
            elif c in " ._*-":
                options += [("", self.SEPARATOR), (" ", -1.0)]
            else:
                options.append((c, 0.0))
            if k and c == token[k - 1] and c not in " ._*-" and c * 3 in token:
                options.append(("", self.REPEAT))
            yield options

    def _decode(self, token: str) -> str:
        """The likeliest reading of the whole token; a space in it ends a word."""
        model = self.model
        best = {0: 0.0}  # by the last three letter codes, as one number
        steps: list[dict[int, tuple[int, str]]] = []
        for options in self._readings(token):
            after: dict[int, float] = {}
            came: dict[int, tuple[int, str]] = {}
            for state, score in best.items():
                for letter, cost in options:
                    if not letter:
                        to, total = state, score + cost
                    else:
                        code = LETTER_OF.get(letter, 0 if letter == " " else 27)
                        total = score + cost + (model[state * CODES + code] if state % CODES or code else 0.0)
                        to = state % CODES**2 * CODES + code if code else 0
                    if to not in after or total > after[to]:
                        after[to], came[to] = total, (state, letter)
            best = after
            steps.append(came)
        state = max(best, key=lambda s: best[s] + (model[s * CODES] if s % CODES else 0.0))
        read = []
        for came in reversed(steps):
            state, letter = came[state]
            read.append(letter)
        return "".join(reversed(read))

    def _reading(self, match: re.Match) -> str:
        """A match's reading; only those of short tokens are kept."""
        token = match.group(0)
        return self.decode(token) if len(token) <= 64 else self._decode(token)

    def restore(self, texts: pa.Array) -> list[str | None]:
        """Each text with its disguised tokens replaced by their readings; null stays null."""
        data, starts, ends, owner = suspicious_spans(texts)
        offsets = text_bytes(texts)[1].tolist()
        at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        out: list[str | None] = []
        for k, known in enumerate(texts.is_valid().to_pylist()):
            parts, here = [], offsets[k]
            for a, b in zip(starts[at[k] : at[k + 1]].tolist(), ends[at[k] : at[k + 1]].tolist(), strict=True):
                if a >= here:
                    parts += [data[here:a], DISGUISED.sub(self._reading, data[a:b].decode("utf-8", "replace")).encode()]
                    here = b
            out.append(b"".join([*parts, data[here : offsets[k + 1]]]).decode("utf-8", "replace") if known else None)
        return out

    def words(self, texts: pa.Array) -> list[set[str]]:
        """Distinct lower-cased words of each restored text."""
        return [set(LETTERS.findall((t or "").lower())) for t in self.restore(texts)]


def without_copies(rows: DataFrame) -> DataFrame:
    """id and label of one row (least id) of each group that shares a minimum over its three-word runs.

    rows has id, text and label. Three independent hashes take their turn, so that of
    many copies with small edits, which would count as evidence again and again, one or
    few stay. Runs are not compared further: two texts of which a share s of all runs is
    common, a quoted passage for instance, are taken for copies with a probability of
    about 1 - (1 - s)**3. This thins the sample to learn from; all rows are scored.
    """

    def sketch(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                words = find_words(batch.column(1)[a:b])
                least = minima(*shingles(hash_words(words), words.counts, 3), 3).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b]] + [pa.array(least[:, k]) for k in range(3)], ["id", "label", "h0", "h1", "h2"]
                )

    kept = rows.select("id", "text", "label").mapInArrow(sketch, "id bigint, label int, h0 bigint, h1 bigint, h2 bigint")
    for k in range(3):
        kept = kept.groupBy(f"h{k}").agg(F.min(F.struct("id", "label", "h0", "h1", "h2")).alias("r")).select("r.*")
    return kept.select("id", "label")


class ToxicityModel(NamedTuple):
    characters: np.ndarray
    weights: dict[str, float]
    intercept: float


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    sample_rows: int = 50_000,
    least_rows: int = 5,
    least_z: float = 6.0,
    most_words: int = 2000,
    scratch: Scratch | None = None,
) -> ToxicityModel:
    """Character model over all texts, word weights from a bounded sample of labelled rows.

    labels: id and label (0 or 1). About sample_rows labelled rows at most are drawn by
    a hash of the id, and of copies among them one is used. A word of the restored texts becomes a feature when
    it is in at least least_rows rows and its shares of toxic and of clean rows differ
    by least_z deviations, whichever is larger; of these the most_words with the largest deviations stay.
    Weights are smoothed log-likelihood ratios of either sign, the intercept is the log-odds of the labels.
    """
    own, scratch = scratch is None, scratch or Scratch(docs.sparkSession, "toxicity")
    characters = character_model(docs, text_col)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(at < min(1.0, sample_rows / max(n, 1))).dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    drawn = texts.join(with_small_side(sample, min(n, 2 * sample_rows), 40), "id")
    once = scratch.store(without_copies(drawn), "toxic-sample")
    texts = texts.join(with_small_side(once, once.count(), 40), "id").select("text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def count(batches):
        decoder, total = Decoder(shared.value), (Counter(), Counter())
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                for words, label in zip(decoder.words(batch.column(0)[a:b]), batch.column(1)[a:b].to_pylist(), strict=True):
                    total[label].update(words)
                    total[label][""] += 1
        words = list(total[0].keys() | total[1].keys())
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())] + [pa.array([t[w] for w in part], pa.int64()) for t in total], ["word", "n0", "n1"])

    counted = texts.mapInArrow(count, "word string, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = scratch.store(counted, "toxic-words")
    rows = {r.word: r for r in counted.where("word = ''").collect()}
    clean, toxic = (rows[""].n0, rows[""].n1) if rows else (0, 0)
    if not clean or not toxic:
        return ToxicityModel(characters, {}, -math.inf)
    ratio = F.log((F.col("n1") + 0.5) / (toxic + 1.0)) - F.log((F.col("n0") + 0.5) / (clean + 1.0))
    pooled = (F.col("n1") + F.col("n0") + 1.0) / (toxic + clean + 2.0)
    z = (F.col("n1") / toxic - F.col("n0") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    enough = F.col("n0") + F.col("n1") >= least_rows
    chosen = counted.where((F.col("word") != "") & enough).select("word", ratio.alias("ratio"), F.abs(z).alias("z")).where(F.col("z") >= least_z)
    weights = {r.word: float(r.ratio) for r in chosen.orderBy(F.desc("z"), "word").limit(most_words).collect()}
    if own:
        scratch.drop()
    return ToxicityModel(characters, weights, math.log(toxic / clean))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score between 0 and 1, predicted (1 if score >= 0.5), found.

    found: the features in the restored text, sorted and comma-joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: CODES**4 numbers and most_words words

    def score(batches):
        m = shared.value
        decoder = Decoder(m.characters)
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                scores, found = [], []
                for words in decoder.words(batch.column(1)[a:b]):
                    own = sorted(words & m.weights.keys())
                    logit = m.intercept + sum(m.weights[w] for w in own)
                    scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))) if m.intercept > -math.inf else 0.0)
                    found.append(",".join(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.string())],
                    ["id", "score", "predicted", "found"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(score, "id bigint, score double, predicted int, found string").withColumnRenamed("id", id_col)


def restore_texts(docs: DataFrame, characters: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the restored text of each row; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(characters)

    def restore(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                restored = pa.array(decoder.restore(batch.column(1)[a:b]), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], restored], ["id", "restored"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(restore, "id bigint, restored string").withColumnRenamed("id", id_col)
