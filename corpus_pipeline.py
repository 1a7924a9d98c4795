"""From raw documents to packed training sequences.

Stages: toxicity, language, exact duplicates, near duplicates, packing. Each works on
all rows that the one before kept, which are written as Parquet on shared storage in
between; all but the last return the columns of documents. Operators get a number of the
text as id, since what they say depends on the text alone: rows go by what is said of
their text, whatever their ids. The number is a 64-bit hash, save for texts that share
it with another text (128 bits tell them apart): these get numbers that no text has.

Defined results for odd input: null or empty texts have no language and go in the second
stage; of rows that are copies the one with the smallest id stays (in the third stage of
those with the longest text), null last; null ids are handled like other rows; of fully
equal rows one stays; an empty table gives an empty result; further columns are passed on,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, bucket_of_id, small_batches, with_small_side
from mergeloom.llm.exact_dedup import exact_dedup
from mergeloom.llm.language import identify_language, labelled_rows, learn_languages
from mergeloom.llm.near_dedup import minhash_components
from mergeloom.llm.packing import best_fit_packing
from mergeloom.llm.toxicity import learn_toxicity, score_toxicity


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores behind until df has no such column."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Intermediate tables of stages whose result is not written yet.
_OPEN: list[Scratch] = []


def stage_scratch(spark: SparkSession, label: str) -> Scratch:
    """Storage for a stage; run() deletes it once the stage's result is written."""
    _OPEN.append(Scratch(spark, label))
    return _OPEN[-1]


def text_hash(salt: int) -> Column:
    """A 64-bit hash of the text; those of two salts tell as much as 128 bits."""
    return F.xxhash64(F.lit(salt), F.col("text"))


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a number of its text for each row, the same for equal texts only, and the name of the number's column."""
    small_batches(docs.sparkSession)
    key, second = unused(docs, "text_key"), unused(docs, "second_key")
    rows = docs.withColumn(key, text_hash(0))
    both = rows.select(key, text_hash(1).alias(second))
    shared = both.groupBy(key).agg(F.min(second).alias("low"), F.max(second).alias("high")).where("low != high").select(key, "low")
    shared = scratch.store(shared, "shared-hashes")
    n = shared.count()
    if not n:
        return rows, key
    others = both.join(with_small_side(shared, n, 32), key).where(F.col(second) != F.col("low")).select(key, second).distinct()
    others = scratch.store(others, "clashing-texts")
    n_others = others.count()
    for salt in range(2, 1000):
        own = scratch.store(others.withColumn("own", F.xxhash64(F.lit(salt), key, second)), "own-keys")
        taken = both.join(with_small_side(own.select(F.col("own").alias(key)), n_others, 16), key, "left_semi")
        if own.select("own").distinct().count() == n_others and taken.isEmpty():
            break
    else:
        raise RuntimeError("no free numbers for texts that share a hash")
    own = own.withColumnRenamed("own", own_key := unused(docs, "own_key"))
    told = rows.withColumn(second, text_hash(1)).join(with_small_side(own, n_others, 32), [key, second], "left")
    return told.withColumn(key, F.coalesce(own_key, key)).select(*[quoted(c) for c in docs.columns], key), key


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(rows: DataFrame, dropped: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The columns of docs for keyed rows whose key is not in dropped."""
    dropped = scratch.store(dropped.select(key).distinct(), "dropped")
    return rows.join(with_small_side(dropped, dropped.count(), 16), key, "left_anti").drop(key)


def one_of_each(rows: DataFrame, groups: DataFrame, key: str, *rank: Column) -> DataFrame:
    """The columns of docs for keyed rows: of each group the first row by rank, then by doc_id (null last), and all rows of no group.

    groups: key and group, written, for keys whose rows share their group with others.
    """
    columns, group = [quoted(c) for c in rows.columns if c != key], unused(rows, "text_group")
    side = with_small_side(groups.select(key, F.col("group").alias(group)), groups.count(), 80)
    content = F.xxhash64(F.to_json(F.struct(*columns)))  # only fully equal rows are still alike
    order = F.struct(*[c.alias(f"rank{k}") for k, c in enumerate(rank)], F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), content.alias("content"))
    first = rows.join(side, key).groupBy(group).agg(F.min_by(F.struct(*columns), order).alias("first"))
    return rows.join(side, key, "left_anti").select(*columns).unionByName(first.select("first.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not scored as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket_of_id("doc_id", 5) != 0)
    scratch = stage_scratch(spark, "stage-toxicity")
    rows, key = keyed(docs, scratch)
    return without(rows, score_toxicity(rows, learn_toxicity(docs, labels, scratch=scratch), key).where("predicted = 1"), key, scratch)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those that two languages fit alike.

    Where no language can be learned only those without a letter go.
    """
    scratch = stage_scratch(spark, "stage-language")
    rows, key = keyed(docs, scratch)
    model = learn_languages(labelled_rows(docs, bucket_of_id("doc_id", 4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return without(rows, identify_language(rows, model, key).where("rejected"), key, scratch)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, white space apart: that with the longest text."""
    scratch, within = stage_scratch(spark, "stage-exact"), Scratch(spark, "exact-duplicates")
    rows, key = keyed(docs, scratch)
    groups = exact_dedup(rows, key, scratch=within).where("group_size > 1").select(key, F.col("text_sha256").alias("group")).distinct()
    groups = scratch.store(groups, "groups")
    within.drop()
    return one_of_each(rows, groups, key, -F.length(F.coalesce("text", F.lit(""))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by a similarity of 0.8 of five-word shingles."""
    scratch, within = stage_scratch(spark, "stage-near"), Scratch(spark, "near-duplicates")
    rows, key = keyed(docs, scratch)
    linked = minhash_components(rows, key, scratch=within).where("n_shingles > 0")
    groups = linked.select(key, F.col("component_id").alias("group"))
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    several = within.store(several, "several")
    groups = scratch.store(groups.join(with_small_side(several, several.count(), 16), "group").select(key, "group").distinct(), "groups")
    within.drop()
    return one_of_each(rows, groups, key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 4096 tokens."""
    import public_tokenizers

    small_batches(spark)
    return best_fit_packing(docs, tokenizer_file=public_tokenizers.path("word_bpe_49k.json"), scratch=stage_scratch(spark, "stage-packing"))


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("packing", packing),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them.

    What a stage reads and its intermediate tables are deleted then; the last stage's rows stay.
    """
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = results.replace(stage(spark, docs, sf_dir), "rows")
        while _OPEN:
            _OPEN.pop().drop()
    return docs
