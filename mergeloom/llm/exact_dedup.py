"""Exact deduplication by stateful streaming with disk-backed keyed state.

The rows of a call are a *delivery*: they are staged on shared storage with their digest
and normalised content, once, and streamed through a grouping aggregation whose state lives
in RocksDB and never expires. Per digest it holds the number of rows, the identifier of
the row to keep and its locator, delivery and row number, where the staged content is
found. Digests hit more than once have the full bytes of all their staged rows compared; a
digest that stands for different contents is split by content. With a folder for the state
later deliveries are checked against all earlier ones. A delivery that the caller names may be
repeated, after a failure or by mistake: what has been staged and counted is not staged or counted again.
Only DataFrame and SQL functions run on the executors.

Defined results for odd input
-----------------------------
* A null text counts as empty; empty texts are equal to each other.
* A null id is allowed and loses ties against any id.
* Repeated rows (same id, same text): one of them is kept, of an earlier delivery if there is one.
* An empty table gives an empty result with the same schema.
* Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side

#: The characters that normalisation deletes.
DELETED = " \t\n\x0b\x0c\r"
#: Settings of the stream's own session: state on disk, without space set aside for each of many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalized(text: Column) -> Column:
    """Text without the characters of DELETED; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in DELETED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


STAGED = "digest string, sha string, id bigint, n_chars bigint, delivery bigint, row_id bigint, content string"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with STATE_SETTINGS and the caller's number of shuffle partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in STATE_SETTINGS.items():
        own.conf.set(k, v)
    return own


def stream_groups(spark: SparkSession, folder: str, bytes_per_batch: int) -> DataFrame:
    """Stream what folder/staged has gained through the keyed state in folder/state; one row for each digest so far.

    The result has digest, group_size and, of the row to keep, keep_id, keep_delivery and
    keep_row: most characters, then smallest id, then the earliest place.
    """
    log = f"{folder}/log"
    # max() over structs: larger n_chars first, then the smaller id and place by negation
    best = F.struct("n_chars", (-F.col("id")).alias("neg_id"), (-F.col("delivery")).alias("neg_delivery"), (-F.col("row_id")).alias("neg_row"))
    state = (
        stream_session(spark)
        .readStream.schema(STAGED)
        .option("maxBytesPerTrigger", str(bytes_per_batch))
        .parquet(f"{folder}/staged/*")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
    )
    (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{log}/batch={k}"))
        .start()
        .awaitTermination()
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", batch bigint"
    updates = spark.read.schema(kinds).option("basePath", log).parquet(log) if _exists(spark, log) else spark.createDataFrame([], kinds)
    last = updates.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s"))
    return last.select(
        "digest",
        F.col("s.group_size").alias("group_size"),
        (-F.col("s.best.neg_id")).alias("keep_id"),
        (-F.col("s.best.neg_delivery")).alias("keep_delivery"),
        (-F.col("s.best.neg_row")).alias("keep_row"),
    )


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _move(spark: SparkSession, folder: str, to: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, to))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{folder} cannot be moved to {to}")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    key_hex: int = 64,
    bytes_per_batch: int = 256 << 30,
    state: str | None = None,
    delivery: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    state: a folder on shared storage that keeps deliveries and state for later calls; keep_id,
    group_size and kept then speak of all rows so far. Without it they go with the call's scratch.
    delivery: the caller's number for these rows, larger than those of earlier deliveries. A number
    that the state knows is not taken in again: the result is that of the rows staged under it.
    By default a new number, so that a call repeated with the same state counts its rows again.
    key_hex: hexadecimal digits of the SHA-256 that key the state; fewer digits force
    collisions, which the comparison of full bytes resolves (tests).
    bytes_per_batch: bytes of the staged table in a micro-batch.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    folder, delivery = state or scratch.path("state"), time.time_ns() if delivery is None else delivery
    text = F.col(text_col)
    content = docs.select(F.col(id_col).cast("bigint").alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"), normalized(text).alias("content"))
    rows = content.withColumns({"sha": F.sha2("content", 256), "delivery": F.lit(delivery).cast("bigint"), "row_id": F.monotonically_increasing_id()}).withColumn("digest", F.substring("sha", 1, key_hex))
    own_folder = f"{folder}/staged/{delivery}"
    if not _exists(spark, own_folder):  # whole deliveries only are moved to where they are read, and what an attempt that broke off has left is overwritten
        arriving = f"{folder}/arriving/{delivery}"
        rows.select(*[x.split()[0] for x in STAGED.split(", ")]).write.mode("overwrite").parquet(arriving)
        _move(spark, arriving, own_folder)
    own_rows = spark.read.schema(STAGED).parquet(own_folder)
    staged = spark.read.schema(STAGED).parquet(f"{folder}/staged/*")
    groups = scratch.store(stream_groups(spark, folder, bytes_per_batch), "groups")

    # full bytes of every row whose digest was hit again: equal when the smallest and the largest are
    groups = groups if state is None else scratch.store(groups.join(own_rows.select("digest").distinct(), "digest", "left_semi"), "own-groups")
    hits = groups.where("group_size > 1").select("digest")
    hit_rows = staged.join(with_small_side(hits, hits.count(), 160), "digest", "left_semi")
    compared = hit_rows.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    collided = scratch.store(compared.where("low != high").select("digest"), "collided")
    n_collided = collided.count()
    small = with_small_side(collided, n_collided, 160)
    if n_collided:  # the digest is not enough there: these are grouped by content
        rank = F.struct("n_chars", (-F.col("id")).alias("neg_id"), (-F.col("delivery")).alias("neg_delivery"), (-F.col("row_id")).alias("neg_row"))
        split = staged.join(small, "digest", "left_semi").groupBy("content").agg(F.first("sha").alias("sha"), F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best"))
        split = scratch.store(
            split.select(
                "sha", "group_size", (-F.col("best.neg_id")).alias("keep_id"), (-F.col("best.neg_delivery")).alias("keep_delivery"), (-F.col("best.neg_row")).alias("keep_row"), "content"
            ),
            "split",
        )
    own = own_rows.drop("content")
    kept = (F.col("delivery") == F.col("keep_delivery")) & (F.col("row_id") == F.col("keep_row"))
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")]
    whole = own.join(groups, "digest")
    if not n_collided:
        return whole.select(*columns)
    again = own_rows.join(small, "digest", "left_semi").drop("sha").join(split, "content")
    return whole.join(small, "digest", "left_anti").select(*columns).unionByName(again.select(*columns))
