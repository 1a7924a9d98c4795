"""Encoding and counting words of texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mergeloom.operators.encoding import encode_merge_order
from mergeloom.operators.training import Merge, word_bag


def read_texts(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def encode_stream(texts: DataFrame, merges: list[Merge], to: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Encode what is there and write it as Parquet; each text once, whatever is lost on the way."""
    encoded = encode_merge_order(texts, merges, text_col)
    return encoded.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_word_bag(texts: DataFrame, text_col: str = "text", pretokenizer: str = "unicode") -> DataFrame:
    """The word bag as a streaming aggregation; write it in update mode."""
    return word_bag(texts, text_col, pretokenizer)
