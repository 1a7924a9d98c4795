"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.sources.storage import Scratch, materialize, shared_root, small_batches, work_folder

__all__ = ["Scratch", "bucket_of_id", "materialize", "shared_root", "small_batches", "with_small_side", "work_folder"]


def bucket_of_id(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def with_small_side(side: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """Mark side for broadcast when rows * row_bytes, both measured, stay under limit_bytes.

    Beyond that the side is returned as it is and the join shuffles.
    """
    return F.broadcast(side) if rows * row_bytes <= limit_bytes else side
