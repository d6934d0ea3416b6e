"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; those with the smallest id hashes.
SAMPLE = 20_000


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def training_ids(labels: DataFrame, label: str, mod: int, held_out: int, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``bound`` rows that are not held out. Rows without a
    label are left out; where an id has several labels, the largest counts."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder(F.col("doc_id"), mod) != held_out)
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
