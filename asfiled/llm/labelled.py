"""Labelled documents to fit a classifier on: their labels, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of the id as text falls into ``part``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def usable_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, label, order), one row per usable id; of several labels of one id the largest.

    Labels other than 0 and 1 are passed over. ``order`` is a hash that mixes ids.
    """
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .withColumn("order", F.xxhash64("doc_id", F.lit(label))))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int,
                    text: str = "text") -> DataFrame:
    """(order, text, label) of at most ``rows`` usable documents, the same ones in every run.

    Labels other than 0 and 1 are passed over; of several labels of one id the largest counts.
    The documents are those whose ids hash lowest; only their ids, at most ``rows``, are broadcast.
    Of several documents of one id the one whose text hashes lowest counts.
    """
    chosen = usable_labels(labels, label, usable).orderBy("order", "doc_id").limit(rows)
    return (docs.select("doc_id", F.col(text).alias("text"))
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "order", "label")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("order", "text", "label"))
