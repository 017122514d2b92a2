"""Bounded samples of labelled documents, for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder


def held_out(column: str = "doc_id"):
    """The rows that no model may learn a label from."""
    return remainder(column, 4) == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out part, the same ones every time.

    Which ones is a hash of the id, so it depends on nothing else.  The chosen
    ids, at most ``most`` numbers, are broadcast; of the rows of one id the text that sorts first is taken.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
