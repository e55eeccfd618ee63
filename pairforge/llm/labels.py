"""What the classifiers share: the split of labelled rows and carried columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows to learn from; rows without id or label have none."""
    named = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    return named.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
