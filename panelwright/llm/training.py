"""Which labelled rows a model may learn from, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id):
    """Rows kept for judging: crc32 of the doc_id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most_rows`` labelled rows that are not held out.

    The sample is the labelled rows of least hash of the doc_id, so it does not depend
    on the order or the partitions of the tables. Only its ids are sorted and sent. Of
    rows that repeat a doc_id the least text is taken, so the bound holds for rows too.
    """
    fit = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).dropna()
    fit = fit.groupBy("doc_id").agg(F.max("y").alias("y")).where(~is_held_out(F.col("doc_id")))
    chosen = fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
