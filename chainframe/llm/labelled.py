"""Labelled examples for the classifiers: a bounded, repeatable sample of the rows that may be learnt from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for judging: crc32 of the id as text, modulo 5, is 0. A null id is learnt from by nobody."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def examples(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> pa.Table:
    """(doc_id, text, label) of at most `bound` labelled rows that are not held out, the first by a hash of the id.

    The sample's ids are chosen from the labels alone and broadcast (at most `bound` rows), so documents aren't shuffled.
    Rows without a 0/1 label are skipped; a doc_id labelled both ways counts as 1.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
    return rows.toArrow().sort_by("doc_id")
