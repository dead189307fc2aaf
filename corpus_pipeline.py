"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.lineage import cut
from chainframe.llm.decontaminate import decontaminate
from chainframe.llm.near_dup import few, near_duplicates
from chainframe.llm.packing import pack
from chainframe.llm.quality import keep_good
from chainframe.llm.substring_dedup import remove_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows of docs, rejects go.

    Null and empty texts have the model's prior as score and go or stay by it, as do all without labels. Equal texts, so repeated rows too, fare
    alike; a score just at the threshold stays. An empty table gives an empty result, and other columns stay as they are.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _vertices(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with __vertex, a number for each (doc_id, text), and __loose, whether rows may share it; and whether any may.

    It is the doc_id where one text has that id, else for the text of least hash. Texts without an id of their
    own get a hash from 2^62 up, so rows with an id go before them.
    """
    number = F.col("doc_id").cast("long")
    again = cut(docs.filter("doc_id IS NOT NULL").groupBy(number.alias("__again")).agg(F.count("*").alias("__n"), F.min(F.xxhash64("text")).alias("__least")).filter("__n > 1").select("__again", "__least"))
    count = again.count()
    own = F.xxhash64(number, "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    if count:
        docs = docs.join(few(again, count), number == F.col("__again"), "left")
        loose = F.col("doc_id").isNull() | F.col("__again").isNotNull()
        first = F.col("__again").isNull() | (F.xxhash64("text") == F.col("__least"))
    else:
        loose, first = F.col("doc_id").isNull(), F.lit(True)
    docs = docs.withColumn("__vertex", F.when(F.col("doc_id").isNotNull() & first, number).otherwise(own)).withColumn("__loose", loose)
    return docs, bool(count) or not docs.filter("doc_id IS NULL").isEmpty()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id; repeated rows and rows without doc_id are rows as others.

    Null and blank texts are near to nothing: their rows stay, repeated ones once. A tie is a repeated row, of which any stays. An empty table gives an
    empty result, and other columns stay as they are, whatever their names. Only ids and texts are compared; the ids that go
    are broadcast if they are few.
    """
    names = docs.columns
    held = docs.toDF(*[c if c in ("doc_id", "text") else f"__c{n}" for n, c in enumerate(names)])
    rows, repeats = _vertices(held)
    found = near_duplicates(rows.select(F.col("__vertex").alias("doc_id"), "text"))
    gone = cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__vertex")).distinct())
    left = rows.join(few(gone, gone.count()), "__vertex", "left_anti")
    if repeats:
        once = left.filter("__loose").dropDuplicates(["__vertex", "doc_id", "text"])
        left = left.filter("NOT __loose").union(once)
    return left.select(held.columns).toDF(*names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go; a document of which nothing is left stays as an empty text.

    Null texts and texts below 35 words stay as they are. Repeated rows repeat each other; there are no ties. An empty table gives an
    empty result, and other columns stay as they are; n_chars, where there is one, is that of the new text.
    """
    return _recounted(remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows go; a document that was nothing else goes.

    Null and empty texts stay as they are, repeated rows fare alike, and there are no ties. Benchmark items with a null text count for nothing. An empty
    table gives an empty result, and other columns stay as they are; n_chars, where there is one, is that of the new text.
    """
    return _recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in the training sequences; see `pack`.

    A null or empty text is one end token. Repeated rows and rows without doc_id are documents of their own; equal pieces may stand in
    any order. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier, so tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are computed once and kept in shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
