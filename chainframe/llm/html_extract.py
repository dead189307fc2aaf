"""Main text of raw pages by a recurrent block labeller; see block_lstm.py."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.block_lstm import features, trained
from chainframe.llm.html_blocks import leaves
from chainframe.llm.text import parts

#: Page characters whose blocks are labelled together.
BATCH_BYTES = 2 << 20


def _extracted(model, threshold: float):
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "html", BATCH_BYTES):
            pages = [leaves(x or "") for x in part["html"].to_pylist()]
            keep = iter((model.value.probabilities(features(pages), [len(p) for p in pages]) >= threshold).tolist()) if any(pages) else iter(())
            texts = ["\n\n".join([leaf.text for leaf in page if next(keep)]) for page in pages]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return extracted


def main_text(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per page (page_id, url, text, n_chars): the blocks labelled as main text, in page order, joined by two line ends.

    Character references are decoded and white space in a block becomes one space; nothing is capped. A null or empty
    page, or one without main text, gives an empty text. Repeated rows each get their row, null ids and urls stay null, an
    empty table gives an empty result and other columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted(model, threshold), "page_id long, url string, text string")
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"))
