"""Exact token counts of whole texts; see bpe.py for the transducers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.bpe import Pretokens, compiled
from chainframe.llm.text import parts, text_buffer

#: Text bytes tokenized together: more share more pre-tokens.
TOKEN_BYTES = 2 << 20


def _counted(path: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, transducer, known = compiled(path)
        for part in parts(batches, "text", TOKEN_BYTES):
            pre = Pretokens(scanner, part["text"], transducer.special)
            found = known.of(pre.distinct, lambda new: transducer.counts(new).tolist())
            count = np.array([*found, 1], np.int64)  # code -1: one special token
            upto = np.concatenate([[0], np.cumsum(count[pre.codes])])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(text_buffer(part["text"])[1])), pa.array(np.diff(upto[pre.first]))], ["doc_id", "n_bytes", "n_tokens"])

    return counted


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document (doc_id, n_bytes, n_tokens, over_limit) for the byte-level BPE file at `path`, which every worker reads.

    Null texts are empty and have no tokens. The special token's string in a text is one token, as the
    library has it by default; none is added. Repeated rows each get their row, a null doc_id stays
    null, an empty table gives an empty result and other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
