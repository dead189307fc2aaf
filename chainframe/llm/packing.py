"""Best-fit packing of token sequences with large-item matching.

Only the counts of piece lengths, at most `capacity` numbers whatever the corpus, reach the
driver. There, pieces above a third of the capacity, of which no three fit, are matched greedily: the
longest takes the longest partner that fits. The others, longest first, go to the smallest gap
that holds them. All bins of one kind are one entry with a count, so the plan has some
thousand rows for any corpus. A piece then finds its place from its rank among the pieces of its length; ranks
are counted in salted groups, so that a length that a third of all pieces have is not one task's work.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.lineage import cut
from chainframe.llm.bpe import token_ids
from chainframe.llm.text import parts

CAPACITY, END = 1024, 2
#: The least number of groups in which the pieces of one length are ranked.
SALTS = 64
#: Text bytes tokenized together: more share more pre-tokens.
TOKEN_BYTES = 2 << 20


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies in a bin, first bin, offset) for runs of equal bins; each length's rows in rank order.

    The pieces of a length that rank from `first rank` on, `copies` to a bin, stand at `offset` and after in bins from `first bin` on.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []  # (free, first bin, bins), by free
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def take(n: int, pieces: int, copies: int, first: int, offset: int) -> None:
        rows.append((n, rank[n], copies, first, offset))
        rank[n] += pieces
        left[n] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect_left(large, capacity - n + 1) - 1  # the longest partner that fits
        while k >= 0 and (not left[large[k]] or large[k] == n and left[n] < 2):
            k -= 1
        if k < 0:
            many, used = left[n], n
            take(n, many, 1, bins, 0)
        elif large[k] == n:
            many, used = left[n] // 2, 2 * n
            take(n, 2 * many, 2, bins, 0)
        else:
            m = large[k]
            many, used = min(left[n], left[m]), n + m
            take(n, many, 1, bins, 0)
            take(m, many, 1, bins, n)
        if used < capacity:
            insort(gaps, (capacity - used, bins, many))
        bins += many
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect_left(gaps, (n, -1, -1))
            if k == len(gaps):
                many = -(-left[n] // (capacity // n))
                gaps.append((capacity, bins, many))
                bins += many
            free, first, many = gaps.pop(k)
            copies = min(free // n, left[n])
            used = min(many, left[n] // copies)
            take(n, used * copies, copies, first, capacity - free)
            if free - copies * n:
                insort(gaps, (free - copies * n, first, used))
            if used < many:
                insort(gaps, (free, first + used, many - used))
    return sorted(rows)


def _pieces(path: str, capacity: int, end: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"] = "1"  # Spark's tasks share the cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for part in parts(batches, "text", TOKEN_BYTES):
            ids, offsets = token_ids(part["text"], path)
            rows = part.num_rows
            size = np.diff(offsets) + 1
            ids = np.insert(ids, offsets[1:], end).astype("<u4")
            ends = np.cumsum(size)
            many = -(-size // capacity)
            row = np.repeat(np.arange(rows), many)
            number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = size - (many - 1) * capacity
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            at = (ends - size)[row] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def _placed(plan):
    length, rank, copies, first, offset = (np.array(x, np.int64) for x in zip(*plan)) if plan else (np.zeros(0, np.int64),) * 5
    key = length * (1 << 50) + rank

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch["length"].to_numpy(), batch["rank"].to_numpy()
            k = np.searchsorted(key, n * (1 << 50) + r, "right") - 1
            nth = r - rank[k]
            places = [pa.array(first[k] + nth // copies[k]), pa.array(offset[k] + nth % copies[k] * n)]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *places], [*names, "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, salts: int = SALTS) -> DataFrame:
    """Per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of sequences of at most `capacity` tokens.

    A document is its ids and then `end`; null texts are empty, so they take one token. Longer documents are cut into full
    pieces, of which the first may be shorter; piece numbers from 0. Repeated rows and rows without doc_id are
    documents of their own. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    salts = max(salts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # more for larger inputs
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # equal rows are spread too; the salts are kept with the rows
    pieces = cut(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)).cast("int")))
    sums = pieces.groupBy("length", "salt").agg(F.count("*").alias("c"))  # at most capacity * salts rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))))
    counts = {r["length"]: r["c"] for r in sums.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(group)).join(F.broadcast(sums.drop("c")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(plan_bins(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
