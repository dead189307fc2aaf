"""Benchmark decontamination: test n-grams are broadcast as a hash set and document windows probe it.

An item's windows are its runs of 10 consecutive words; an item of fewer words is one window.
Documents are scanned where they lie, without a shuffle: rolling hashes of every run probe a bit
table and then the sorted hashes, and each hit is verified word for word before it counts.

The benchmark is split by item into blocks of at most `block_words` words, so that what is broadcast
is bounded; each block is one scan, and the spans and items of all blocks meet in one row
for each document. A benchmark of one block, the usual case, takes a single scan and no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.text import NOT_ALNUM, Words, grams, parts

WINDOW = 10
#: Words of the benchmark items in one broadcast block (some 60 bytes each).
BLOCK_WORDS = 1_000_000
_BITS = 22


class Index:
    """The windows of one block of items: sorted hashes for each window length, the words behind them, and their items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        words = Words(pa.array([text for _, text in items], pa.string()), NOT_ALNUM, lower=True)
        h, raw = words.hashes(), words.data.tobytes()
        at: dict[int, list[tuple[int, int]]] = {}
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = min(window, b - a)
            at.setdefault(n, []).extend((s, k) for s in range(a, b - n + 1) if n)
        self.lengths = {}
        for n, places in at.items():
            if not n:
                continue
            hashes = grams(h, n)
            found: dict[int, dict[bytes, set]] = {}
            for s, k in places:
                text = b" ".join(raw[words.start[i] : words.end[i]] for i in range(s, s + n))
                found.setdefault(int(hashes[s]), {}).setdefault(text, set()).add(items[k][0])
            keys = np.array(sorted(found), np.uint64)
            bits = np.zeros(1 << _BITS, bool)
            bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.lengths[n] = (keys, bits, [found[int(x)] for x in keys])

    def hits(self, words: Words) -> list[tuple[int, int, set]]:
        """(first word, length, items) of each verified window in the rows."""
        h, out, raw = words.hashes(), [], words.data
        last = words.last
        for n, (keys, bits, found) in self.lengths.items():
            g = grams(h, n)
            if not len(g):
                continue
            maybe = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            maybe = maybe[maybe + n <= last[maybe]]
            at = np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)
            true = keys[at] == g[maybe]
            for s, k in zip(maybe[true].tolist(), at[true].tolist()):
                text = b" ".join(raw[words.start[i] : words.end[i]].tobytes() for i in range(s, s + n))
                if (items := found[k].get(text)) is not None:
                    out.append((s, n, items))
        return out


def _cover(words: Words, hits: list[tuple[int, int, set]]) -> np.ndarray:
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, _ in hits:
        edge[s] += 1
        edge[s + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _items_of(words: Words, hits: list[tuple[int, int, set]]) -> dict[int, set]:
    rows = np.searchsorted(words.first, [s for s, _, _ in hits], "right") - 1
    out: dict[int, set] = {}
    for r, (_, _, items) in zip(rows.tolist(), hits):
        out.setdefault(r, set()).update(items)
    return out


def _listed(items: set) -> list[str]:
    return sorted(x for x in items if x is not None)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _report(index):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            words = Words(part["text"], NOT_ALNUM, lower=True)
            hits = index.value.hits(words)
            upto = np.concatenate([[0], np.cumsum(_cover(words, hits))])
            n_hit = np.diff(upto[words.first])
            items = {r: _listed(x) for r, x in _items_of(words, hits).items()}
            empty = _digest([])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words.per_row), pa.array(n_hit), pa.array([len(items.get(r, ())) for r in range(part.num_rows)], pa.int64()), pa.array([_digest(items[r]) if r in items else empty for r in range(part.num_rows)], pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return report


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _found(index):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text_key, spans, items) of rows with a hit in this block."""
        for part in parts(batches, "text"):
            words = Words(part["text"], NOT_ALNUM, lower=True)
            hits = index.value.hits(words)
            items, spans = _items_of(words, hits), {}
            for s, n, _ in hits:
                r = int(np.searchsorted(words.first, s, "right") - 1)
                spans.setdefault(r, []).append({"start": s - int(words.first[r]), "length": n})
            rows = sorted(items)
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(rows, pa.int64())), part["text_key"].take(pa.array(rows, pa.int64())), pa.array([spans[r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array([_listed(items[r]) for r in rows], pa.list_(pa.string()))], ["doc_id", "text_key", "spans", "items"])

    return found


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        words = Words(part["text"], NOT_ALNUM, lower=True)
        hits = [(int(words.first[r]) + x["start"], x["length"], set()) for r, spans in enumerate(part["spans"].to_pylist()) for x in spans or ()]
        n_hit = np.diff(np.concatenate([[0], np.cumsum(_cover(words, hits))])[words.first])
        items = [sorted(x or ()) for x in part["items"].to_pylist()]
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(words.per_row), pa.array(n_hit), pa.array(list(map(len, items)), pa.int64()), pa.array(list(map(_digest, items)), pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Index]:
    """Indexes of the items in bounded blocks; the driver holds one block at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL").toLocalIterator()
    for item, text in rows:
        held.append((item, text))
        size += len(text) // 4 + 1
        if size >= block_words:
            yield Index(held, window)
            held, size = [], 0
    yield Index(held, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A null text or item text has no words. Items without item_id mark words but are not listed; a
    repeated item_id counts once. Repeated rows each get their row. No items: nothing is hit.
    Columns other than doc_id, text and item_id are ignored.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_report(context.broadcast(first)), _REPORT)
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    found, block = None, first
    while block is not None:
        own = keyed.mapInArrow(_found(context.broadcast(block)), "doc_id long, text_key long, spans array<struct<start:int,length:int>>, items array<string>")
        found = own if found is None else found.union(own)
        block, second = second, next(blocks, None)
    # repeated rows give equal spans and items, which the sets below hold once
    own = found.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    own = own.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "spans", "items")
    rows = keyed.join(own, keyed["doc_id"].eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    return rows.select("doc_id", "text", "spans", "items").mapInArrow(_merged, _REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs`, all its columns, without benchmark passages: `remove` "documents" drops hit rows, "spans" cuts from the first to the last byte of each run of hit words.

    In "spans" mode a row goes only if hit windows cover all its words. Rows without a hit stay as they are, null and empty texts too; repeated
    rows fare alike, an empty table gives an empty result, and other columns stay whatever their names. One block of the benchmark takes one pass.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    context, names = docs.sparkSession.sparkContext, docs.columns
    rows = docs.toDF(*["text" if c == "text" else f"c{n}" for n, c in enumerate(names)])  # whatever the names are
    blocks = _blocks(benchmark, window, block_words)
    index, following = next(blocks), next(blocks, None)
    spans = "array<struct<start:int,length:int>>"
    while following is not None:  # blocks are of whole items, and each judges the text as it was
        rows = rows if "spans" in rows.columns else rows.withColumn("spans", F.lit(None).cast(spans))
        rows = rows.mapInArrow(_spans(context.broadcast(index)), rows.schema)
        index, following = following, next(blocks, None)
    kept = [c for c in rows.columns if c != "spans"]
    out = rows.mapInArrow(_cut(context.broadcast(index), remove, kept), rows.select(*kept).schema)
    return out.toDF(*names)


def _add_spans(part: pa.RecordBatch, index) -> tuple[Words, list]:
    """The part's words, and the spans of hit windows of each row: those told before and this block's."""
    words = Words(part["text"], NOT_ALNUM, lower=True)
    spans = part["spans"].to_pylist() if "spans" in part.schema.names else [None] * part.num_rows
    for s, n, _ in index.hits(words):
        r = int(np.searchsorted(words.first, s, "right") - 1)
        spans[r] = (spans[r] or []) + [{"start": s - int(words.first[r]), "length": n}]
    return words, spans


def _spans(index):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            found = pa.array(_add_spans(part, index.value)[1], part["spans"].type)
            yield pa.RecordBatch.from_arrays([found if c == "spans" else part[c] for c in part.schema.names], part.schema.names)

    return spans


def _cut(index, remove: str, kept: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            words, spans = _add_spans(part, index.value)
            keep, texts = np.ones(part.num_rows, bool), part["text"]
            hit = [r for r, x in enumerate(spans) if x]
            if hit and remove == "documents":
                keep[hit] = False
            elif hit:
                texts = texts.to_pylist()
                for r in hit:
                    first, last, base = int(words.first[r]), int(words.first[r + 1]), int(words.offsets[r])
                    edge = np.zeros(last - first + 1, np.int64)
                    for x in spans[r]:
                        edge[x["start"]] += 1
                        edge[x["start"] + x["length"]] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    raw = texts[r].encode()
                    gone = np.zeros(len(raw) + 1, np.int64)
                    for i in np.flatnonzero(covered).tolist():
                        end = words.start[first + i + 1] if i + 1 < len(covered) and covered[i + 1] else words.end[first + i]
                        gone[words.start[first + i] - base] += 1
                        gone[end - base] -= 1
                    texts[r] = np.frombuffer(raw, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes().decode()
                    keep[r] = not covered.all()
                texts = pa.array(texts, part["text"].type)
            out = pa.RecordBatch.from_arrays([texts if c == "text" else part[c] for c in kept], kept)
            yield out.filter(pa.array(keep)) if hit else out

    return cut
