"""Phrases whose words stand together more often than chance would have it.

Identical pieces of text are first counted once each, with their multiplicity; phrases are then counted
over the distinct pieces, weighted by it. Each count is the same job: a task turns its rows into counted items, sorted and
packed by hash bucket, and the task of a bucket sums them in DuckDB, which spills to the worker's own disk when a
bucket outgrows its memory. A phrase of n words is only sent if both its runs of n - 1 words may be frequent, by a bit
table of the frequent ones (its size is bounded; a full table lets more through and loses none).

The parts of each candidate lie in other buckets, so each candidate sends a request for every part, the requests meet the counts in a
shuffled join, and the answers go back to their candidate.
"""

from __future__ import annotations

import json
import math
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.lineage import release, stored
from chainframe.llm.text import Words, _lut, chain, parts, tidy

#: Bytes that end a piece.
ENDS = _lut(b".,;:!?\n\x0b\x0c\r")
#: Text bytes counted at once; text bytes for each bucket, buckets of a task (so that tasks are even) and buckets at most: larger ones spill.
SLICE, BUCKET_BYTES, PER_TASK, MOST_BUCKETS = 4 << 20, 4 << 20, 2, 1 << 14
#: DuckDB's memory in a worker, and rows handed to and taken from it at once.
MEMORY, ROWS = "160MB", 1 << 15
#: Bits of the table of frequent phrases for each of them, log2 of the bits at most, and log2 of the parts it is built in.
BITS_EACH, MOST_LOG_BITS, LOG_PARTS = 16, 29, 6


class Frequent:
    """Which phrases, by hash, may be frequent: a bit table."""

    def __init__(self, bits: np.ndarray, log_bits: int):
        self.bits, self.log_bits = bits, log_bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.log_bits)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _hashed(values: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def _packed(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, h: np.ndarray, lang: np.ndarray, names: list[str], buckets: int) -> pa.RecordBatch:
    """Counted items data[start:end], one row for each bucket: how many of each language, their counts, then the items with a line feed (which no item has) after each."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    group = bucket * max(len(names), 1) + lang
    order = np.argsort(group, kind="stable")
    start, n, group = start[order], n[order], group[order]
    size = end[order] - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = data[np.minimum(np.repeat(start - to[:-1], size) + np.arange(to[-1]), max(len(data) - 1, 0))] if len(data) else np.zeros(to[-1], np.uint8)
    out[to[1:] - 1] = 10
    bucket, lang = np.divmod(group, max(len(names), 1))
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    last = np.append(first[1:], len(group))
    squeeze, items = zstandard.ZstdCompressor(1).compress, []
    for a, b in zip(first.tolist(), last.tolist()):
        known, each = np.unique(lang[a:b], return_counts=True)
        head = json.dumps([[names[k], m] for k, m in zip(known.tolist(), each.tolist())]).encode()
        items.append(squeeze(len(head).to_bytes(4, "little") + head + n[a:b].tobytes() + out[to[a] : to[b]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(items, pa.binary())], ["bucket", "items"])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, item, n): the sums of a task's packed items that reach `least`, by DuckDB."""

    def rows() -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for blob in batch["items"]:
                raw = expand(blob.as_py())
                at = 4 + int.from_bytes(raw[:4], "little")
                langs = json.loads(raw[4:at])
                count = sum(m for _, m in langs)
                text = np.frombuffer(raw, np.uint8, offset=at + 8 * count)
                ends = np.flatnonzero(text == 10)
                bounds = np.empty(2 * count, np.int64)  # item, line feed, item, line feed, ...
                bounds[::2], bounds[1::2] = np.append(0, ends[:-1] + 1), ends
                both = pa.Array.from_buffers(pa.large_string(), max(2 * count - 1, 0), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
                items = both.take(pa.array(np.arange(0, 2 * count, 2)))
                held.append(pa.RecordBatch.from_arrays([pa.array([x for x, _ in langs], pa.string()).take(pa.array(np.repeat(np.arange(len(langs)), [m for _, m in langs]))), items, pa.array(np.frombuffer(raw, np.int64, count, at))], schema=kind))
                size += count
                if size >= ROWS:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    kind = pa.schema([("lang", pa.string()), ("item", pa.large_string()), ("n", pa.int64())])
    folder = tempfile.mkdtemp()
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        items = pa.RecordBatchReader.from_batches(kind, rows())  # noqa: F841  read by name
        yield from con.sql(f"SELECT lang, item, CAST(sum(n) AS BIGINT) AS n FROM items GROUP BY lang, item HAVING sum(n) >= {least:d}").to_arrow_reader(ROWS)
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)
        tidy()


def _pieces(buckets: int):
    """Rows (lang, text) to packed distinct pieces, words joined by one blank, with their multiplicities."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text", SLICE):
            cut = Words(part["text"], ENDS, lower=True)
            if not len(cut):
                continue
            bounds = np.empty(2 * len(cut), np.int64)  # piece, gap, piece, gap, ... piece
            bounds[::2], bounds[1::2] = cut.start, cut.end
            coded = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(cut.data))]).dictionary_encode()
            code = coded.indices.to_numpy()[::2].astype(np.int64)
            clean = pc.ascii_trim(pc.replace_substring_regex(coded.dictionary, r"[ \t]+", " "), " ").dictionary_encode()
            code, distinct = clean.indices.to_numpy().astype(np.int64)[code], clean.dictionary
            langs = part["lang"].dictionary_encode()
            key, n = np.unique(langs.indices.to_numpy().astype(np.int64)[cut.row] * len(distinct) + code, return_counts=True)
            lang, code = np.divmod(key, len(distinct))
            offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
            data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
            full = offsets[code + 1] > offsets[code]
            lang, code, n = lang[full], code[full], n[full]
            if len(code):
                h = _hashed(pc.cast(distinct, pa.large_binary()).to_pylist())[code]
                yield _packed(data, offsets[code], offsets[code + 1], n.astype(np.int64), h, lang, langs.dictionary.to_pylist(), buckets)

    return pieces


def _merged(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices of SLICE bytes of that column, about."""
    held, size = [], 0
    for batch in parts(batches, column, SLICE):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch[column])).as_py() or 0
        if size >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _run_hashes(words: Words, h: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, with their language; lang: each word's language as a hash."""
    out = lang
    for k in range(n):
        out = chain(out[: len(h) - k], h[k:])
    return out


def _phrases(n: int, frequent, buckets: int):
    """Rows (lang, item, n) of distinct pieces to packed phrases of n words; with one word, an empty phrase too, which counts all words."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _merged(batches, "item"):
            words = Words(part["item"])
            if len(words) < n:
                continue
            codes, distinct = words.codes()
            h = _hashed(distinct)[codes]
            langs = part["lang"].dictionary_encode()
            names, row = langs.dictionary.to_pylist(), words.row
            lang = langs.indices.to_numpy().astype(np.int64)[row]
            seed = _hashed([x.encode() for x in names])
            times = part["n"].to_numpy()[row]
            starts = len(words) - n + 1
            good = np.arange(starts) + n <= words.last[:starts]
            if n > 1:
                held = frequent.value.holds(_run_hashes(words, h, seed[lang], n - 1))
                good &= held[:starts] & held[1 : starts + 1]
            at = np.flatnonzero(good)
            if not len(at):
                continue
            key, top = lang[at], len(names)
            for k in range(n):
                if top * len(distinct) >= 1 << 62:  # numbered anew, so that the key stays exact
                    key = np.unique(key, return_inverse=True)[1]
                    top = len(at)
                key, top = key * len(distinct) + codes[at + k], top * len(distinct)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            one, total = at[order[first]], np.add.reduceat(times[at][order], first)
            yield _packed(words.data, words.start[one], words.end[one + n - 1], total, _run_hashes(words, h, seed[lang], n)[one], lang[one], names, buckets)
            if n == 1:
                sums = np.zeros(len(names), np.int64)
                np.add.at(sums, lang, times)
                none = np.zeros(len(names), np.int64)
                yield _packed(words.data, none, none, sums, seed, np.arange(len(names)), names, buckets)

    return phrases


def _counts(least: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(batches, least)

    return counts


def _counts_with_hash(least: int, n: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _summed(batches, least):
            words = Words(found["item"])
            codes, distinct = words.codes()
            langs = found["lang"].dictionary_encode()
            seed = _hashed([x.encode() for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
            full = words.per_row > 0
            h = seed.copy()
            if full.any():
                h[full] = _run_hashes(words, _hashed(distinct)[codes], seed[words.row], n)[words.first[:-1][full]]
            yield pa.RecordBatch.from_arrays([*(found[c] for c in ("lang", "item", "n")), pa.array(h.view(np.int64))], ["lang", "item", "n", "h"])

    return counts


def _bits(log_bits: int):
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        small = log_bits - LOG_PARTS
        for batch in batches:
            at = (batch["h"].to_numpy().view(np.uint64) >> np.uint64(64 - log_bits)).astype(np.int64)
            for k in np.unique(at >> small).tolist():
                held.setdefault(k, np.zeros(1 << small, np.uint8))[at[at >> small == k] - (k << small)] = 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1) for x in held.values()], pa.binary())], ["part", "bits"])

    return bits


def _table(counts: DataFrame) -> Frequent:
    """The bit table of the phrases of a table of counts; at most 64 MB."""
    log_bits = min(MOST_LOG_BITS, max(16, math.ceil(math.log2(BITS_EACH * counts.count() + 1))))
    size = 1 << (log_bits - 3 - LOG_PARTS)
    rows = counts.select("h", F.shiftrightunsigned("h", 64 - LOG_PARTS).alias("part")).repartition(1 << LOG_PARTS, "part").select("h")
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    for row in rows.mapInArrow(_bits(log_bits), "part int, bits binary").toLocalIterator():
        bits[row["part"] * size : (row["part"] + 1) * size] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return Frequent(bits, log_bits)


_PACKED, _COUNTS = "bucket int, items binary", "lang string, item string, n long"


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> list[DataFrame]:
    """Tables (lang, item, n, h), one for each length up to `longest`, of phrases with n >= least; the first has an empty phrase too, of which n is all words.

    The tables are kept in the shared folder; `release` deletes them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(PER_TASK, size // BUCKET_BYTES))
    tasks = buckets // PER_TASK
    pieces = stored(rows.mapInArrow(_pieces(buckets), _PACKED).repartition(tasks, "bucket").mapInArrow(_counts(1), _COUNTS))
    out: list[DataFrame] = []
    for n in range(1, longest + 1):
        frequent = spark.sparkContext.broadcast(_table(out[-1])) if out else None
        sent = pieces.mapInArrow(_phrases(n, frequent, buckets), _PACKED)
        out.append(stored(sent.repartition(tasks, "bucket").mapInArrow(_counts_with_hash(least, n), f"{_COUNTS}, h long")))
        if frequent is not None:
            frequent.unpersist()
    release(pieces)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2_000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to `longest` words.

    a is the phrase's count (at least `least`), l and r those of its two parts at the cut of lowest score floor(10^6 a a / (l r)), ties to the
    shortest first part, and n the language's words. Phrases that lie in a longer candidate with at least `share` percent of their count go. Ranks are by
    score and count from high to low, then by the phrase's bytes, so there are no ties. A null text is empty, a null language "und"; empty texts and pieces count for
    nothing, repeated rows count each time, and a very long text is one row among others (a slice of its own). An empty table gives an empty result; columns other than
    text and lang are ignored. Counts may reach 10^15.
    """
    counts = phrase_counts(docs, longest, least)
    known = counts[0]
    for t in counts[1:]:
        known = known.unionByName(t)
    known = known.select("lang", F.col("item").alias("part"), F.col("n").alias("f"))
    found = known.filter("instr(part, ' ') > 0").select("lang", F.col("part").alias("phrase"), F.col("f").alias("a"), F.split("part", " ").alias("w"))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    ends = F.explode(F.array(F.struct(F.lit(True).alias("head"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("head"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("part"))))
    asked = cuts.select("lang", "phrase", "a", "k", ends.alias("e")).select("lang", "phrase", "a", "k", "e.head", "e.part")
    answers = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = answers.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    lengths = F.explode(F.expr("filter(sequence(2, greatest(size(w) - 1, 2)), z -> z < size(w))"))
    inner = found.withColumn("length", lengths).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    covered = inner.select("lang", joined(F.col("at"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    words = known.filter("part = ''").select("lang", F.col("f").alias("n"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
