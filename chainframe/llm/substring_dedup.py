"""Repeated word windows, found with a count-min prefilter and then exactly.

First pass: each window of 35 words is stood for by the least hash among its 20-word runs, and each partition
counts the places of those runs. Equal windows have equal least runs at different places, so a run's count is
never below a window's; taking the runs in place of the windows leaves an eighth as many items.
A partition's sketch is sparse: the counted runs themselves, dealt to shards by hash range. A shard's
count-min sketch is the sum of all partitions' entries, and it overestimates; runs that it says
stand in one place only are done with. The number of shards grows with the corpus, so no task holds more
than a fraction, however large the corpus is.

What is broadcast is a bit table of the runs estimated repeated, sized by their number up to a bound (64 MB by default).
Above some 10^8 distinct repeated runs it fills up: more windows then go on, and still none is lost.

Second pass: only windows whose run's bit is set are grouped exactly. A window seen twice within
one slice of a partition is settled there and stands once in the shuffle. Windows meet by least run; the few runs that
stand in very many places, such as a line that many documents share, are known from their counts, and their windows are spread by the windows' own hashes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut
from chainframe.llm.text import Words, binary_rows, chain, grams, mix, parts, slide

WINDOW, RUN = 35, 20
#: Counted runs sent on together by a partition and held by a shard, about; shards of one task, so that tasks are even; sketch cells for each run; text bytes for each, about.
HELD_RUNS, SHARD_RUNS, SHARDS_PER_TASK, CELLS, BYTES_PER_RUN = 1_000_000, 100_000, 4, 8, 48
#: Bits of the broadcast table for each repeated run, and log2 of the bits at most.
BITS_PER_RUN, MOST_LOG_CELLS = 16, 29
#: Places from which a run's windows are spread (more in a corpus of over HOT * MOST_HOT runs, so that at most MOST_HOT such runs are listed), and windows that stay together then.
HOT, MOST_HOT, PER_SALT = 2_000, 500_000, 1_000
#: Candidate windows that are settled together in one task.
SETTLE_WINDOWS = 300_000


class Windows:
    """Windows of the rows of one column: which starts are whole (`valid`), their least run (`least`)."""

    def __init__(self, column: pa.Array, window: int, run: int):
        self.words = Words(column)
        self.h, n = self.words.hashes(), len(self.words)
        self.window, starts = window, max(0, n - window + 1)
        self.valid = np.arange(starts) + window <= self.words.last[:starts]
        self.runs = grams(self.h, run)
        self.span = window - run + 1
        self.least = slide(self.runs, self.span) if starts else np.zeros(0, np.uint64)

    def chosen_runs(self) -> np.ndarray:
        """The hashes of all runs that are least in some whole window, once for each place."""
        if not len(self.valid):
            return self.runs[:0]
        most = np.zeros(len(self.runs) + self.span - 1, np.uint64)
        most[self.span - 1 : self.span - 1 + len(self.least)] = np.where(self.valid, self.least, 0)
        return self.runs[slide(most, self.span, np.maximum) == self.runs]


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return binary_rows(np.ascontiguousarray(values), bounds)


def _counted_runs(window: int, run: int, log_shards: int):
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        runs, times = np.unique(np.concatenate(held), return_counts=True)
        # in hash order, so a shard's runs lie together
        at = np.searchsorted(runs >> np.uint64(64 - log_shards), np.arange((1 << log_shards) + 1, dtype=np.uint64)) if log_shards else np.array([0, len(runs)])
        full = np.flatnonzero(np.diff(at))
        bounds = np.append(at[full], len(runs))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _blobs(runs, bounds), _blobs(np.minimum(times, 0xFFFFFFFF).astype(np.uint32), bounds)], ["shard", "runs", "times"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches, "text"):
            held.append(Windows(part["text"], window, run).chosen_runs())
            size += len(held[-1])
            if size >= HELD_RUNS:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return counted


def _repeated_runs(cells: int, hot: int):
    def repeated(shard: int, runs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        width = 1 << max(4, math.ceil(math.log2(cells * len(runs) / 2)))  # of each of two rows
        rows = [(mix(runs + np.uint64(k)) & np.uint64(width - 1)).astype(np.int64) for k in (1, 2)]
        estimate = np.minimum(*(np.bincount(c, times, width)[c] for c in rows))
        many = np.unique(runs[estimate >= 2])
        peak, first = np.unique(runs[estimate >= hot], return_index=True)
        often = estimate[estimate >= hot][first].astype(np.int64)
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(many)], pa.int64()), one(many), one(peak), one(often)], ["shard", "n", "runs", "hot", "places"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard."""
        now, runs, times = None, [], []
        for batch in batches:
            for shard, r, t in zip(batch["shard"].to_pylist(), batch["runs"].to_pylist(), batch["times"].to_pylist()):
                if shard != now and runs:
                    yield repeated(now, np.concatenate(runs), np.concatenate(times))
                    runs, times = [], []
                now = shard
                runs.append(np.frombuffer(r, np.uint64))
                times.append(np.frombuffer(t, np.uint32))
        if runs:
            yield repeated(now, np.concatenate(runs), np.concatenate(times))

    return each


def _bit_table(log_cells: int, log_shards: int):
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, runs in zip(batch["shard"].to_pylist(), batch["runs"].to_pylist()):
                bits = np.zeros(1 << (log_cells - log_shards), np.uint8)
                bits[(np.frombuffer(runs, np.uint64) >> np.uint64(64 - log_cells)).astype(np.int64) - (shard << (log_cells - log_shards))] = 1
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["shard", "bits"])

    return table


class Repeated:
    """The runs estimated repeated, as a bit table, and in how many groups the windows of each very frequent run are spread."""

    def __init__(self, bits: np.ndarray, log_cells: int, hot: np.ndarray, places: np.ndarray):
        order = np.argsort(hot)
        self.bits, self.log_cells, self.hot, self.salts = bits, log_cells, hot[order], (-(-places[order] // PER_SALT)).astype(np.uint64)

    def holds(self, runs: np.ndarray) -> np.ndarray:
        cell = runs >> np.uint64(64 - self.log_cells)
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def keys(self, runs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """What windows meet by: their run, and for a very frequent run one of its groups by the window's hash."""
        if not len(self.hot):
            return runs
        at = np.minimum(np.searchsorted(self.hot, runs), len(self.hot) - 1)
        spread = self.hot[at] == runs
        return np.where(spread, chain(runs, windows % self.salts[at]), runs)


def repeated_runs(docs: DataFrame, window: int, run: int, log_cells: int | None = None, cells: int = CELLS) -> Repeated:
    """The first pass over the whole corpus."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, size // BYTES_PER_RUN)
    log_shards = max(0, math.ceil(math.log2(expected / SHARD_RUNS)))
    if log_cells is not None:
        log_shards = max(0, min(log_shards, log_cells - 3))
    sent = docs.select("text").mapInArrow(_counted_runs(window, run, log_shards), "shard int, runs binary, times binary")
    tasks = max(1, (1 << log_shards) // SHARDS_PER_TASK)
    found = sent.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_repeated_runs(cells, max(HOT, expected // MOST_HOT)), "shard int, n long, runs binary, hot binary, places binary")
    found = cut(found)
    n = found.agg(F.sum("n")).first()[0] or 0
    if log_cells is None:
        log_cells = min(MOST_LOG_CELLS, max(16, math.ceil(math.log2(BITS_PER_RUN * n + 1))))
    log_cells = max(log_cells, log_shards + 3)
    bits, part = np.zeros(1 << (log_cells - 3), np.uint8), 1 << (log_cells - 3 - log_shards)
    for row in found.mapInArrow(_bit_table(log_cells, log_shards), "shard int, bits binary").collect():
        bits[row["shard"] * part : (row["shard"] + 1) * part] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    hot = found.filter("length(hot) > 0").select("hot", "places").collect()  # at most MOST_HOT runs, about
    return Repeated(bits, log_cells, *(np.frombuffer(b"".join(r[c] for r in hot), t) for c, t in (("hot", np.uint64), ("places", np.int64))))


def _bands(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of consecutive true flags over which the other arrays don't change."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.append(at[first[1:] - 1], at[-1]) + 1


_RUNS = "least long, doc_id long, text_key long, start int, length int, hashes binary"
_MARKS = "doc_id long, text_key long, start int, length int"


def _candidates(window: int, run: int, repeated):
    def settle(held: list) -> Iterator[pa.RecordBatch]:
        """Windows that repeat among those held are marked at once (no hashes); the first of each goes on to the exact pass."""
        least, h, valid = (np.concatenate([x[k] for x in held]) for k in range(3))
        doc, key, at = (np.concatenate([x[k] for x in held]) for k in range(3, 6))
        null = np.concatenate([x[6] for x in held])
        pos = np.flatnonzero(valid)
        order = pos[np.lexsort((least[pos], h[pos]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (least[order[1:]] != least[order[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        repeated, sent = np.zeros(len(h), bool), np.zeros(len(h), bool)
        repeated[order[many]] = True
        sent[order[new]] = True
        for flags, with_hashes in ((repeated, False), (sent, True)):
            first, end = _bands(flags, doc, key, null, *([least] if with_hashes else []), at - np.arange(len(at)))
            if not len(first):
                continue
            length = end - first
            offsets = np.concatenate([[0], np.cumsum(length)]) if with_hashes else np.zeros(len(first) + 1, np.int64)
            picked = h[np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])] if with_hashes else h[:0]
            # marks pass through the exact pass untouched: they go to any task
            yield pa.RecordBatch.from_arrays([pa.array((least if with_hashes else chain(key.view(np.uint64), at.view(np.uint64)))[first].view(np.int64)), pa.array(doc[first], mask=null[first]), pa.array(key[first]), pa.array(at[first].astype(np.int32)), pa.array(length.astype(np.int32)), binary_rows(picked, offsets)], ["least", "doc_id", "text_key", "start", "length", "hashes"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeated.value
        held, size = [], 0
        for part in parts(batches, "text"):
            w = Windows(part["text"], window, run)
            maybe = np.flatnonzero(w.valid & known.holds(w.least)) if len(w.valid) else w.valid
            if len(maybe):
                row, ids, whole = w.words.row[maybe], part["doc_id"], grams(w.h, window)[maybe]
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
                held.append((known.keys(w.least[maybe], whole), whole, np.ones(len(maybe), bool), doc, part["text_key"].to_numpy()[row], maybe - w.words.first[row], ids.is_null().to_numpy(zero_copy_only=False)[row]))
                size += len(maybe)
            if size >= SETTLE_WINDOWS:
                yield from settle(held)
                held, size = [], 0
        if held:
            yield from settle(held)

    return candidates


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by least run: marks the windows that stand in two rows. A row's windows differ from each other."""

    def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        length, least = table["length"].to_numpy(), table["least"].to_numpy()
        blob = table["hashes"].combine_chunks()
        data, offsets = np.frombuffer(blob.buffers()[2] or b"", np.uint8), np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
        has = np.diff(offsets) > 0
        row = np.repeat(np.arange(len(length)), np.where(has, length, 0))
        h = data[offsets[0] : offsets[-1]].view(np.uint64)
        order = np.lexsort((least[row], h))
        same = (h[order[1:]] == h[order[:-1]]) & (least[row[order[1:]]] == least[row[order[:-1]]])
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        first, end = _bands(hit, row)
        base = np.concatenate([[0], np.cumsum(np.where(has, length, 0))])
        at = np.concatenate([np.flatnonzero(~has), row[first]])
        start = table["start"].to_numpy()[at] + np.concatenate([np.zeros(int((~has).sum()), np.int64), first - base[row[first]]])
        long = np.concatenate([length[~has], end - first])
        if len(at):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(at)), table["text_key"].combine_chunks().take(pa.array(at)), pa.array(start.astype(np.int32)), pa.array(long.astype(np.int32))], ["doc_id", "text_key", "start", "length"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["least"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if cut:
            held.append(batch.slice(0, cut))
            yield from marks(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from marks(pa.Table.from_batches(held))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, log_cells: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, length): the starts of windows whose word sequence also starts elsewhere, as ranges of word indices."""
    keyed = _with_key(docs)
    spark = docs.sparkSession
    repeated = spark.sparkContext.broadcast(repeated_runs(keyed, window, run, log_cells))
    runs = keyed.mapInArrow(_candidates(window, run, repeated), _RUNS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return runs.repartition(tasks, "least").sortWithinPartitions("least").mapInArrow(_exact, _MARKS)


def _remove(window: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            words = Words(part["text"])
            n = len(words)
            marks = part["marks"]
            flat = marks.flatten()
            counts = np.diff(marks.offsets.to_numpy()) if len(marks) else np.zeros(0, np.int64)
            counts = np.where(marks.is_null().to_numpy(zero_copy_only=False), 0, counts)
            edge = np.zeros(n + 1, np.int64)
            if len(flat):
                start = words.first[np.repeat(np.arange(len(counts)), counts)] + flat.field("start").to_numpy()
                np.add.at(edge, start, 1)
                np.add.at(edge, start + flat.field("length").to_numpy() + window - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            upto = np.concatenate([[0], np.cumsum(keep)])
            kept = np.diff(upto[words.first])
            length = (words.end - words.start)[keep] + 1  # and a space
            ends = np.concatenate([[0], np.cumsum(length)])
            out = words.data[np.minimum(np.repeat(words.start[keep] - ends[:-1], length) + np.arange(ends[-1]), max(len(words.data) - 1, 0))]
            out[ends[1:] - 1] = 32
            at = ends[upto[words.first]]
            view, total = memoryview(out), words.per_row
            texts = [view[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            if keep_text:  # rows without repeats keep their text as it was
                texts = [bytes(t) if r else None for t, r in zip(texts, (kept < total).tolist())]
                yield pa.RecordBatch.from_arrays([part[c] for c in part.schema.names if c not in ("text", "marks")] + [pa.array([old if new is None else new.decode() for old, new in zip(part["text"].to_pylist(), texts)], pa.string())], [c for c in part.schema.names if c not in ("text", "marks")] + ["text"])
            else:
                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(total), pa.array(total - kept), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove


def _marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (with doc_id, text, text_key) and each row's marks; a document's own marks, those of equal rows once, are the only rows gathered for it."""
    own = marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("marks"))
    own = own.select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), "marks")
    return docs.join(own, docs["doc_id"].eqNullSafe(F.col("mark_id")) & (docs["text_key"] == F.col("mark_key")), "left").drop("mark_id", "mark_key")


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, log_cells: int | None = None) -> DataFrame:
    """Per document (doc_id, n_words, n_removed, kept_sha256) when each word covered by a repeated window goes.

    Windows are judged on the input. Null texts have no words; texts shorter than a window keep all
    their words. Equal rows repeat each other. A row without doc_id is treated like any other.
    An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    rows = _marked(_with_key(docs), repeated_windows(docs, window, run, log_cells))
    return rows.select("doc_id", "text", "marks").mapInArrow(_remove(window, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, log_cells: int | None = None) -> DataFrame:
    """`docs`, all its columns, with repeated passages cut from `text`; kept words of a changed text are joined by one space."""
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("was"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = _marked(keyed, repeated_windows(docs, window, run, log_cells)).withColumn("absent", F.col("was").isNull()).select("rest", "absent", "text", "marks")
    out = rows.mapInArrow(_remove(window, True), f"rest {rows.schema['rest'].dataType.simpleString()}, absent boolean, text string")
    text = F.when(F.col("absent"), F.lit(None).cast("string")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"rest.`{c}`") for c in names])
