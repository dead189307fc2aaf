"""Wide tables and matrices in packets, for iterations that multiply the same matrix many times.

A hash of the id deals states to packets, in which they are numbered by id. A wide table is (b, x, g): a row holds all columns of the states of one packet, as the
bytes of one column after the other, and their dot products there. A matrix is (b, to, rows, cols, w): the entries by which the states of packet b move those of
packet `to`, by row. So a product moves a row for each pair of packets, not one for each entry, and no task holds more than a few packets, some entries and their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.lineage import cut

#: States of a packet (places are numbers of 16 bits), of small tables the least states and the packets wanted; entries of one row of a matrix; most packets of a task.
STATES, LEAST, PACKETS, ENTRIES, OF_TASK = 16_384, 1_024, 12, 65_536, 4

TABLE, MATRIX, PART = "b int, x binary, g binary", "b int, to int, rows binary, cols binary, w binary", "b int, src int, at binary, x binary"


def dealt(ids: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(i, b, p): packet and place of each of the n ids, and how many tasks take them."""
    packets = max(-(-n // STATES), min(PACKETS, -(-n // LEAST)))
    rows = ids.select("i", F.pmod(F.xxhash64("i"), F.lit(packets)).cast("int").alias("b"))
    places = rows.withColumn("p", F.row_number().over(Window.partitionBy("b").orderBy("i")) - 1)
    return cut(places), max(min(packets, ids.sparkSession.sparkContext.defaultParallelism), -(-packets // OF_TASK))


def _row(columns: list[str], values: list, schema: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema)], columns)


def _table(b: int, x: np.ndarray) -> pa.RecordBatch:
    return _row(["b", "x", "g"], [int(b), x.tobytes(), (x @ x.T).tobytes()], [pa.int32(), pa.binary(), pa.binary()])


def _numbers(cell: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
    return zip([0, *ends.tolist()], [*ends.tolist(), len(keys[0])])


def packed(rows: DataFrame, names: list[str], tasks: int) -> DataFrame:
    """The wide table of rows (b, p, names...) that name every place."""

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            b, x = batch["b"].to_numpy(), np.stack([batch[name].to_numpy(zero_copy_only=False) for name in names])
            for start, end in _runs([b]):
                if b[start] != at and held:
                    yield _table(at, np.concatenate(held, 1))
                    held = []
                at = b[start]
                held.append(x[:, start:end].copy())
        if held:
            yield _table(at, np.concatenate(held, 1))

    return rows.select("b", "p", *names).repartitionById(tasks, F.col("b")).sortWithinPartitions("b", "p").mapInArrow(stacked, TABLE)


def unpacked(table: DataFrame, names: list[str], places: DataFrame) -> DataFrame:
    """(i, names...) of a wide table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, cell in zip(batch["b"].to_pylist(), batch["x"]):
                x = _numbers(cell).reshape(len(names), -1)
                n = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, x)], ["b", "p", *names])

    rows = table.select("b", "x").mapInArrow(spread, "b int, p int, " + ", ".join(f"{x} double" for x in names))
    return places.join(rows, ["b", "p"]).select("i", *names)


def matrix(edges: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """(b, to, rows, cols, w) of edges (i, j, w)."""
    tails = places.select(F.col("i").alias("j"), "b", F.col("p").alias("c"))
    heads = places.select("i", F.col("b").alias("to"), F.col("p").alias("r"))
    entries = edges.join(tails, "j").join(heads, "i").select("b", "to", "r", "c", F.col("w").cast("double").alias("w"))

    def row(b: int, to: int, held: list[tuple]) -> pa.RecordBatch:
        r, c, w = (np.concatenate(x) for x in zip(*held))
        if max(r.max(), c.max()) > np.iinfo(np.uint16).max:
            raise ValueError("a packet has too many states")
        r, c = r.astype(np.uint16), c.astype(np.uint16)
        return _row(["b", "to", "rows", "cols", "w"], [int(b), int(to), r.tobytes(), c.tobytes(), w.tobytes()], [pa.int32(), pa.int32(), *[pa.binary()] * 3])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            b, to, r, c, w = (batch[x].to_numpy(zero_copy_only=False) for x in ("b", "to", "r", "c", "w"))
            for start, end in _runs([b, to]):
                if held and ((b[start], to[start]) != at or size >= ENTRIES):
                    yield row(*at, held)
                    held, size = [], 0
                at = (b[start], to[start])
                held.append((r[start:end].copy(), c[start:end].copy(), w[start:end].copy()))
                size += end - start
        if held:
            yield row(*at, held)

    return entries.repartitionById(tasks, F.col("b")).sortWithinPartitions("b", "to", "r", "c").mapInArrow(grouped, MATRIX)


def turned(table: DataFrame, by: np.ndarray) -> DataFrame:
    """The table times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, cell in zip(batch["b"].to_pylist(), batch["x"]):
                yield _table(b, by.T @ _numbers(cell).reshape(len(by), -1))

    return table.select("b", "x").mapInArrow(run, TABLE)


def _total(rows: list, name: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum over packets, in their order."""
    total = np.zeros(shape)
    for r in sorted(rows, key=lambda r: r["b"]):
        total += np.frombuffer(r[name]).reshape(shape)
    return total


def gram(table: DataFrame, columns: int) -> np.ndarray:
    """A' A for the table A."""
    return _total(table.select("b", "g").collect(), "g", (columns, columns))


def dots(table: DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(A left)' (A right) for the table A."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, cell in zip(batch["b"].to_pylist(), batch["x"]):
                x = _numbers(cell).reshape(len(left), -1)
                yield _row(["b", "g"], [b, ((left.T @ x) @ (right.T @ x).T).tobytes()], [pa.int32(), pa.binary()])

    return _total(table.select("b", "x").mapInArrow(summed, "b int, g binary").collect(), "g", (left.shape[1], right.shape[1]))


def _product(entries: DataFrame, x: DataFrame, columns: int, tasks: int) -> DataFrame:
    """(b, src, at, x): what the states of packet src add to the places `at` of packet b. A packet of the table comes before its entries, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = None, None
        for batch in batches:
            b, to = batch["b"].to_pylist(), batch["to"].to_pylist()
            for k in range(batch.num_rows):
                w = _numbers(batch["w"][k])
                if to[k] < 0:
                    own, of = w.reshape(columns, -1).copy(), b[k]
                elif of == b[k]:
                    r, c = (_numbers(batch[name][k], np.uint16) for name in ("rows", "cols"))
                    first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    y = np.add.reduceat(own[:, c] * w, first, 1)
                    yield _row(["b", "src", "at", "x"], [to[k], b[k], r[first].tobytes(), y.tobytes()], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    no = F.lit(None).cast("binary")
    both = x.select("b", F.lit(-1).alias("to"), no.alias("rows"), no.alias("cols"), F.col("x").alias("w")).union(entries)
    return both.repartitionById(tasks, F.col("b")).sortWithinPartitions("b", "to").mapInArrow(run, PART)


def _beside(table: DataFrame, turn: np.ndarray, parts: DataFrame, fresh: int, tasks: int) -> DataFrame:
    """The table times a small matrix, with fresh columns beside it, sums of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, y = None, None, None
        for batch in batches:
            for b, src, places, cell in zip(batch["b"].to_pylist(), batch["src"].to_pylist(), batch["at"], batch["x"]):
                if src < 0:
                    if at is not None:
                        yield _table(at, np.concatenate([x, y]))
                    at, x = b, turn.T @ _numbers(cell).reshape(len(turn), -1)
                    y = np.zeros((fresh, x.shape[1]))
                elif places.is_valid:
                    y[:, _numbers(places, np.uint16)] += _numbers(cell).reshape(fresh, -1)
                else:
                    y += _numbers(cell).reshape(fresh, -1)
        if at is not None:
            yield _table(at, np.concatenate([x, y]))

    both = table.select("b", F.lit(-1).alias("src"), F.lit(None).cast("binary").alias("at"), "x").union(parts)
    return both.repartitionById(tasks, F.col("b")).sortWithinPartitions("b", "src").mapInArrow(run, TABLE)


def with_product(table: DataFrame, turn: np.ndarray, entries: DataFrame, fresh: int, tasks: int) -> DataFrame:
    """The table times a small matrix, and beside it the matrix of these entries times the last `fresh` of its columns."""
    return _beside(table, turn, _product(entries, turned(table, turn[:, -fresh:]), fresh, tasks), fresh, tasks)


def with_columns(table: DataFrame, turn: np.ndarray, more: DataFrame, fresh: int, tasks: int) -> DataFrame:
    """The table times a small matrix, and beside it another table of `fresh` columns."""
    return _beside(table, turn, more.select("b", F.lit(0).alias("src"), F.lit(None).cast("binary").alias("at"), "x"), fresh, tasks)
