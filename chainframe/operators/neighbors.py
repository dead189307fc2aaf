"""Nearest-neighbour graphs and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import doubles

#: Bytes of the vectors of one block of queries, of which a task holds one, and of all vectors up to which they are broadcast; queries and points compared at once.
BLOCK_BYTES, BROADCAST_BYTES, AT_ONCE, TILE = 16 << 20, 16 << 20, 256, 2_048
#: Pairs of one task if points are broadcast; else the least blocks of queries, the least points of a block, and the parts of the points, each read by its own tasks.
TASK_PAIRS, BLOCKS, LEAST_BLOCK, PARTS = 100_000_000, 12, 2_048, 4


def _unit(x: pa.Array, rows: int) -> np.ndarray:
    x = x.flatten().to_numpy().astype(float).reshape(rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _filled(x: np.ndarray, rows: int) -> np.ndarray:
    return x if len(x) == rows else np.concatenate([x, np.zeros((rows - len(x), x.shape[1]))])


class _Best:
    """The k best points so far of at most AT_ONCE queries, less each itself: query numbers, points and cosines, by query and from the best on.

    Points come in tiles, in order of id, of which only those that beat a query's k best so far are looked at. Products are all of one shape, so equal
    vectors have equal cosines wherever they stand, and ties are settled by id.
    """

    def __init__(self, a: np.ndarray, own: np.ndarray, k: int):
        self.asked, self.own, self.k = _filled(a, AT_ONCE), own, k
        self.least = np.full(AT_ONCE, np.inf)
        self.least[: len(a)] = -np.inf
        self.rows, self.points, self.found = np.zeros(0, np.int32), None, np.zeros(0)

    def see(self, b: np.ndarray, ids: np.ndarray, points: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> None:
        """A tile: vectors (filled up to TILE rows), their ids, and what stands for them in `points`; room for cosines and flags."""
        cos, better = room
        np.matmul(self.asked, b.T, out=cos)
        cos[:, len(ids) :] = -np.inf
        first, last = np.searchsorted(ids, self.own), np.searchsorted(ids, self.own, "right")
        for q in np.flatnonzero(first < last):
            cos[q, first[q] : last[q]] = -np.inf
        np.greater(cos, self.least[:, None], out=better)
        k = self.k
        if np.count_nonzero(better) > 8 * k * len(self.own) and k < TILE:  # all that reach the tile's k-th best, so that ties are settled by id
            better &= cos >= np.partition(cos, TILE - k, 1)[:, TILE - k, None]
        hits = np.flatnonzero(better)
        if not len(hits):
            return
        new = points[hits % TILE]
        rows = np.concatenate([self.rows, (hits // TILE).astype(np.int32)])
        near, found = new if self.points is None else np.concatenate([self.points, new]), np.concatenate([self.found, cos.reshape(-1)[hits]])
        order = np.lexsort((-found, rows))  # stable, so ties stay in order of id
        rows, found = rows[order], found[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.least[rows[nth == k - 1]] = found[nth == k - 1]
        self.rows, self.points, self.found = rows[nth < k], near[order[nth < k]], found[nth < k]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        near = [] if self.points is None else self.points
        return pa.RecordBatch.from_arrays([pa.array(self.own[self.rows], kind), pa.array(near, kind), pa.array(self.found)], ["i", "j", "cos"])


def _room() -> tuple[np.ndarray, np.ndarray]:
    return np.empty((AT_ONCE, TILE)), np.empty((AT_ONCE, TILE), bool)


def _seen(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> _Best:
    best, room = _Best(a, own, k), _room()
    for at in range(0, len(b), TILE):
        best.see(_filled(b[at : at + TILE], TILE), ids[at : at + TILE], points[at : at + TILE], room)
    return best


def _top(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, point numbers, cosines) of the k best points, in order of id, for each of at most AT_ONCE queries, less itself."""
    best = _seen(a, own, b, ids, np.arange(len(b)), k)
    return best.rows, best.points if len(best.rows) else np.zeros(0, int), best.found


def _ids(i: pa.Array) -> np.ndarray:
    """Ids of their own memory: an Arrow slice would hold on to its whole batch."""
    return np.array(i.to_numpy(zero_copy_only=False))


def _compared(k: int):
    """For mapInArrow over rows (q, p, asks, i, x) sorted by q, p, queries first, and i: the best of each query of q among the points of part p.

    A group's queries are held, its points stream by.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, room = None, [], _room()
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, keys = batch.schema.field("i").type, np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("q", "p", "asks")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, end in zip([0, *ends], [*ends, batch.num_rows]):
                q, p, asks = keys[:, start]
                if (q, p) != group:
                    yield from (best.batch(kind) for best in asked)
                    group, asked = (q, p), []
                size = AT_ONCE if asks else TILE
                for at in range(start, end, size):
                    part = batch.slice(at, min(size, end - at))
                    if asks:
                        asked.append(_Best(_unit(part["x"], part.num_rows), _ids(part["i"]), k))
                    elif asked:
                        tile, ids = _filled(_unit(part["x"], part.num_rows), TILE), _ids(part["i"])
                        for best in asked:
                            best.see(tile, ids, ids, room)
        yield from (best.batch(kind) for best in asked)

    return nearest


def knn(points: DataFrame, k: int, vector: str = "x", block: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(i, j, d, w): the k nearest other points of each by cosine distance d = 1 - cos, with weight w = (1 + cos) / 2; exact, ties by id.

    Points (i, vector) have vectors of equal length. If all of them are at most broadcast_bytes, they are broadcast and each task compares its own points with
    them. Else a hash of the id deals them, as queries, to blocks (a twelfth of all, as far as LEAST_BLOCK and BLOCK_BYTES let it) and, as points, to
    PARTS parts; a task holds one block, while the points of one part stream by it in order of id, and keeps k a query. So its memory is a block and a batch
    however many points there are, and what is shuffled on is k rows for each query and part. AT_ONCE queries are compared with TILE points at a
    time. Vectors of length 0 have cosine 0 with all.
    """
    kind = points.schema["i"].dataType.simpleString()
    out = f"i {kind}, j {kind}, cos double"
    plain = points.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    rows = points.select("i", (F.col(vector) if plain else doubles(F.col(vector))).alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    n, width = size["n"], (size["dims"] or 0) * 8
    if n * width <= broadcast_bytes:
        table = rows.toArrow().sort_by("i").combine_chunks()
        ids, x = (table[c].combine_chunks() if n else table[c] for c in ("i", "x"))
        shared = points.sparkSession.sparkContext.broadcast((_ids(ids), _unit(x, n)) if n else None)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, every = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    yield _seen(_unit(part["x"], part.num_rows), _ids(part["i"]), every, ids, ids, k).batch(part["i"].type)

        tasks = n * n // TASK_PAIRS
        best = (rows.repartition(tasks + 1, "i") if tasks else rows).mapInArrow(near, out)
        return best.select("i", "j", (1 - F.col("cos")).alias("d"), ((1 + F.col("cos")) / 2).alias("w"))
    blocks = max(1, -(-n // (block or min(max(n // BLOCKS, LEAST_BLOCK), max(BLOCK_BYTES // width, 1)))))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(blocks * PARTS)).cast("int"))
    q, p = F.floor(F.col("h") / PARTS).cast("int"), F.pmod("h", F.lit(PARTS))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.select(q.alias("q"), all_of(PARTS).alias("p"), F.lit(True).alias("asks"), "i", "x")
    others = rows.select(all_of(blocks).alias("q"), p.alias("p"), F.lit(False).alias("asks"), "i", "x")
    dealt = queries.union(others).repartition(4 * blocks * PARTS, "q", "p").sortWithinPartitions("q", "p", F.desc("asks"), "i")
    best = dealt.mapInArrow(_compared(k), out).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cos"), "j"))).filter(F.col("r") <= k)
    return best.select("i", "j", (1 - F.col("cos")).alias("d"), ((1 + F.col("cos")) / 2).alias("w"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each pair with the larger of its two weights, both ways."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return edges.select("i", "j", "w").unionByName(back).groupBy("i", "j").agg(F.max("w").alias("w"))


def averaging(edges: DataFrame) -> DataFrame:
    """The row-normalized graph of equal weights with self-loops."""
    loops = edges.select("i").distinct().select("i", F.col("i").alias("j"))
    every = edges.filter("w <> 0").select("i", "j").union(loops).distinct()
    return every.withColumn("w", 1 / F.count("*").over(Window.partitionBy("i")).cast("double"))


def moments(edges: DataFrame, points: DataFrame, dims: int, vector: str = "x") -> DataFrame:
    """(i, k, mean, var) of each entry over the neighbourhood of `averaging`; the variance isn't clipped."""
    flat = points.select(F.col("i").alias("j"), F.posexplode(F.slice(vector, 1, dims)).alias("k", "v"))
    found = averaging(edges).join(flat, "j").groupBy("i", "k").agg(F.sum(F.col("w") * F.col("v")).alias("mean"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("square"))
    return found.select("i", "k", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"))


def boundary(edges: DataFrame, labels: DataFrame, source, target) -> DataFrame:
    """(i): cells of the source label with a neighbour of the target label; labels are (i, label)."""
    ours = labels.filter(F.col("label") == source).select("i")
    theirs = labels.filter(F.col("label") == target).select(F.col("i").alias("j"))
    return ours.join(edges.join(theirs, "j", "left_semi"), "i", "left_semi")


def neighbour_votes(edges: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(i, label) of cells of which at least `least` neighbours share the label, judged on the labels given."""
    theirs = labels.select(F.col("i").alias("j"), F.col("label").alias("theirs"))
    votes = edges.join(labels, "i").join(theirs, "j").groupBy("i", "label").agg(F.count_if(F.col("label") == F.col("theirs")).alias("votes"))
    return labels.join(votes, ["i", "label"], "left").filter(F.coalesce("votes", F.lit(0)) >= least).select("i", "label")
