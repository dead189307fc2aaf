"""MinHash near-duplicates with tensored banding.

A document's set is its distinct 5-word shingles. A table key joins one of m left half-keys
with one of m right half-keys, each of two minhashes, so m*m tables cost 4*m minhashes in
place of 4*m*m. At m = 10 a pair of similarity s meets in some table with probability
(1 - (1 - s^2)^10)^2: 0.9995 at 0.75, above 0.99999 at 0.85. Every candidate link is confirmed on the full sets.

Copies of one set are one node. First each node of a bucket is compared with the bucket's
smallest, a star and not all pairs. Buckets that then still hold two components are settled
exactly, with only links emitted: see `_rest`. So no link between nodes that met in a table is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.lineage import cut
from chainframe.linalg.components import connected_components
from chainframe.llm.text import Words, binary_rows, chain, grams, mix, parts

SHINGLE, SIMILAR, HALVES = 5, 75, 10
#: Up to so many candidate rows (a few dozen bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members and leads that meet in one group, about; members of one star, which has one lead; nodes with one left half-key that stay together.
PER_SALT, PER_BLOCK, PER_STAR, PER_KEY = 4_000, 2_000, 400, 20_000


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each row, and row offsets."""
    words = Words(column, lower=True)
    h, count = words.hashes(), words.per_row
    rows = np.arange(len(count))
    hashes, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= SHINGLE:
        inside = np.arange(len(h) - SHINGLE + 1) + SHINGLE <= words.last[: len(h) - SHINGLE + 1]
        hashes, row = grams(h, SHINGLE)[inside], words.row[: len(inside)][inside]
    for r in np.flatnonzero((count > 0) & (count < SHINGLE)):  # the whole sequence is the one shingle
        whole = grams(h[words.first[r] : words.first[r + 1]], int(count[r]))
        hashes, row = np.append(hashes, mix(whole + np.uint64(count[r]))), np.append(row, r)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.append(rows, len(rows)))


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set (0, 0 for the empty set)."""
    full, out = np.flatnonzero(np.diff(offsets)), []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        key = np.zeros(len(offsets) - 1, np.uint64)
        if len(full):
            key[full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), offsets[full])
        out.append(key.view(np.int64))
    return out[0], out[1]


def half_keys(hashes: np.ndarray, offsets: np.ndarray, halves: int) -> np.ndarray:
    """Rows x 2*halves: a hash of two minhashes for each left and right half-key (of non-empty rows; others 0)."""
    out = np.zeros((len(offsets) - 1, 2 * halves), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out.view(np.int64)
    seeds = np.random.default_rng(20_250_101).integers(1, 1 << 63, (4 * halves, 2), dtype=np.uint64)
    for i in range(2 * halves):
        pair = []
        for times, plus in seeds[2 * i : 2 * i + 2]:
            permuted = hashes * (times | np.uint64(1)) + plus
            pair.append(np.minimum.reduceat(permuted ^ (permuted >> np.uint64(29)), offsets[full]))
        out[full, i] = chain(pair[0], mix(pair[1] + np.uint64(i)))
    return out.view(np.int64)


def _sketches(halves: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            hashes, offsets = shingle_sets(part["text"])
            k1, k2 = set_keys(hashes, offsets)
            keys = half_keys(hashes, offsets, halves)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * halves
            sides = [pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[:, s].ravel())) for s in (slice(0, halves), slice(halves, None))]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(offsets)), pa.array(k1), pa.array(k2), *sides], ["doc_id", "n_shingles", "k1", "k2", "left", "right"])

    return sketches


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        hashes, offsets = shingle_sets(part["text"])
        k1, k2 = set_keys(hashes, offsets)
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(k1), pa.array(k2), binary_rows(hashes, offsets)], ["node", "k1", "k2", "shingles"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        hashes, offsets = shingle_sets(part["text"])
        row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        k1, k2 = set_keys(hashes, offsets)
        yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row)), pa.array(k1[row]), pa.array(k2[row]), pa.array(hashes.view(np.int64))], ["node", "k1", "k2", "shingle"])


class _Leads:
    """Sets that members of a group are compared with: an inverted index over their shingles."""

    def __init__(self, ids: list[int], labels: list[int], sets: list[np.ndarray]):
        self.ids, self.labels = np.array(ids), np.array(labels)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.lead = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingles, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))

    def similar(self, own: np.ndarray, similar: int) -> np.ndarray:
        """Leads whose Jaccard similarity with `own` is at least similar / 100."""
        if not len(own) or not len(self.shingles):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        at = at[self.shingles[at] == own]
        if 100 * len(at) < similar * len(own):  # too few shingles are in any lead
            return np.zeros(0, np.int64)
        size = self.at[at + 1] - self.at[at]
        places = np.repeat(self.at[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.bincount(self.lead[places], minlength=len(self.ids))
        return np.flatnonzero((common > 0) & (100 * common >= similar * (self.sizes + len(own) - common)))


def _confirm(similar: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, leads first: links members with leads of other labels. Links that others in the group imply are left out."""
        group, leads, held = None, None, ([], [], [])
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            a, b = [], []
            columns = [batch[c].to_pylist() for c in ("g", "block", "salt", "node", "label", "member")]
            for *key, node, label, member, blob in zip(*columns, batch["shingles"]):
                if key != group:
                    group, leads, held = key, None, ([], [], [])
                    above.clear()
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if not member:
                    for x, y in zip(held, (node, label, own)):
                        x.append(y)
                    continue
                if leads is None:
                    leads, held = _Leads(*held), ([], [], [])
                for k in leads.similar(own, similar).tolist():
                    x, y = top(label), top(int(leads.labels[k]))
                    if x != y:
                        above[x] = y
                        a.append(int(leads.ids[k]))
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def few(rows: DataFrame, count: int) -> DataFrame:
    """`rows` to join with: broadcast if their counted number is small, else joined by a shuffle."""
    return F.broadcast(rows) if count <= BROADCAST_IDS else rows


def _texts(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The rows of docs with these ids."""
    return docs.join(few(ids, count), F.col("doc_id") == F.col("node"), "left_semi")


def _links(docs: DataFrame, nodes: DataFrame, roles: DataFrame, similar: int) -> DataFrame:
    """Confirmed links (a, b) by roles (g, block, salt, node, label, member)."""
    roles = cut(roles.join(nodes.select("node", "k1", "k2"), "node"))
    count = roles.count()
    sets = _texts(docs, roles.select("node").distinct(), count).mapInArrow(_full_sets, "node long, k1 long, k2 long, shingles binary")
    dealt = sets.join(few(roles, count), ["node", "k1", "k2"]).select("g", "block", "salt", "node", "label", "member", "shingles")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["g", "block", "salt"]
    return dealt.repartition(parts, *order).sortWithinPartitions(*order, "member").mapInArrow(_confirm(similar), "a long, b long")


def _salt(node: str, salts: str) -> F.Column:
    return F.expr(f"cast(pmod(xxhash64({node}), {salts}) AS int)")


def _star_roles(pairs: DataFrame) -> DataFrame:
    """Each node's lead: pairs (a, b) make a group for each a, cut where it is large. Only the few large groups are joined back."""
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_STAR).cast("int").alias("salts")))
    large = sizes.filter("salts > 1")
    count = large.count()  # at most pairs / PER_STAR
    salts = F.coalesce("salts", F.lit(1))
    members = (pairs.join(few(large, count), "a", "left") if count else pairs.withColumn("salts", F.lit(1))).withColumn("salts", salts)
    members = members.select(F.col("a").alias("g"), F.lit(0).alias("block"), _salt("b", "salts").alias("salt"), F.col("b").alias("node"), F.col("b").alias("label"), F.lit(True).alias("member"))
    leads = sizes.select(F.col("a").alias("g"), F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.col("a").alias("label"), F.lit(False).alias("member"))
    return members.union(leads)


def _block_roles(left: DataFrame) -> DataFrame:
    """Groups for nodes (node, label, g): those outside the largest label of their g, in blocks, lead all nodes of the g."""
    sizes = left.groupBy("g", "label").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    # each salt holds copies of its block's leads: few of them allow small salts
    leads = F.least(F.col("all") - F.col("most"), F.lit(PER_BLOCK))
    together = F.least(F.lit(PER_SALT), F.greatest(F.lit(PER_STAR), 4 * leads))
    whole = whole.select("g", "main", F.ceil(F.col("all") / together).cast("int").alias("salts"), F.ceil((F.col("all") - F.col("most")) / PER_BLOCK).cast("int").alias("blocks")).filter("blocks > 0")
    both = left.join(whole, "g")
    members = both.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _salt("node", "salts").alias("salt"), "node", "label", F.lit(True).alias("member"))
    leads = both.filter("label <> main").select("g", _salt("node, 1", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", "label", F.lit(False).alias("member"))
    return members.union(leads)


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label, least) of buckets that hold two labels; least is the bucket's least node. Grouped sums find them, then they are joined back."""
    told = lambda rows: rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = cut(told(buckets).groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("least")).filter("lo < hi").select("bucket", "least"))
    return told(buckets.join(few(ends, ends.count()), "bucket")).select("bucket", "node", "label", "least")


def _rest(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, labels: DataFrame, similar: int) -> DataFrame | None:
    """Links among nodes of one bucket that no star has settled.

    A node of which more than a quarter of the shingles is in no other open node can't be similar to one and is left out;
    so documents that share a passage, but not most of their text, cost no comparison. The others are
    compared block by block within each connected group of buckets.
    """
    still = cut(_open(buckets, labels))
    ids = cut(still.select("node").distinct())
    count = ids.count()
    if not count:
        return None
    own = _texts(docs, ids, count).mapInArrow(_shingle_rows, "node long, k1 long, k2 long, shingle long")
    # a doc_id may stand on several texts: shingles are counted for each of them
    text = F.struct("node", "k1", "k2")
    single = own.groupBy("shingle").agg(F.count("*").alias("c"), F.min(text).alias("own")).filter("c = 1").groupBy("own.node", "own.k1", "own.k2").agg(F.count("*").alias("alone"))
    gone = single.join(nodes.select("node", "k1", "k2", "n"), ["node", "k1", "k2"]).filter(f"100 * (n - alone) < {similar} * n").select("node", "k1", "k2")
    # such an id goes if all its sets do
    left = nodes.join(few(ids, count), "node", "left_semi").select("node", "k1", "k2").join(gone, ["node", "k1", "k2"], "left_anti").select("node").distinct()
    left = cut(left)
    still = cut(_open(still.select("bucket", "node").join(few(left, left.count()), "node", "left_semi"), labels))
    near = connected_components(still.select(F.col("least").alias("a"), F.col("node").alias("b")))
    left = still.select("node", "label").distinct().join(near.withColumnRenamed("label", "g"), "node")
    return _links(docs, nodes, _block_roles(cut(left)), similar)


def _met(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, first) of nodes that share a whole table key with another; first is the bucket's least (node, n).

    Nodes are dealt by left half-key and spread over the right ones there. The few left half-keys that many nodes have are
    spread before the shuffle, and their buckets' least nodes come from grouped sums that are joined back.
    """
    bucket = F.xxhash64("l", "i", "r", "j").alias("bucket")
    halves = nodes.select("node", "n", F.posexplode("left").alias("i", "l"), "right")
    hot = cut(halves.groupBy("l", "i").agg(F.count("*").alias("c")).filter(F.col("c") > PER_KEY).select("l", "i"))
    count = hot.count()  # at most halves / PER_KEY
    cold = halves.join(few(hot, count), ["l", "i"], "left_anti") if count else halves
    tables = cold.repartition(F.col("l"), F.col("i")).select("node", "n", "i", "l", F.posexplode("right").alias("j", "r"))
    own = Window.partitionBy("l", "i", "r", "j")
    met = tables.withColumn("first", F.min(F.struct("node", "n")).over(own)).withColumn("size", F.count("*").over(own)).filter("size > 1").select(bucket, "node", "n", "first")
    if count:
        spread = halves.join(few(hot, count), ["l", "i"], "left_semi").select("node", "n", "i", "l", F.posexplode("right").alias("j", "r")).select(bucket, "node", "n")
        firsts = cut(spread.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).filter("size > 1").select("bucket", "first"))
        met = met.union(spread.join(few(firsts, firsts.count()), "bucket").select("bucket", "node", "n", "first"))
    return met


def near_duplicates(docs: DataFrame, halves: int = HALVES, similar: int = SIMILAR) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id, kept): the near-duplicate component of each.

    Takes any table with doc_id and text; other columns are ignored whatever their names.
    A null or blank text has no shingles and no link; below five words the whole sequence is one
    shingle. Texts with equal sets are linked. component_id is the smallest doc_id reachable and
    kept marks it. Rows that share a doc_id are one vertex. A row without doc_id is linked with
    nothing, has a null component_id and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(docs.mapInArrow(_sketches(halves), "doc_id long, n_shingles long, k1 long, k2 long, left array<long>, right array<long>"))
    real = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = cut(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("most"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")))
    members = real.select("doc_id", "k1", "k2").join(nodes.select("k1", "k2", "node", "most").filter("node < most"), ["k1", "k2"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    # one doc_id in two classes joins them
    shared = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top")
    links = shared.join(members, "doc_id").select("a", F.col("node").alias("b")).filter("a < b").distinct()

    buckets = cut(_met(nodes))
    pairs = buckets.filter(f"node <> first.node AND 100 * least(n, first.n) >= {similar} * greatest(n, first.n)").select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(links.union(_links(docs, nodes, _star_roles(cut(pairs)), similar)))
    labels = connected_components(links)
    rest = _rest(docs, nodes, buckets.select("bucket", "node"), labels, similar)
    if rest is not None:
        # of what is linked already, one edge for each node is enough
        labels = connected_components(rest.union(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
    found = members.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component")).filter("component < doc_id")
    found = found.groupBy("doc_id").agg(F.min("component").alias("component"))
    # only documents that hang on a smaller one are joined back
    out = sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
