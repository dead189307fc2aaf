"""Quality classifier: supervised subword embeddings.

Each word, each 3 to 5 character n-gram of it (with word ends) and each pair of neighbouring words has a learned vector in a
hashed table. A document is the mean of its words' and n-grams' vectors averaged with that of its pairs' vectors, a
softmax layer gives its class, and everything is trained by numpy mini-batch gradient descent (Adagrad step sizes) on the driver over
a bounded sample, of which only counts and each distinct word's features are held. All pairs of a word with
itself share one slot, since a mean of single words can't tell a text that repeats itself. As the output is
linear in the means, a trained model scores with one number for each feature, the vector's product with the class
difference; each distinct word of a slice is looked up once, and a long text is summed up piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.labelled import examples, held_out
from chainframe.llm.text import WHITE, Words, chain, grams, mix, parts, pieces, slices

#: Labelled rows learnt from at most, whatever the corpus (their words are held on the driver).
MAX_EXAMPLES = 2_500
#: Text bytes whose features are made at once: they take about a hundred times as many.
BATCH_BYTES = 256 << 10
#: Score from which a document is good.
ACCEPT = 0.3
_NGRAMS = (3, 4, 5)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes."""
    ends = np.cumsum(counts)
    upto = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, 0, dtype=np.float64)])
    return upto[ends] - upto[ends - counts]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of consecutive ranges, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def word_features(distinct: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each word, one word after another, how many each has (itself and its n-grams), and the words' own hashes."""
    shift = np.uint64(64 - bits)
    joined = np.frombuffer(("\n" + "".join(w.decode() + "\n" for w in distinct)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    is_end = joined == 10
    word_of = np.cumsum(is_end) - 1
    ids, owner = [], []
    inner = np.concatenate([[0], np.cumsum(is_end)])
    for n in _NGRAMS:
        g = grams(mix(joined + np.uint64(1)), n)
        at = np.flatnonzero(inner[n - 1 : n - 1 + len(g)] == inner[1 : 1 + len(g)])  # word ends only at the gram's ends
        ids.append((mix(g[at] + np.uint64(n)) >> shift).astype(np.int32))
        owner.append(word_of[at + 1] - is_end[at + 1])
    # a word's own hash: a position-weighted sum of its characters, mixed
    whole = np.zeros(len(distinct), np.uint64)
    if distinct:
        pos = np.arange(len(joined)) - np.flatnonzero(is_end)[word_of]
        body = np.flatnonzero(~is_end)
        np.add.at(whole, word_of[body], mix(joined[body] * np.uint64(0x9E3779B97F4A7C15) + pos[body].astype(np.uint64)))
    whole = mix(whole + np.uint64(77))
    ids.append((whole >> shift).astype(np.int32))
    owner.append(np.arange(len(distinct)))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(distinct)), whole


def pair_features(h: np.ndarray, last: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of neighbouring words, given the words' hashes, and at which words the pairs begin."""
    pair = mix(chain(h[:-1], h[1:]))
    pair[h[:-1] == h[1:]] = np.uint64(0xABCDEF0123456789)
    at = np.flatnonzero(np.arange(len(pair)) + 1 < last[: len(pair)])
    return (pair[at] >> np.uint64(64 - bits)).astype(np.int32), at


def _grouped(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct codes, how often each stands there, and how many a row has."""
    width = int(code.max()) + 1 if len(code) else 1
    key, often = np.unique(row * width + code, return_counts=True)
    return (key % width).astype(np.int32), often.astype(np.float32), np.bincount(key // width, minlength=rows)


class Sample:
    """The labelled texts as counts: for each row its distinct words and pairs with how often each stands there, and each word's features."""

    def __init__(self, texts: pa.Array, bits: int):
        known: dict[bytes, int] = {}
        made, words_of, pairs_of = [], [], []
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", BATCH_BYTES):
            words = Words(part["text"])
            codes, distinct = words.codes()
            new = [w for w in distinct if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            feature, many, h = word_features(distinct, bits)
            fresh = np.fromiter((known[w] >= len(known) - len(new) for w in distinct), bool, len(distinct))
            made.append((feature[np.repeat(fresh, many)], many[fresh]))
            of = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
            row = words.row
            words_of.append(_grouped(row, of[codes] if len(distinct) else codes, part.num_rows))
            pair, at = pair_features(h[codes] if len(distinct) else np.zeros(0, np.uint64), words.last, bits)
            pairs_of.append(_grouped(row[at], pair.astype(np.int64), part.num_rows))
        self.words, self.pairs = ([np.concatenate(x) for x in zip(*y)] if y else [np.zeros(0, np.int64)] * 3 for y in (words_of, pairs_of))
        self.feature, self.features = (np.concatenate(x) for x in zip(*made)) if made else [np.zeros(0, np.int64)] * 2
        self.feature_at = np.cumsum(self.features) - self.features
        self.word_at, self.pair_at = (np.cumsum(x[2]) - x[2] for x in (self.words, self.pairs))

    def rows(self, rows: np.ndarray):
        """Of some rows: distinct words with their features, then (row, word, share) and (row, pair's feature, share) of the rows' means."""
        size = self.words[2][rows]
        at = _ranges(self.word_at[rows], size)
        word, row = self.words[0][at], np.repeat(np.arange(len(rows)), size)
        times = self.words[1][at]
        total = np.bincount(row, times * self.features[word], len(rows))
        distinct, word = np.unique(word, return_inverse=True)
        size = self.pairs[2][rows]
        at = _ranges(self.pair_at[rows], size)
        pair, pair_row, often = self.pairs[0][at], np.repeat(np.arange(len(rows)), size), self.pairs[1][at]
        all_pairs = np.bincount(pair_row, often, len(rows))
        return self.feature[_ranges(self.feature_at[distinct], self.features[distinct])], self.features[distinct], (row, word, (times / (2 * total[row])).astype(np.float32)), (pair_row, pair, (often / (2 * all_pairs[pair_row])).astype(np.float32))


def _spread(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by index from 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(values[order], first)
    return out


class SubwordModel:
    def __init__(self, bits: int = 17, dim: int = 16, epochs: int = 4, batch: int = 32, rate: float = 0.5, seed: int = 7):
        self.bits, self.dim, self.epochs, self.batch, self.rate, self.seed = bits, dim, epochs, batch, rate, seed
        self.gain, self.bias = np.zeros(1 << bits, np.float32), 0.0

    def fit(self, texts: pa.Array, labels: np.ndarray) -> SubwordModel:
        """Learns from the rows; without both labels the score is the smoothed label rate."""
        labels = np.asarray(labels, np.int64)
        n = len(labels)
        self.bias = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
        if n == 0 or labels.min() == labels.max():
            return self
        sample, rng = Sample(texts, self.bits), np.random.default_rng(self.seed)
        table = rng.uniform(-1 / self.dim, 1 / self.dim, (1 << self.bits, self.dim)).astype(np.float32)
        out, bias = np.zeros((self.dim, 2), np.float32), np.array([0, self.bias], np.float32)
        seen, seen_out, seen_bias = np.full(len(table), 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        groups = np.array_split(rng.permutation(n), max(1, n // self.batch))
        for epoch in range(self.epochs):
            step = self.rate * (1 - epoch / self.epochs)
            for k in rng.permutation(len(groups)):
                y = labels[groups[k]]
                feature, many, (row, word, share), (pair_row, pair, pair_share) = sample.rows(groups[k])
                first = np.cumsum(many) - many
                vector = np.add.reduceat(table[feature], first) if len(many) else np.zeros((0, self.dim), np.float32)
                mean = _spread(row, vector[word] * share[:, None], len(y)) + _spread(pair_row, table[pair] * pair_share[:, None], len(y))
                z = mean @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                back = p @ out.T
                of_word = _spread(word, back[row] * share[:, None], len(many))
                every = np.concatenate([feature, pair])
                order = np.argsort(every)
                every = every[order]
                first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                distinct = every[first]
                grad = np.add.reduceat(np.concatenate([np.repeat(of_word, many, 0), back[pair_row] * pair_share[:, None]])[order], first)
                g_out, g_bias = mean.T @ p, p.sum(0)
                seen[distinct] += (grad**2).mean(1)
                seen_out += g_out**2
                seen_bias += g_bias**2
                table[distinct] -= step * grad / np.sqrt(seen[distinct])[:, None]
                out -= step * g_out / np.sqrt(seen_out)
                bias -= step * g_bias / np.sqrt(seen_bias)
        self.gain, self.bias = table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])
        return self

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Of each row: the sum of its words' and n-grams' numbers, how many these are, the same of its pairs, and its first and last words' hashes."""
        words = Words(texts)
        codes, distinct = words.codes()
        feature, many, h = word_features(distinct, self.bits)
        word, h = _sums(self.gain[feature], many), h[codes]
        pair, at = pair_features(h, words.last, self.bits)
        pairs = np.bincount(words.row[at], minlength=len(texts))
        full = words.per_row > 0
        ends = np.zeros((2, len(texts)), np.uint64)
        ends[0, full], ends[1, full] = h[words.first[:-1][full]], h[words.first[1:][full] - 1]
        return _sums(word[codes], words.per_row), _sums(many[codes].astype(np.float64), words.per_row), _sums(self.gain[pair], pairs), pairs, ends

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each row; a text above BATCH_BYTES is summed up in pieces."""
        if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > BATCH_BYTES:
            total, before = np.zeros((4, 1)), None
            for piece in pieces(texts[0].as_py().encode(), WHITE, BATCH_BYTES):
                *own, ends = self.sums(pa.array([piece.decode()]))
                if own[1][0]:
                    if before is not None:  # the pair across the cut
                        total[2:, 0] += self.gain[pair_features(np.array([before, ends[0, 0]]), np.array([2, 2]), self.bits)[0]].sum(), 1
                    before = ends[1, 0]
                total += np.stack(own)
            total = list(total)
        else:
            total = self.sums(texts)
        z = total[0] / np.maximum(2 * total[1], 1) + total[2] / np.maximum(2 * total[3], 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """As `score`, a slice at a time; long texts alone."""
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", BATCH_BYTES):
            length = pc.fill_null(pc.binary_length(part["text"]), 0).to_numpy()
            cuts = np.unique(np.concatenate([[0, len(length)], *((k, k + 1) for k in np.flatnonzero(length > BATCH_BYTES))])).astype(int)
            out += [self.score(part["text"].slice(a, z - a)) for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> SubwordModel:
    """A model of labels.quality from a bounded sample of the rows that aren't held out."""
    table = examples(docs, labels, "quality", max_examples)
    return SubwordModel().fit(table["text"].combine_chunks(), table["label"].to_numpy())


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.value.scores(part["text"]))], ["doc_id", "score"])

    return scored


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Per document (doc_id, held_out, score, predicted). Only the text is read by the score.

    Null and empty texts have no features and get the model's bias as score. Equal texts get equal scores. Without labels the
    score is 0.5. Repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_examples))
    rows = docs.mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _good(model, place: int, accept: float):
    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            keep = [model.value.scores(part["text"]) >= accept for part in parts(iter([texts]), "text")]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return good


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, whose score is at least `accept`; see `quality_scores` for nulls, ties and repeated rows.

    Rejected rows go where they are read, so they are not sent back.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_examples))
    return docs.mapInArrow(_good(model, docs.columns.index("text"), accept), docs.schema)
