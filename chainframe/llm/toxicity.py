"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows, near copies of one label (Jaccard 0.75 of their shingle sets) counted once, is indexed: a posting list for each term, cut into
blocks of examples, with the largest weight of each block. Every word of the examples is a term, but for stop words, those in more than a tenth of
all documents; document frequencies are counted over the whole corpus. A term's weight is its TF-IDF times its
relevance: a small constant plus the squared correlation, over the examples, of its presence with the label.
Plain TF-IDF, in which rare words outweigh telling ones, finds half of the toxic texts that this finds (see the README).

A document sums its heavy terms' block maxima, and what its other terms can add at most, into a bound for each block, reads the best blocks, and then
all blocks whose bound reaches its k-th best cosine, so the k best are exact. Cosine-weighted
votes of the neighbours are turned into a probability by a logistic fit on the
examples' own leave-one-out votes. The neighbours are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.labelled import examples, held_out
from chainframe.llm.near_dup import SIMILAR, shingle_sets
from chainframe.llm.text import NOT_ALNUM, Words, parts, slices, tidy

#: Labelled rows indexed at most, whatever the corpus; neighbours; examples in a block; blocks read first.
MAX_EXAMPLES, NEIGHBOURS, BLOCK, FIRST = 6_000, 15, 64, 6
#: Blocks are bounded one by one if so many terms can add all but this share of a cosine.
HEAVY, LIGHT = 24, 0.2
#: Share of documents from which a term is a stop word, relevance of a term that says nothing of the label, and what chance adds to it (times one over the examples).
STOP, PLAIN, CHANCE = 0.1, 0.01, 8
#: Score from which a document counts as toxic.
TOXIC = 0.5


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count), sorted by row and term; a term is the 64-bit hash of a word of lower-case letters, digits and non-ASCII characters."""
    words = Words(texts, NOT_ALNUM, lower=True)
    h = words.hashes()
    distinct, code = np.unique(h, return_inverse=True)
    key, count = np.unique(words.row * max(len(distinct), 1) + code, return_counts=True)
    return key // max(len(distinct), 1), distinct[key % max(len(distinct), 1)] if len(key) else h, count


def known_counts(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index among the sorted terms, count) of terms that are known."""
    row, term, count = term_counts(texts)
    at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
    seen = terms[at] == term if len(terms) else np.zeros(len(term), bool)
    return row[seen], at[seen], count[seen]


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`term_counts` of a long column, a slice at a time."""
    found, base = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        row, term, count = term_counts(part["text"])
        found.append((row + base, term, count))
        base += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*found))


def _first_copies(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Rows that no earlier kept row of the same label is near to, by their full shingle sets: near copies count once.

    Exact: two sets as similar as SIMILAR share one of the first shingles of each, rarest first, when all but so many are left out.
    """
    made = [shingle_sets(part["text"]) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in made)])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(o) for _, o in made)]))]).astype(np.int64)
    _, code, often = np.unique(hashes, return_inverse=True, return_counts=True)
    keep, holders = np.ones(len(texts), bool), {}
    for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own, n = code[a:z], z - a
        rare = own[np.lexsort((own, often[own]))][: n + (-SIMILAR * n // 100) + 1]
        met = [holders.setdefault((labels[r], k), []) for k in rare.tolist()]
        for e in {e for rows in met for e in rows}:
            other = code[offsets[e] : offsets[e + 1]]
            if 100 * min(n, len(other)) < SIMILAR * max(n, len(other)):
                continue
            common = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * common >= SIMILAR * (n + len(other) - common):
                keep[r] = False
                break
        else:
            for rows in met:
                rows.append(r)
    return keep


def relevance(row: np.ndarray, term: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """Of each term: PLAIN, and above what chance gives, its presence's squared correlation with the label over the examples."""
    n, positive = len(labels), labels.sum()
    df, a = np.bincount(term, minlength=terms).astype(float), np.bincount(term, labels[row], terms)
    spread = df * (n - df) * positive * (n - positive)
    phi = np.divide((a * n - df * positive) ** 2, spread, out=np.zeros(terms), where=spread > 0)
    return PLAIN + np.maximum(phi - CHANCE / max(n, 1), 0)


def _expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Postings of weighted unit vectors by term and block of examples, with block maxima. Terms are indices into the sorted array `terms`."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, row, term, count):
        self.terms, self.weights, self.ids, self.labels = terms, weights, ids, labels
        weight = self.weigh(row, term, count, len(ids))
        self.blocks = max(1, -(-len(ids) // BLOCK))
        order = np.lexsort((row, term))
        self.example, self.weight = row[order].astype(np.int32), weight[order]
        slot = term[order] * self.blocks + self.example // BLOCK
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        # entries: a term's postings within one block
        self.entry_at, self.entry_block = np.append(first, len(slot)), (slot[first] % self.blocks).astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.at = np.searchsorted(slot[first] // self.blocks, np.arange(len(terms) + 1))
        self.most = np.zeros(len(terms))
        np.maximum.at(self.most, term[order], self.weight)
        self.empty = np.setdiff1d(np.arange(len(ids)), row)
        self.slope, self.level, self.bare = 0.0, 0.0, 0.5

    def weigh(self, row, term, count, n) -> np.ndarray:
        w = (1 + np.log(count)) * self.weights[term]
        norm = np.sqrt(np.bincount(row, w * w, n))
        return w / np.maximum(norm[row], 1e-300)

    def _gathered(self, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each example's sum over ranges of postings."""
        posting = _expanded(start, size)
        return np.bincount(self.example[posting], np.repeat(weight, size) * self.weight[posting], len(self.ids))

    def _blockwise(self, term: np.ndarray, weight: np.ndarray, heavy: np.ndarray, light: float, k: int, skip: int) -> np.ndarray:
        """Cosines, exact for all examples that may be among the k best: blocks are read by falling bound."""
        many = self.at[term[heavy] + 1] - self.at[term[heavy]]
        entry = _expanded(self.at[term[heavy]], many)
        bound = np.bincount(self.entry_block[entry], np.repeat(weight[heavy], many) * self.entry_most[entry], self.blocks) + light
        many = self.at[term + 1] - self.at[term]
        entry, by = _expanded(self.at[term], many), np.repeat(weight, many)
        block, left = self.entry_block[entry], np.ones(self.blocks, bool)
        chosen, cosine = np.zeros(self.blocks, bool), np.zeros(len(self.ids))
        chosen[np.argsort(-bound, kind="stable")[:FIRST]] = True
        while chosen.any():
            own = np.flatnonzero(chosen[block])
            cosine += self._gathered(self.entry_at[entry[own]], self.entry_at[entry[own] + 1] - self.entry_at[entry[own]], by[own])
            if skip >= 0:
                cosine[skip] = 0
            left &= ~chosen
            least = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
            chosen = left & (bound >= least - 1e-12)  # sums are rounded
        return cosine

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples with a common term and their cosines, best first, equal ones by example.

        Few terms that can add most of a cosine bound the blocks, the others by one sum. Where no few terms can, bounds would spare no block and all postings are read.
        """
        reach = weight * self.most[term]
        order = np.argsort(-reach, kind="stable")
        upto = np.cumsum(reach[order])
        n = int(np.searchsorted(upto, (1 - LIGHT) * upto[-1])) + 1 if len(upto) else 0
        if n <= HEAVY:
            cosine = self._blockwise(term, weight, order[:n], float(upto[-1] - upto[n - 1]) if n else 0.0, k, skip)
        else:
            start = self.entry_at[self.at[term]]
            cosine = self._gathered(start, self.entry_at[self.at[term + 1]] - start, weight)
            if skip >= 0:
                cosine[skip] = 0
        hit = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k]) if len(cosine) > k else np.arange(len(cosine))
        best = hit[np.argsort(-cosine[hit], kind="stable")[:k]]
        best = best[cosine[best] > 0]
        return best, cosine[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Cosine-weighted share of label 1, drawn towards the share of all examples by the weight of one example."""
        prior = (self.labels.sum() + 1) / (len(self.labels) + 2)
        return float(((cosine * self.labels[best]).sum() + prior) / (cosine.sum() + 1))

    def calibrate(self, row, term, count, k: int) -> None:
        """A logistic map from votes to probabilities, by Newton steps with a small ridge."""
        weight, votes = self.weigh(row, term, count, len(self.ids)), np.zeros(len(self.ids))
        at = np.searchsorted(row, np.arange(len(self.ids) + 1))
        for r in range(len(self.ids)):
            a, z = at[r], at[r + 1]
            votes[r] = self.vote(*self.nearest(term[a:z], weight[a:z], k, r)) if z > a else np.nan
        seen = ~np.isnan(votes)
        bare = self.labels[self.empty]
        self.bare = float((bare.sum() + 1) / (len(bare) + 2)) if len(bare) else float((self.labels.sum() + 1) / (len(self.labels) + 2))
        x, y = votes[seen], self.labels[seen]
        beta = np.array([-2.0, 4.0])
        for _ in range(30):
            z = beta[0] + beta[1] * x
            p = 1 / (1 + np.exp(-z))
            design = np.stack([np.ones_like(x), x], 1)
            grad = design.T @ (p - y) + 0.05 * (beta - [-2.0, 4.0])
            hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
            beta = beta - np.linalg.solve(hess, grad)
        self.level, self.slope = beta

    def score(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(term):
            return self.bare, np.zeros(0, np.int64), np.zeros(0)
        best, cosine = self.nearest(term, weight, k)
        return float(1 / (1 + np.exp(-(self.level + self.slope * self.vote(best, cosine))))), best, cosine


def _frequencies(terms):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        df = np.zeros(len(known) + 1, np.int64)
        for part in parts(batches, "text"):
            df[-1] += part.num_rows
            df[:-1] += np.bincount(known_counts(part["text"], known)[1], minlength=len(known))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return frequencies


def build_index(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> BlockMaxIndex:
    """The index over a bounded sample of labelled rows, with document frequencies of the whole corpus."""
    table = examples(docs, labels, "toxic", max_examples)
    table = table.filter(pa.array(_first_copies(table["text"].combine_chunks(), table["label"].to_numpy())))
    y = table["label"].to_numpy().astype(np.float64)
    row, term, count = counted(table["text"].combine_chunks())
    terms, term = np.unique(term, return_inverse=True)
    ids, table = table["doc_id"].to_numpy(), None
    tidy()
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    counts = docs.select("text").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most one row for each term of the sample
    df = np.zeros(len(terms) + 1)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    keep = df[:-1] <= max(STOP * df[-1], 1)
    weights = (1 + np.log((df[-1] + 1) / (df[:-1] + 1))) * relevance(row, term, y, len(terms))
    place, own = np.cumsum(keep) - 1, keep[term]
    row, term, count = row[own], place[term[own]], count[own]
    index = BlockMaxIndex(terms[keep], weights[keep], ids, y, row, term, count)
    index.calibrate(row, term, count, k)
    return index


def _scored(shared, k: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in parts(batches, "text"):
            row, term, count = known_counts(part["text"], index.terms)
            weight = index.weigh(row, term, count, part.num_rows)
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            known, scores, evidence = {}, [], []
            for a, z in zip(at, at[1:]):
                key = (term[a:z].tobytes(), count[a:z].tobytes())
                if key not in known:
                    score, best, cosine = index.score(term[a:z], weight[a:z], k)
                    known[key] = score, [{"doc_id": int(index.ids[e]), "cosine": float(c), "toxic": int(index.labels[e])} for e, c in zip(best, cosine)]
                score, seen = known[key]
                scores.append(score)
                evidence.append(seen)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return scored


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """Per document (doc_id, held_out, score, predicted, evidence): evidence lists the neighbours that voted.

    A text without any indexed term (null and empty ones too, and such of stop words only) has no neighbours: its score is the label
    rate of the examples without terms, or of all if each has some. Equal texts get equal scores. Without labels every score is 0.5. Repeated rows each get their row; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels, max_examples, k))
    rows = docs.mapInArrow(_scored(index, k), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
