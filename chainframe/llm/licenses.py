"""License scans: MinHash bands over overlapping windows find templates, shingle containment confirms them.

Documents and templates are sequences of 5-word shingles of lower-case words. A template of up to B shingles
(B = 4, 16, 64, ...) is sought in windows of two blocks of B shingles, one block apart, so each run
of B + 1 shingles lies in one window. A band is one minhash: a window meets a template in
one of 64 bands with probability 1 - (1 - J)^64, and as a window holding 75 % of a template of its class has
J >= 0.097, that is at least 0.998. A candidate counts only if some run of B + 1 shingles of
the document holds at least 75 % of the template's shingles, counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.license_texts import TEMPLATES
from chainframe.llm.text import NOT_ALNUM, Words, grams, parts

SHINGLE, CONTAINED, BANDS, CLASS_STEP = 5, 75, 64, 4
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = 16

#: Templates are broadcast: so many characters of text at most.
MOST_CHARACTERS = 32 << 20


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all places (those that cross rows are 0), each row's first place, and its number of places."""
    words = Words(column, NOT_ALNUM, lower=True)
    h = grams(words.hashes(), SHINGLE)
    if len(h):
        h = np.where(np.arange(len(h)) + SHINGLE <= words.last[: len(h)], h, np.uint64(0))
    return h, words.first[:-1], np.maximum(words.per_row - SHINGLE + 1, 0)


def _permuted(h: np.ndarray, times: np.uint64, plus: np.uint64) -> np.ndarray:
    x = h * times + plus
    return np.where(h == 0, _LAST, x ^ (x >> np.uint64(31)))


def _blocks(values: np.ndarray, size: int) -> np.ndarray:
    """Minima of consecutive blocks."""
    short = -len(values) % size
    if short:
        values = np.concatenate([values, np.full(short, _LAST)])
    return values.reshape(-1, size).min(1)


class TemplateIndex:
    """Templates by size class, with their minhashes in each band."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        h, first, count = _shingles(pa.array([text for _, text in templates], pa.string()))
        if not all(count):
            raise ValueError("a template needs five words")
        self.sets = [np.unique(h[a : a + n]) for a, n in zip(first.tolist(), count.tolist())]
        seeds = np.random.default_rng(97).integers(1, 1 << 63, (BANDS, 2), dtype=np.uint64)
        self.seeds = [(t | np.uint64(1), p) for t, p in seeds]
        self.size = []
        for n in count.tolist():
            size = CLASS_STEP
            while size < n:
                size *= CLASS_STEP
            self.size.append(size)
        self.classes = {}
        for size in sorted(set(self.size)):
            own = [k for k, x in enumerate(self.size) if x == size]
            bands = []
            for t, p in self.seeds:
                least = np.array([_permuted(self.sets[k], t, p).min() for k in own])
                bits = np.zeros(1 << _BITS, bool)
                bits[(least & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
                bands.append((bits, {int(x): [own[j] for j in np.flatnonzero(least == x)] for x in least}))
            self.classes[size] = bands

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first place, end) of windows that meet a template in some band."""
        out = set()
        for band, (t, p) in enumerate(self.seeds):
            least, at = _permuted(h, t, p), 1
            for size, bands in self.classes.items():
                least, at = _blocks(least, size // at), size
                bits, found = bands[band]
                two = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                for w in np.flatnonzero(bits[(two & np.uint64((1 << _BITS) - 1)).astype(np.int64)]).tolist():
                    for k in found.get(int(two[w]), ()):
                        out.add((k, w * size, (w + 2) * size))
        return out

    def contained(self, k: int, h: np.ndarray, low: int, high: int) -> tuple[float, int, int]:
        """The largest share of template k in a run of its class' size plus one among places low to high, and where (first and last place)."""
        at = np.flatnonzero(np.isin(h[low:high], self.sets[k])) + low
        best, where, span = 0, (0, 0), self.size[k] + 1
        j, inside = 0, {}
        for i, z in enumerate(at.tolist()):
            inside[int(h[z])] = inside.get(int(h[z]), 0) + 1
            while z - at[j] >= span:
                gone = int(h[at[j]])
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                j += 1
            if len(inside) > best:
                best, where = len(inside), (int(at[j]), z)
        return best / len(self.sets[k]), *where


def _scanned(index, contained: int):
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = index.value
        for part in parts(batches, "text"):
            h, first, count = _shingles(part["text"])
            found: dict[int, dict] = {}
            if len(h):
                seen = set()
                for k, a, z in templates.candidates(h):
                    for r in range(max(int(np.searchsorted(first, a, "right")) - 1, 0), int(np.searchsorted(first, z, "left"))):
                        seen.add((r, k))
                for r, k in seen:
                    a, n = int(first[r]), int(count[r])
                    share, begin, end = templates.contained(k, h, a, a + n)
                    if 100 * share >= contained:
                        found.setdefault(r, {})[templates.names[k]] = {"license": templates.names[k], "containment": share, "first_word": begin - a, "last_word": end - a + SHINGLE - 1}
            rows = [[found[r][x] for x in sorted(found[r])] if r in found else [] for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], ["doc_id", "matches"])

    return scanned


def license_matches(docs: DataFrame, templates=TEMPLATES, contained: int = CONTAINED) -> DataFrame:
    """Per document (doc_id, matches): the templates found, by name, with containment and word range (of lower-case alphanumeric words).

    Null texts and texts below five words match nothing. Templates, a list of (name, text) or a table with these columns, are broadcast; they may have
    MOST_CHARACTERS characters, and a null name or text, or one below five words, is an error. Repeated rows
    each get their row; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
    """
    if isinstance(templates, DataFrame):
        if (templates.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_CHARACTERS:
            raise ValueError("too many templates to broadcast")
        templates = sorted((r["name"], r["text"]) for r in templates.select("name", "text").distinct().collect())
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned(index, contained), "doc_id long, matches array<struct<license:string,containment:double,first_word:long,last_word:long>>")


def license_report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document (doc_id, n_licenses, licenses, containment): names joined by commas, and the largest containment (0 without a match)."""
    rows = license_matches(docs, templates)
    return rows.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.concat_ws(",", "matches.license").alias("licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"))
