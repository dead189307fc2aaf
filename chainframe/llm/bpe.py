"""Byte-level BPE token counts by finite-state transducers.

Two deterministic transducers read a text. The first reads character classes and emits pre-token starts. It has a
dozen states, so the maps that single classes make on its states generate a small monoid:
every chunk of text is one element of it, chunk maps compose by table look-up in a parallel
prefix scan, and then all characters get their entry states at once. The second reads the
bytes of a pre-token; each transition carries the change in the number of emitted tokens.
Its states are found as they are met and kept: a state holds what the next byte can depend
on, namely the longest tail that begins some token, and for each place in the tail the last
token of the encoding that ends there with its count. (The encoding of a prefix stays an
encoding when a token compatible with its last one follows, and two tokens are compatible
if merging their joint bytes gives them back.) Each distinct pre-token runs once, all side by side.
A long pre-token is cut into chunks that run side by side too: each chunk's map, from entry states to exit states with
token counts, is made for the entry states that the chunk before can leave it in, and the maps
are composed by a parallel prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from chainframe.llm.text import text_buffer, tidy

# Character classes of the pre-token pattern, and the letters of its contractions: 's 't 'm 'd 're 've 'll
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, BREAK, ONE, R, V, L, E = range(12)
_CLASSES = 12
# States: after a break; in a run of letters, numbers or others; a quote that may contract; a whole contraction;
# a quote with r, v or l; one white character (blank or not); several (the last a blank or not).
START, IN_L, IN_N, IN_O, AT_Q, DONE, Q_R, Q_V, Q_L, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(13)
_STATES = 13
# Outputs: a pre-token starts at this character, at the one before, or at both.
_HERE, _BEFORE = 1, 2


def _transition(state: int, c: int) -> tuple[int, int]:
    """(next state, output)."""
    letter = c in (LETTER, ONE, R, V, L, E)
    run = {NUMBER: IN_N, OTHER: IN_O, QUOTE: AT_Q}.get(c, IN_L)  # where a run of c begins
    white = {SPACE: ONE_SPACE, WHITE: ONE_WHITE}.get(c)
    if c == BREAK:
        return START, _HERE | (_BEFORE if state in (Q_R, Q_V, Q_L) else 0)
    if state in (Q_R, Q_V, Q_L):
        if (state, c) in ((Q_R, E), (Q_V, E), (Q_L, L)):
            return DONE, 0
        return (IN_L, _BEFORE) if letter else (white or run, _BEFORE | _HERE)
    if state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        if white:
            return {SPACE: SPACES, WHITE: WHITES}[c], 0
        blank = state in (ONE_SPACE, SPACES)  # a blank joins the run that follows
        out = (_BEFORE if state in (SPACES, WHITES) else 0) | (0 if blank else _HERE)
        return (IN_O if blank and c == QUOTE else run), out
    if white:
        return white, _HERE
    if state == AT_Q:
        if c == ONE:
            return DONE, 0
        if c in (R, V, L):
            return {R: Q_R, V: Q_V, L: Q_L}[c], 0
        return (IN_O, 0) if c in (OTHER, QUOTE) else (run, _HERE)
    if (state, run) in ((IN_L, IN_L), (IN_N, IN_N), (IN_O, IN_O)) or state == IN_O and c == QUOTE:
        return state, 0
    return run, _HERE


class Scanner:
    """The pre-token transducer with its monoid of state maps."""

    CHUNK = 64

    def __init__(self, splitter):
        """splitter: the library's pre-tokenizer, asked only about characters newer than this Python's tables."""
        table = [[_transition(s, c) for c in range(_CLASSES)] for s in range(_STATES)]
        self.out = np.array([[x[1] for x in row] for row in table], np.uint8)
        letters = [tuple(table[s][c][0] for s in range(_STATES)) for c in range(_CLASSES)]
        one = tuple(range(_STATES))
        found, maps = {one: 0}, [one]
        at = 0
        while at < len(maps):  # closed under one more character
            for c in letters:
                m = tuple(c[s] for s in maps[at])
                if m not in found:
                    found[m] = len(maps)
                    maps.append(m)
            at += 1
        self.act = np.array(maps, np.uint8)
        self.then = np.array([[found[tuple(c[s] for s in m)] for c in letters] for m in maps], np.int32)
        self.join = np.array([[found[tuple(b[s] for s in a)] for b in maps] for a in maps], np.int32)
        self.classes = np.full(0x110000, OTHER, np.uint8)
        newer = []  # characters that Unicode versions differ on: the library decides
        every = [*range(0xD800), *range(0xE000, 0x110000)]
        text = "".join(map(chr, every))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            for m in regex.finditer(f"{pattern}+", text):
                self.classes[every[m.start() : m.end()]] = kind
        self.classes[0x1C:0x20] = OTHER  # white in Python, not in the pattern
        for code in np.flatnonzero(self.classes != OTHER).tolist():
            if unicodedata.category(chr(code)) == "Cn":
                newer.append(code)
        for code in newer:
            c = chr(code)
            alone = [len(splitter.pre_tokenize_str(x + c + x)) == 1 for x in "a1"]
            self.classes[code] = LETTER if alone[0] else NUMBER if alone[1] else OTHER
        for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
            for x in chars:
                self.classes[ord(x)] = kind

    def classify(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte at which each character starts, and its class."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kind = self.classes[lead]
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            b0, p = lead[wide].astype(np.int64), at[wide]
            last = len(data) - 1
            b1, b2, b3 = (data[np.minimum(p + k, last)].astype(np.int64) & 0x3F for k in (1, 2, 3))
            code = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
            kind[wide] = self.classes[np.minimum(code, 0x10FFFF)]
        return at, kind

    def starts(self, kind: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character, by composing the maps of chunks."""
        n = len(kind)
        chunks = -(-n // self.CHUNK)
        padded = np.full(chunks * self.CHUNK, BREAK, np.uint8)
        padded[:n] = kind
        cols = np.ascontiguousarray(padded.reshape(chunks, self.CHUNK).T)
        within = np.empty((self.CHUNK + 1, chunks), np.int32)  # the map of each chunk's first characters
        within[0] = 0
        for k in range(self.CHUNK):
            within[k + 1] = self.then[within[k], cols[k]]
        total = within[-1].copy()
        step = 1
        while step < chunks:  # parallel prefix: maps of all chunks so far
            total[step:] = self.join[total[:-step], total[step:]]
            step *= 2
        entry = np.full(chunks, START, np.uint8)
        entry[1:] = self.act[total[:-1], START]
        out = self.out[self.act[within[:-1], entry[None, :]], cols].T.reshape(-1)
        starts = (out & _HERE) > 0
        starts[:-1] |= (out[1:] & _BEFORE) > 0
        return starts[:n]


class Pretokens:
    """The pre-tokens of a column: a code for each, the distinct ones as bytes, and rows' ranges (`first`, one more than rows).

    Strings of the special token stand as the code -1."""

    def __init__(self, scanner: Scanner, column: pa.Array, special: bytes):
        data, offsets = text_buffer(column)
        breaks = offsets[:-1]
        raw = data.tobytes()
        cuts, found = [], raw.find(special)
        while found >= 0:
            row = np.searchsorted(offsets, found, "right")
            if found + len(special) <= offsets[row]:
                cuts.append(found)
                found = raw.find(special, found + len(special))
            else:
                found = raw.find(special, found + 1)
        # a break before each row and at both ends of each special string; the string's own pieces are dropped
        cuts = np.array(cuts, np.int64)
        at, kind = scanner.classify(data)
        marks = np.sort(np.concatenate([breaks, cuts, cuts + len(special), offsets[-1:]]))
        where = np.searchsorted(at, marks)
        with_breaks = np.insert(kind, where, BREAK)
        is_break = np.insert(np.zeros(len(kind), bool), where, True)
        begins = at[scanner.starts(with_breaks)[~is_break]]
        if len(cuts):
            begins = np.union1d(begins, cuts)
            inside = np.searchsorted(cuts, begins, "right") - 1
            begins = begins[(inside < 0) | (begins == cuts[inside]) | (begins >= cuts[inside] + len(special))]
        self.first = np.searchsorted(begins, offsets)
        bounds = np.append(begins, len(data)).astype(np.int64)
        if len(begins):
            pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            coded = pieces.dictionary_encode()
            self.codes, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        else:
            self.codes, self.distinct = np.zeros(0, np.int64), []
        if len(cuts):
            self.codes[np.searchsorted(begins, cuts)] = -1


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], int], bytes]:
    """Token bytes, merge ranks by pair of ids, and the special token's string, from a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others are shifted
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    special = file["added_tokens"][0]["content"]
    ids = {bytes(byte_of[c] for c in token): k for token, k in file["model"]["vocab"].items() if token != special}
    ranks = {}
    for rank, merge in enumerate(file["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        ranks[ids[bytes(byte_of[c] for c in a)], ids[bytes(byte_of[c] for c in b)]] = rank
    return ids, ranks, special.encode()


class CountTransducer:
    """Counts the tokens of pre-tokens; transitions are compiled when first taken. A table of more than `most` states is begun anew with those in use."""

    #: Bytes from which a pre-token is cut into chunks, chunks of one pre-token at most, bytes before a chunk that tell its likely entry state, and lanes that run together.
    CHUNK, CHUNKS, WARM, LANES = 256, 2_048, 48, 4_096
    START = (b"", ((-1, 0),))

    def __init__(self, path: str, most: int = 120_000):
        self.ids, self.ranks, self.special = vocabulary(path)
        self.bytes = {k: b for b, k in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.heads = {b[:k] for b in self.ids for k in range(1, len(b))}
        self.fits: dict[int, bool] = {}
        self.most = max(most, 3 * self.LANES)
        # a column for each byte met, in order; 255 stands for none
        self.column, self.byte_of = np.full(256, 255, np.uint8), []
        self._begin([])

    def _begin(self, keep: list[tuple]) -> None:
        self.states, self.number = [], {}
        self._room(1024, self._width())
        for state in (self.START, *keep):
            self._number(state)

    def _room(self, states: int, bytes_: int) -> None:
        """Tables of at least so many rows and columns, with what is compiled so far unless there is nothing."""
        new = np.full((states, bytes_), -1, np.int32), np.zeros((states, bytes_), np.int8)
        if self.states:
            rows, columns = min(len(self.next), states), min(self.next.shape[1], bytes_)
            for old, to in zip((self.next, self.delta), new):
                to[:rows, :columns] = old[:rows, :columns]
        self.next, self.delta = new

    def _width(self) -> int:
        return max(32, -(-len(self.byte_of) // 32) * 32)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The bytes as columns of the tables, which get new ones for bytes not met before."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)[:256] * (self.column == 255)).tolist():
            if len(self.byte_of) < 255:
                self.column[b] = len(self.byte_of)
                self.byte_of.append(b)
        if len(self.byte_of) > self.next.shape[1]:
            self._room(len(self.next), self._width())
        return self.column[data]

    def _number(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.next):
                self._room(len(self.next) * 3 // 2, self.next.shape[1])
        return self.number[state]

    def _merged(self, data: bytes) -> list[int]:
        tokens = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(tokens) > 1:
            best = min(range(len(tokens) - 1), key=lambda k: self.ranks.get((tokens[k], tokens[k + 1]), 1 << 60))
            if (tokens[best], tokens[best + 1]) not in self.ranks:
                break
            tokens[best : best + 2] = [self.ids[self.bytes[tokens[best]] + self.bytes[tokens[best + 1]]]]
        return tokens

    def _fit(self, last: int, token: int) -> bool:
        key = last << 32 | token
        if key not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            both = [token] if last < 0 else [last, token]
            self.fits[key] = self._merged(b"".join(self.bytes[t] for t in both)) == both
        return self.fits[key]

    def _compile(self, state: int, column: int) -> None:
        tail, places = self.states[state]
        tail += bytes((self.byte_of[column],))
        ids, fits, heads, n = self.ids, self.fits, self.heads, len(tail)
        for size in range(min(n, self.longest), 0, -1):
            token = ids.get(tail[n - size :])
            if token is not None and (place := places[size - 1]) is not None:
                fit = fits.get(place[0] << 32 | token)
                if self._fit(place[0], token) if fit is None else fit:
                    break
        delta = places[size - 1][1] + 1
        # only places from which some token may still go on matter
        kept = []
        for k in range(min(n, self.longest - 1), 0, -1):
            if tail[n - k :] in heads:
                last, count = places[k - 1]
                kept.append((last, count - delta))
            elif kept:
                kept.append(None)
        keep = len(kept)
        new = (tail[n - keep :], ((token, 0), *kept[::-1]))
        self.next[state, column], self.delta[state, column] = self._number(new), delta

    def _run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, entry: list[tuple] | None) -> tuple[np.ndarray, list[tuple]]:
        """Counts, and exit states where entry states are given (else all begin at the start): at most LANES lanes, the longest first, one byte a step."""
        order = np.argsort(-size, kind="stable")
        at = at[order]
        live = np.searchsorted(-size[order], -np.arange(size.max() if len(size) else 0), "left")  # lanes that have byte k
        first = [self.START] if entry is None else [entry[k] for k in order.tolist()]
        if entry is not None and len(self.states) + len(first) > self.most:
            self._begin([])
        state, total = np.resize(np.array([self._number(x) for x in first], np.int64), len(size)), np.zeros(len(size), np.int64)
        for k, n in enumerate(live.tolist()):
            now, byte = state[:n], data[at[:n] + k]
            to = self.next[now, byte]
            if (new := np.flatnonzero(to < 0)).size:
                pairs = np.unique(now[new] << 8 | byte[new]).tolist()
                if len(self.states) + len(pairs) > self.most:  # only the lanes' states go on
                    used, where = np.unique(state, return_inverse=True)
                    kept = [self.states[x] for x in used.tolist()]
                    self._begin(kept)
                    state = np.array([self.number[x] for x in kept], np.int64)[where]
                    now = state[:n]
                    missing = self.next[now, byte] < 0
                    pairs = np.unique(now[missing] << 8 | byte[missing]).tolist()
                for x in pairs:
                    self._compile(x >> 8, x & 255)
                to = self.next[now, byte]
            total[:n] += self.delta[now, byte]
            state[:n] = to
        counts = np.empty(len(size), np.int64)
        counts[order] = total
        if entry is None:
            return counts, []
        left = np.empty(len(size), np.int64)
        left[order] = state
        return counts, [self.states[x] for x in left.tolist()]

    def _long(self, data: np.ndarray, begin: int, size: int) -> int:
        """One pre-token by chunks."""
        step = max(self.CHUNK, -(-size // self.CHUNKS))
        at = begin + np.arange(0, size, step)
        sizes = np.minimum(step, begin + size - at)
        # entry states by chunk, each with its exit state and count; a chunk's first is a guess from the bytes before it
        warm = np.minimum(self.WARM, at - begin)
        guesses = [self.START, *self._run(data, (at - warm)[1:], warm[1:], [self.START] * (len(at) - 1))[1]]
        maps: list[dict[tuple, tuple[tuple, int]]] = [{} for _ in guesses]
        todo = list(enumerate(guesses))
        while todo:
            new = []
            for k in range(0, len(todo), self.LANES):
                own = todo[k : k + self.LANES]
                which = np.array([c for c, _ in own])
                counts, exits = self._run(data, at[which], sizes[which], [x for _, x in own])
                for (c, x), out, count in zip(own, exits, counts.tolist()):
                    maps[c][x] = out, count
                    if c + 1 < len(maps):
                        new.append((c + 1, out))
            todo = [(c, x) for c, x in dict.fromkeys(new) if x not in maps[c]]
        width = max(map(len, maps))
        number = [{x: k for k, x in enumerate(m)} for m in maps]
        exit_, count = np.zeros((len(maps), width), np.int64), np.zeros((len(maps), width), np.int64)
        for c, m in enumerate(maps):
            for k, (out, n) in enumerate(m.values()):
                exit_[c, k], count[c, k] = number[c + 1][out] if c + 1 < len(maps) else 0, n
        step = 1
        while step < len(maps):  # parallel prefix: maps of all chunks so far
            via = exit_[:-step].copy()
            count[step:] = count[:-step] + np.take_along_axis(count[step:], via, 1)
            exit_[step:] = np.take_along_axis(exit_[step:], via, 1)
            step *= 2
        return int(count[-1, 0])

    def counts(self, distinct: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        data, at, out = self._columns(np.frombuffer(b"".join(distinct), np.uint8)), np.cumsum(size) - size, np.empty(len(distinct), np.int64)
        short = np.flatnonzero(size <= self.CHUNK)
        short = short[np.argsort(size[short], kind="stable")]
        for k in range(0, len(short), self.LANES):
            own = short[k : k + self.LANES]
            out[own] = self._run(data, at[own], size[own], None)[0]
        for k in np.flatnonzero(size > self.CHUNK).tolist():
            out[k] = self._long(data, int(at[k]), int(size[k]))
        return out


class Remembered:
    """What was found for byte strings, in two generations of bounded size: when the new one is full it becomes the old one."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old, self.size = limit, {}, {}, 0

    def of(self, keys: list[bytes], find) -> list:
        """The values of distinct keys; find(keys) gives those not known."""
        new, old, missing, size = self.new, self.old, [], 0
        for x in keys:
            if x not in new:
                if x in old:
                    new[x] = old[x]
                    size += len(x) + 200
                else:
                    missing.append(x)
        found = find(missing)
        new.update(zip(missing, found))
        out = [new[x] for x in keys]
        self.size += size + sum(map(len, missing)) + 200 * len(missing)
        if self.size > self.limit:
            self.old, self.new, self.size = new, {}, 0
        return out


@lru_cache(maxsize=1)
def compiled(path: str) -> tuple[Scanner, CountTransducer, Remembered]:
    """The transducers for a file and the counts remembered so far; kept between the tasks of a worker."""
    found = Scanner(Tokenizer.from_file(path).pre_tokenizer), CountTransducer(path), Remembered(32 << 20)
    tidy()
    return found


@lru_cache(maxsize=1)
def library(path: str) -> tuple[Scanner, Tokenizer, bytes, Remembered]:
    """The scanner, the tokenizers library for a file, its special string, and the ids remembered so far."""
    tokenizer = Tokenizer.from_file(path)
    found = Scanner(tokenizer.pre_tokenizer), tokenizer, vocabulary(path)[2], Remembered(32 << 20)
    tidy()
    return found


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after another, and row offsets: the library tokenizes each distinct pre-token once."""
    scanner, tokenizer, special, known = library(path)
    pre = Pretokens(scanner, column, special)

    def encoded(new: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for k in range(0, len(new), 10_000) for e in tokenizer.encode_batch_fast([x.decode() for x in new[k : k + 10_000]], add_special_tokens=False)]

    found = known.of(pre.distinct, encoded) + [array("I", [tokenizer.token_to_id(special.decode())]).tobytes()]  # the last for code -1
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
    codes = np.where(pre.codes < 0, len(found) - 1, pre.codes)
    ends = np.concatenate([[0], np.cumsum(size[codes])])
    ids = flat[np.repeat(at[codes] - ends[:-1], size[codes]) + np.arange(ends[-1])]
    return ids, ends[pre.first]
