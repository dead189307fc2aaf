"""Secrets in texts: patterns of fixed form, and what a linear-chain conditional random field tags beside them.

Tokens are runs of letters and digits, and single other characters. A token's scores as beginning, inside or outside of a secret are
sums of learnt weights of its shape, its word, the words around it and features of the whole text; Viterbi decoding finds the best tags of
the whole sequence. Only stretches that can hold a secret at all are decoded: the gain of tagging any stretch at best
is a sum over its tokens, so the best stretch around each token comes from running sums, and where it is no gain the token is outside in the best sequence.
Tokens of a pattern's match are held to be a secret when decoding.

There are no labelled secrets to learn from, so the field is trained, by numpy, on generated lines: values of many
forms where a secret stands, and the same and similar ones where none does. The weights are the same for every corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.text import LOWER, mix, parts, text_buffer

KINDS = ("assign", "access", "hex")
_PATTERNS = (
    re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]{16,}"),
)
#: Rows without these have no match.
_HINTS = ("(?i)password|passwd|secret|token|api_?key", "AKIA[A-Z0-9]", "[0-9a-f]{16}")

#: Tags, and what may not follow: inside after outside.
O, B, I = range(3)
NEVER = -1e4
#: Sizes of the feature tables: hashed words, prefixes, and other kinds of a token seen from its neighbours.
WORDS, PREFIXES, FORMS = 4_096, 512, 64
#: Neighbours whose kinds count.
AROUND = (-5, -4, -3, -2, -1, 1, 2)
_P = np.uint64(0x9E3779B97F4A7C15)
_KIND = 256 + WORDS + FORMS
_SIZES = {"length": 16, "mix": 64, "turns": 64, "digits": 64, "hex": 16, "kind": _KIND, "prefix": PREFIXES} | {f"at{k}": _KIND for k in AROUND} | {"glue": 16, "punct": 8, "share": 8, "lines": 8}
_OFFSETS = dict(zip(_SIZES, np.concatenate([[0], np.cumsum(list(_SIZES.values()))]).tolist()))
FEATURES = sum(_SIZES.values())


def _classes() -> np.ndarray:
    out = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and non-ASCII, 2 others
    out[[0x20, *range(9, 14)]] = 0
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return out


_CLASS = _classes()
_DIGIT = np.isin(np.arange(256), range(48, 58))
_UPPER = np.isin(np.arange(256), range(65, 91))
_SMALL = np.isin(np.arange(256), range(97, 123))
_HEX = _DIGIT | np.isin(np.arange(256), range(97, 103))
_FORM = np.where(_DIGIT, 1, np.where(_UPPER, 2, np.where(_SMALL, 3, 4)))


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, modulo 2^64, and their inverses, for 2^n bytes."""
    return tuple(np.cumprod(np.concatenate([[1], np.full(1 << n, p, np.uint64)]).astype(np.uint64), dtype=np.uint64) for p in (int(_P), pow(int(_P), -1, 1 << 64)))


class Tokens:
    """The tokens of texts: byte ranges, first token of each row (one more than rows), and a feature of each kind, as an index of the weights."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _CLASS[data]
        run = kind == 1
        begins, ends = kind == 2, kind == 2
        begins, ends = begins | run, ends | run
        begins[1:] &= ~(run[1:] & run[:-1])
        ends[:-1] &= ~(run[:-1] & run[1:])
        full = offsets[1:] > offsets[:-1]
        begins[offsets[:-1][full]] = kind[offsets[:-1][full]] > 0
        ends[offsets[1:][full] - 1] = kind[offsets[1:][full] - 1] > 0
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data, self.offsets = data, offsets
        self.joined = np.zeros(len(self.start) + 1, bool)  # to the token before, of the same row
        if len(self.start) > 1:
            self.joined[1:-1] = (self.start[1:] == self.end[:-1]) & (self.row[1:] == self.row[:-1])

    def __len__(self) -> int:
        return len(self.start)

    def features(self) -> np.ndarray:
        """(kinds of feature, tokens)."""
        data, start, end, n = self.data, self.start, self.end, len(self)
        up_to = lambda flags: np.concatenate([np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)])
        within = lambda sums: sums[end] - sums[start]
        size = end - start
        digits, capitals, small = (within(up_to(x[data])) for x in (_DIGIT, _UPPER, _SMALL))
        foreign = size - digits - capitals - small
        form = _FORM[data]
        turned = up_to(np.append(form[1:] != form[:-1], False) if len(form) else form)
        turns = turned[np.maximum(end - 1, start)] - turned[start]
        hexed = within(up_to(_HEX[data])) == size
        other = (size == 1) & (_CLASS[data[start]] == 2)
        scale = np.minimum(np.log2(size + 1) * 2, 15).astype(np.int64)  # 1, 2, 3-4, ... to 180 bytes
        mixed = (digits > 0) + 2 * (capitals > 0) + 4 * (small > 0) + 8 * (foreign > 0)
        coarse = np.minimum(scale // 3, 3)
        share = np.minimum(digits * 8 // size, 7)
        power, back = _powers(max(20, len(data).bit_length()))
        sums = np.concatenate([[0], np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)]).astype(np.uint64)
        word = mix((sums[end] - sums[start]) * back[start])
        head = mix((sums[np.minimum(start + 4, end)] - sums[start]) * back[start])
        plain = (digits == 0) & (size <= 14)
        kind = np.where(other, data[start], np.where(plain, 256 + (word % np.uint64(WORDS)).astype(np.int64), 256 + WORDS + coarse * 16 + mixed)).astype(np.int64)
        own = {"length": scale, "mix": mixed * 4 + coarse, "turns": np.minimum(np.log2(turns + 1) * 3, 15).astype(np.int64) * 4 + coarse, "digits": share * 4 + coarse, "hex": hexed * 8 + np.minimum(scale // 2, 7), "kind": kind, "prefix": (head % np.uint64(PREFIXES)).astype(np.int64)}
        for k in AROUND:
            at = np.arange(n) + k
            there = (at >= 0) & (at < n)
            at = np.clip(at, 0, max(n - 1, 0))
            own[f"at{k}"] = np.where(there & (self.row[at] == self.row), kind[at], 0)
        own["glue"] = self.joined[:-1] + 2 * self.joined[1:] + 4 * other
        rows = len(self.offsets) - 1
        of_row = lambda x: np.bincount(self.row, x, rows)
        tokens = np.maximum(np.diff(self.first), 1)
        lines = np.diff(up_to(data == 10)[self.offsets]) + 1
        own["punct"] = np.minimum(of_row(other) * 8 / tokens, 7).astype(np.int64)[self.row]
        own["share"] = np.minimum(of_row(digits > 0) * 8 / tokens, 7).astype(np.int64)[self.row]
        own["lines"] = np.minimum(np.log2(tokens / lines + 1), 7).astype(np.int64)[self.row]
        return np.stack([own[name] + _OFFSETS[name] for name in _SIZES])


# ---- the field


class Field:
    """Weights of features and of steps between tags."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.pairs = np.ascontiguousarray(weights[:, 1:] - weights[:, :1], np.float32).view(np.complex64)[:, 0]

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(tokens, tags)."""
        total = np.zeros(features.shape[1], np.complex64)  # begin and inside, both less outside, in one look-up
        for x in features:
            total += self.pairs[x]
        return np.stack([np.zeros(len(total)), total.real, total.imag], 1)

    def _stretches(self, scores: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches, each within a row, outside of which all tags are O in a best sequence."""
        a = self.steps
        inner = max(a[B, B], a[B, I], a[I, B], a[I, I]) - a[O, O]
        gain = scores[:, 1:].max(1) - scores[:, O] + inner
        edge = a[O, B] + max(a[B, O], a[I, O]) - a[O, O] - inner  # entry and exit, of which one step is counted in the first token
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        left = np.minimum.accumulate(sums[:-1])
        right = np.maximum.accumulate(sums[:0:-1])[::-1]
        maybe = np.flatnonzero(right - left + edge > -1e-6)
        if not len(maybe):
            return maybe, maybe
        new = np.ones(len(maybe), bool)
        new[1:] = (np.diff(maybe) > 1) | (row[maybe[1:]] != row[maybe[:-1]])
        first = np.flatnonzero(new)
        return maybe[first], np.append(maybe[first[1:] - 1], maybe[-1]) + 1

    def tags(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best tags of all rows' sequences, by Viterbi decoding of all stretches side by side, the longest first."""
        out = np.zeros(len(scores), np.int8)
        start, end = self._stretches(scores, row)
        order = np.argsort(start - end, kind="stable")
        start, size = start[order], (end - start)[order]
        if not len(start):
            return out
        best, back = self.steps[O] + scores[start], []
        for k in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -k, "left"))  # stretches of more than k tokens
            ways = best[:live, :, None] + self.steps
            back.append(ways.argmax(1).astype(np.int8))
            best[:live] = ways.max(1) + scores[start[:live] + k]
        tag = (best + self.steps[:, O]).argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -k, "left")) if k else len(size)
            out[start[:live] + k] = tag[:live]
            if k:
                tag[:live] = back[k - 1][np.arange(live), tag[:live]]
        return out


# ---- lines to learn from

_KEYS = ["password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "pass", "passphrase", "auth", "credential", "client_secret", "access_key", "private_key", "secret key", "auth token", "bearer", "session", "db_pass", "Password", "SECRET_KEY", "API_KEY", "authorization", "signature_key", "encryption_key", "contraseña", "passwort", "mot de passe", "clave"]
_OTHER = ["commit", "sha", "id", "uuid", "md5", "checksum", "build", "version", "color", "path", "ref", "serial", "number", "order", "phone", "card", "isbn", "hash", "digest", "etag", "name", "count", "address", "date", "code", "tokens", "key", "url", "page", "total", "size"]


def _values(rng: random.Random) -> str:
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = small + small.upper() + digits
    form = rng.randrange(8)
    if form == 0:
        return pick("0123456789abcdef", rng.choice([16, 24, 32, 40, 64]))
    if form == 1:
        return pick(every, rng.randint(16, 44))
    if form == 2:
        return pick(every + "+/", rng.randint(20, 60)) + rng.choice(["", "=", "=="])
    if form == 3:
        return rng.choice(["ghp_", "sk_live_", "xoxb-", "AKIA", "glpat-"]) + pick(every, rng.randint(16, 36))
    if form == 4:
        return ".".join(pick(every + "_-", rng.randint(12, 30)) for _ in range(3))
    if form == 5:
        return pick(small, rng.randint(3, 6)).capitalize() + pick(digits, rng.randint(2, 4)) + rng.choice("!#$%&*@") + pick(every, rng.randint(2, 6))
    if form == 6:
        return pick(small, 4) + pick(digits, 3) + pick(every, rng.randint(5, 9))
    return "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))


def _line(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text, and where in it secrets stand."""
    syllables = rng.choice([["the", "an", "er", "ing", "tion", "re", "ou", "st"], ["de", "la", "ción", "es", "que", "ado"], ["ein", "ung", "keit", "und", "sch", "ö"], ["é", "ment", "eux", "ou", "tre"], ["na", "mi", "ko", "ra", "xi", "lo"]])
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text, spans = "", []

    def prose(n: int) -> None:
        nonlocal text
        for _ in range(n):
            text += word() + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", " | "])

    prose(rng.randint(0, 12))
    for _ in range(rng.randint(0, 2)):
        quote = rng.choice(["", "", '"', "'", "`"])
        sep = rng.choice(["=", " = ", ": ", ":", " := ", " => ", '": ', "': "])
        form = rng.randrange(14)
        if form < 4:
            text += rng.choice(["", "export ", "set ", '"', "my ", "MY_", "- "]) + rng.choice(_KEYS) + sep + quote
            at = len(text)
            text += _values(rng)
            spans.append((at, len(text)))
            text += quote + rng.choice(["", ";", ",", "\n"])
        elif form == 4:
            text += rng.choice(["Authorization: Bearer ", "authorization: Basic ", "--password ", "password is ", "the secret key is ", "curl -u admin:"])
            at = len(text)
            text += _values(rng)
            spans.append((at, len(text)))
        elif form == 5:
            text += rng.choice(["postgres", "mysql", "https", "amqp", "redis"]) + f"://{word().lower()}:"
            at = len(text)
            text += _values(rng).replace("@", "").replace("/", "")
            spans.append((at, len(text)))
            text += f"@{word()}.com:5432/db"
        elif form < 9:  # the same values where no secret stands
            text += rng.choice(_OTHER) + rng.choice([sep, " ", "/"]) + quote + (_values(rng) if rng.random() < 0.7 else str(rng.randrange(10 ** rng.randint(1, 16)))) + quote
        elif form == 9:  # the words without a value
            text += rng.choice(_KEYS) + rng.choice([" must be ", " is ", ": ", " = ", " and ", "s of ", ", "]) + word() + " " + word()
        elif form == 10:
            text += rng.choice([f"https://{word()}.org/{word()}/{rng.randrange(10**6)}?id={_values(rng)}", f"{word()}.{word()}@{word()}.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"({rng.randrange(900)}) 555-{rng.randrange(10**4):04}", f"{rng.randrange(10**16):016}", f"2024-0{rng.randint(1, 9)}-1{rng.randrange(10)}T10:{rng.randint(10, 59)}", f"data:image/png;base64,{_values(rng)}{_values(rng)}"])
        elif form == 11:  # words over and over, words with signs between
            again = word().capitalize()
            text += rng.choice([f"{again} ", f"{again}. "]) * rng.randint(3, 30) if rng.random() < 0.5 else "".join(rng.choice([word(), word().capitalize()]) + rng.choice([",", ".", "", ""]) + rng.choice(["***", "###", "$$$", "%%%", "&&&", "==", "---"]) + " " for _ in range(rng.randint(3, 20)))
        else:
            text += rng.choice([word().upper() + "_" + word().upper(), word() + word().capitalize() + "()", f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", "x" * rng.randint(8, 40), word() * 4, _values(rng)])
        text += " "
        prose(rng.randint(0, 8))
    return text, spans


def _examples(lines: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (kinds, tokens), tags and rows of generated texts."""
    rng = random.Random(seed)
    made = [_line(rng) for _ in range(lines)]
    raw = [x[0].encode() for x in made]
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    tags = np.zeros(len(tokens), np.int64)
    for row, (text, spans) in enumerate(made):
        for a, b in spans:
            a, b = (tokens.offsets[row] + len(text[:x].encode()) for x in (a, b))
            inside = np.arange(*np.searchsorted(tokens.start, (a, b)))
            tags[inside] = I
            tags[inside[:1]] = B
    return tokens.features(), tags, tokens.row


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def expectations(scores: np.ndarray, steps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences (sequence, place, tag), each from O and back to O: log partition sums, chances of each tag and summed chances of each step."""
    n, most, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = steps[O] + scores[:, 0]
    for k in range(1, most):
        ahead[:, k] = _log_sum(ahead[:, k - 1, :, None] + steps, 1) + scores[:, k]
    behind[np.arange(n), size - 1] = steps[:, O]
    for k in range(most - 2, -1, -1):
        behind[:, k] = np.where((k < size - 1)[:, None], _log_sum(steps + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], 2), behind[:, k])
    total = _log_sum(ahead[np.arange(n), size - 1] + steps[:, O], 1)
    here = np.arange(most) < size[:, None]
    chance = np.where(here[:, :, None], np.exp(np.minimum(ahead + behind - total[:, None, None], 0)), 0)
    both = np.exp(np.minimum(ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - total[:, None, None, None], 0))
    step = (both * here[:, 1:, None, None]).sum((0, 1))
    step[O] += chance[:, 0].sum(0)
    step[:, O] += chance[np.arange(n), size - 1].sum(0)
    return total, chance, step


@lru_cache(1)
def trained(lines: int = 4_000, epochs: int = 8, batch: int = 250, rate: float = 0.25, decay: float = 1e-4, seed: int = 0) -> Field:
    """The field trained on generated lines by stochastic gradient steps (AdaGrad) on the log likelihood."""
    features, tags, row = _examples(lines, seed)
    first = np.searchsorted(row, np.arange(lines + 1))
    weights, steps = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    steps[O, I] = NEVER
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    order, rng = np.flatnonzero(np.diff(first)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            size = np.diff(first)[rows]
            place = np.minimum(np.arange(size.max()), size[:, None] - 1)
            token = first[rows][:, None] + place
            here = np.arange(size.max()) < size[:, None]
            ids = features[:, token]
            scores = weights[ids].sum(0)
            _, chance, step = expectations(scores, steps, size)
            truth = np.eye(3)[tags[token]] * here[:, :, None]
            gap = truth - chance
            grad = np.stack([np.bincount(ids.ravel(), np.broadcast_to(gap[:, :, t], ids.shape).ravel(), FEATURES) for t in range(3)], 1) / len(rows) - decay * weights
            known = np.zeros((3, 3))
            path = np.concatenate([np.zeros((len(rows), 1), np.int64), np.where(here, tags[token], O)], 1)
            np.add.at(known, (path[:, :-1][here], path[:, 1:][here]), 1)
            np.add.at(known, (tags[token][np.arange(len(rows)), size - 1], O), 1)
            grad_s = (known - step) / len(rows)
            grad_s[O, I] = 0
            seen_w += grad**2
            seen_s += grad_s**2
            weights += rate * grad / np.sqrt(seen_w)
            steps += rate * grad_s / np.sqrt(seen_s)
    return Field(weights, steps)


# ---- scanning


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' matches, by start, then kind."""
    out = []
    for kind, pattern in enumerate(_PATTERNS):
        for m in pattern.finditer(text):
            a, b = m.span()
            at = m.start(1) if kind == 0 else a
            if b - at >= (12, 18, 16)[kind]:
                out.append((a, kind, b, at))
    return sorted(out)


def _scan(field):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = field.value
        for part in parts(batches, "text"):
            data, offsets = text_buffer(part["text"])
            tokens = Tokens(data, offsets)
            scores = known.scores(tokens.features()) if len(tokens) else np.zeros((0, 3))
            scores[~tokens.joined[:-1], I] += NEVER  # a secret has no gaps
            hint = np.zeros(part.num_rows, bool)
            for pattern in _HINTS:
                hint |= pc.fill_null(pc.match_substring_regex(part["text"], pattern), False).to_numpy(zero_copy_only=False)
            begins = (data & 0xC0) != 0x80
            point = np.concatenate([[0], np.cumsum(begins)])  # code points before each byte
            base: dict[int, list] = {}
            for row in np.flatnonzero(hint).tolist():
                spans = base_spans(part["text"][row].as_py())
                if not spans:
                    continue
                base[row] = spans
                place = np.append(np.flatnonzero(begins[offsets[row] : offsets[row + 1]]), offsets[row + 1] - offsets[row]) + offsets[row]
                for _, _, b, at in spans:  # held to be secrets
                    inside = np.arange(np.searchsorted(tokens.start, place[at]), np.searchsorted(tokens.end, place[b], "right"))
                    scores[inside, I] += 1e3
                    scores[inside[:1], B] += 2e3
            tag = known.tags(scores, tokens.row)
            on = np.flatnonzero(tag == B)
            ends = np.flatnonzero((tag != O) & (np.append(tag[1:], O) != I))
            row = tokens.row[on]
            a, b = point[tokens.start[on]] - point[offsets[row]], point[tokens.end[ends]] - point[offsets[row]]
            more: dict[int, list] = {}
            for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
                if all(y <= s[0] or x >= s[2] for s in base.get(r, ())):
                    more.setdefault(r, []).append((x, len(KINDS), y))
            counts, sha, spans = np.zeros((3, part.num_rows), np.int64), [_NOTHING] * part.num_rows, [""] * part.num_rows
            for r in sorted(base.keys() | more.keys()):
                mine = [s[:3] for s in base.get(r, ())]
                for _, kind, _ in mine:
                    counts[kind, r] += 1
                write = lambda found: ",".join(f"{(*KINDS, 'crf')[kind]}:{x}:{y}" for x, kind, y in found)
                sha[r] = hashlib.sha256(write(mine).encode()).hexdigest()
                spans[r] = write(sorted(mine + more.get(r, [])))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan


_NOTHING = hashlib.sha256(b"").hexdigest()


def secret_spans(docs: DataFrame, lines: int = 4_000, seed: int = 0) -> DataFrame:
    """Per document (doc_id, n_assign, n_access, n_hex, base_sha256, spans): matches of the patterns, their digest, and all spans.

    Spans are kind:start:end in code points, the end not included, by start, then kind (assign, access, hex, crf). A span of the field, crf, never meets a
    pattern's match. A null text is empty and has no span; repeated rows and equal texts fare alike; texts of any length are read whole. An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained(lines, seed=seed))  # some MB, whatever the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
