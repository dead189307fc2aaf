"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

It reads, for each leaf block, a hashed vector of the tag path above it, a hashed vector of its words and a few
measures, in page order from both ends, so each label depends on the whole page. It is
trained on pages from a generator of layouts (menus, headers, notices, sidebars, adverts, forms,
related links, reader comments, footers around and inside an article), since pages come without labels.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from chainframe.llm.html_blocks import Leaf, leaves
from chainframe.llm.text import Words

PATH, WORD, HIDDEN = 48, 24, 20
_MEASURES = 9
INPUT = PATH + WORD + _MEASURES


@lru_cache(maxsize=20_000)
def _path_vector(path: str) -> np.ndarray:
    """The sum of a fixed random sign vector for each name on the path; names near the leaf count more."""
    out = np.zeros(PATH, np.float32)
    names = path.split()
    for k, name in enumerate(names):
        digest = xxhash.xxh3_64_intdigest(name)
        out += (0.6 + 0.4 * (k + 1) / len(names)) * ((digest >> np.arange(PATH, dtype=np.uint64) & np.uint64(1)).astype(np.float32) * 2 - 1)
    return out / np.float32(np.sqrt(PATH) / 3)


def features(pages: list[list[Leaf]]) -> np.ndarray:
    """A row for each leaf of all pages."""
    flat = [x for page in pages for x in page]
    out = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return out
    words = Words(pa.array([x.text for x in flat]), lower=True)
    bucket = (words.hashes() % np.uint64(WORD)).astype(np.int64)
    count = np.bincount(words.row * WORD + bucket, minlength=len(flat) * WORD).reshape(-1, WORD)
    n_words = np.maximum(words.per_row, 1)
    out[:, PATH : PATH + WORD] = np.sqrt(count / n_words[:, None])
    out[:, :PATH] = [_path_vector(x.path) for x in flat]
    size = np.array([len(x.text) for x in flat])
    sizes = [len(page) for page in pages]
    at = np.concatenate([np.arange(n) / max(n - 1, 1) for n in sizes if n])
    out[:, PATH + WORD :] = np.stack([np.log1p(size) / 5, np.minimum(1, np.array([x.linked for x in flat]) / size), np.array([x.text[-1] in ".!?…。" for x in flat]), np.log1p(words.per_row) / 4, at, np.array([x.tag[:1] == "h" and x.tag[1:].isdigit() for x in flat]), np.array([x.tag == "li" for x in flat]), np.array([x.tag == "p" for x in flat]), np.array([min(x.depth, 20) for x in flat]) / 10], 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


class BlockLSTM:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def weights(a: int, b: int) -> np.ndarray:
            return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        self.p = {}
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = weights(INPUT, 4 * HIDDEN), weights(HIDDEN, 4 * HIDDEN)
            self.p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open
        self.p["o"], self.p["z"] = weights(2 * HIDDEN, 1), np.zeros(1, np.float32)

    @staticmethod
    def _lanes(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Pages in falling order of leaves; for each step, how many pages have that leaf."""
        sizes = np.array(sizes, np.int64)
        order = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), "left")
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return order, begin[order].astype(np.int64), live.tolist()

    def _run(self, x: np.ndarray, sizes: list[int], d: str, keep: bool):
        """Hidden states of all leaves in one direction, and what the way back needs."""
        order, begin, live = self._lanes(sizes)
        n = np.array(sizes, np.int64)[order]
        gates = x @ self.p["x" + d] + self.p["c" + d]
        out = np.zeros((len(x), HIDDEN), np.float32)
        h, c, steps = np.zeros((len(sizes), HIDDEN), np.float32), np.zeros((len(sizes), HIDDEN), np.float32), []
        for t, k in enumerate(live):
            at = begin[:k] + (t if d == "f" else n[:k] - 1 - t)
            g = gates[at] + h[:k] @ self.p["h" + d]
            i, f, o = (_sigmoid(g[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            if keep:
                steps.append((at, h[:k].copy(), c[:k].copy(), i, f, o, u))
            c[:k] = f * c[:k] + i * u
            h[:k] = o * np.tanh(c[:k])
            out[at] = h[:k]
        return out, steps

    def probabilities(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Of each leaf being main text."""
        both = np.concatenate([self._run(x, sizes, d, False)[0] for d in "fb"], 1)
        return _sigmoid(both @ self.p["o"] + self.p["z"])[:, 0]

    def gradients(self, x: np.ndarray, sizes: list[int], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, through time in both directions."""
        runs = {d: self._run(x, sizes, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 1)
        error = ((_sigmoid(both @ self.p["o"] + self.p["z"])[:, 0] - y) / len(y))[:, None].astype(np.float32)
        out = {"o": both.T @ error, "z": error.sum(0)}
        back = error @ self.p["o"].T
        for k, d in enumerate("fb"):
            own = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            dgates = np.zeros((len(x), 4 * HIDDEN), np.float32)
            dw = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((len(sizes), HIDDEN), np.float32), np.zeros((len(sizes), HIDDEN), np.float32)
            for at, h, c, i, f, o, u in reversed(runs[d][1]):
                n = len(at)
                t = np.tanh(f * c + i * u)
                now = dh[:n] + own[at]
                cell = dc[:n] + now * o * (1 - t * t)
                g = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), now * t * o * (1 - o), cell * i * (1 - u * u)], 1)
                dgates[at] = g
                dw += h.T @ g
                dh[:n], dc[:n] = g @ self.p["h" + d].T, cell * f
            out["x" + d], out["h" + d], out["c" + d] = x.T @ dgates, dw, dgates.sum(0)
        return out

    def fit(self, x: np.ndarray, sizes: list[int], y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.015, seed: int = 5) -> BlockLSTM:
        rng, begin = np.random.default_rng(seed), np.concatenate([[0], np.cumsum(sizes)])
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        total = epochs * -(-len(sizes) // batch)
        for _ in range(epochs):
            order = np.argsort(np.array(sizes) + 4 * rng.random(len(sizes)))  # pages of like lengths side by side
            for a in rng.permutation(-(-len(order) // batch)) * batch:
                part = order[a : a + batch]
                at = np.concatenate([np.arange(begin[p], begin[p + 1]) for p in part])
                step += 1
                for k, g in self.gradients(x[at], [sizes[p] for p in part], y[at]).items():
                    g = g.clip(-1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self


_PAGE_WORDS = {
    "nav": "home about contact news archive products services login register search help menu shop blog careers",
    "header": "the daily journal official site welcome logo tagline your source for sign in",
    "notice": "we use cookies accept privacy policy by continuing you agree important notice alert subscribe now close dismiss update",
    "sidebar": "popular recent posts categories tags follow us trending most read archives links widget",
    "ad": "advertisement sponsored buy now save offer deal discount free shipping limited click here promotion",
    "form": "email address name password submit sign up newsletter your message send required search",
    "related": "related you may also like read more next previous recommended stories share tweet",
    "comments": "said reply comment great post thanks agree disagree report like posted ago user comments leave",
    "footer": "copyright all rights reserved terms of use privacy contact sitemap powered by company",
    "meta": "by author published updated on min read filed under posted in views",
}
_CLASSES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav site-nav",
    "header": "header masthead site-header top branding banner logo page-header topbar",
    "notice": "cookie notice cookie-banner alert consent gdpr announcement message popup modal",
    "sidebar": "sidebar aside widget side rail secondary col-right sidebar-left",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense ad-slot",
    "form": "form newsletter signup subscribe search-form contact-form login",
    "related": "related related-posts more share social sharing recommended pager pagination",
    "comments": "comments comment comment-list reader-comments discussion disqus responses replies",
    "footer": "footer site-footer bottom copyright colophon foot legal",
    "meta": "meta byline author date post-meta entry-meta tags",
}
_TAGS = {"nav": "nav div ul", "header": "header div", "notice": "div section aside", "sidebar": "aside div section", "ad": "div aside section ins", "form": "form div section", "related": "div section nav aside", "comments": "section div ol", "footer": "footer div", "meta": "div p header"}
_BODY = "article content post entry main main-content story article-body post-content entry-content text body"


def _page(rng: np.random.Generator) -> str:
    """A random page; each block's text begins with \\x01 if it is main text and \\x02 if not."""
    syllables = [chr(97 + a) + "aeiou"[b] + "nrstl"[c] for a, b, c in rng.integers(0, (26, 5, 5), (40, 3))]
    plain = rng.random() < 0.15  # class names say nothing
    style = rng.random()  # of pages, some are in capitals, and some have marks or bars after their words
    marks = ["!!", "%%%", "***", "$$$", "###", "&&&", " |", ","][rng.integers(8)] if rng.random() < 0.3 else ""

    def words(n: int, kind: str = "") -> str:
        own = _PAGE_WORDS[kind].split() if kind and rng.random() < 0.7 else []
        out = [own[rng.integers(len(own))] if own and rng.random() < 0.6 else "".join(syllables[k] for k in rng.integers(0, 40, rng.integers(1, 4))) for _ in range(n)]
        if rng.random() < 0.03:
            out = [out[0]] * n
        if marks and rng.random() < 0.5:
            out = [x + marks for x in out]
        text = " ".join(out)
        return text.upper() if style < 0.1 else text

    def pick(text: str) -> str:
        options = text.split()
        return options[rng.integers(len(options))]

    def named(kind: str) -> str:
        if rng.random() < 0.25:
            return ""
        name = words(1) if plain else pick(_CLASSES.get(kind, _BODY))
        return f' {pick("class class class id")}="{name}"'

    def sentence(low: int, high: int) -> str:
        return words(int(rng.integers(low, high))).capitalize() + "."

    def link(kind: str) -> str:
        return f'<a href="#">{words(int(rng.integers(1, 5)), kind)}</a>'

    def box(kind: str) -> str:
        tag, name = pick(_TAGS[kind]), named(kind)
        if tag == "div" and not name and not plain and rng.random() < 0.8:
            name = f' class="{pick(_CLASSES[kind])}"'
        if kind in ("nav", "related", "sidebar") and rng.random() < 0.75:
            items = "".join(f"<li>\x02{link(kind)}</li>" for _ in range(rng.integers(2, 9)))
            head = f"<h3>\x02{words(2, kind)}</h3>" if kind != "nav" and rng.random() < 0.6 else ""
            inner = head + (items if tag in ("ul", "ol") else f"<ul>{items}</ul>")
        elif kind == "form":
            inner = "".join(f"<p>\x02{words(int(rng.integers(1, 5)), kind)} <input></p>" for _ in range(rng.integers(1, 4)))
        elif kind == "comments":
            inner = (f"<h3>\x02{words(2, kind)}</h3>" if rng.random() < 0.7 else "") + "".join(f"<{t}{named(kind)}><p>\x02{words(2, kind)}</p><p>\x02{sentence(3, 40)}</p></{t}>" for t in ["li" if tag == "ol" else "div"] * int(rng.integers(1, 7)))
        else:
            inner = " ".join(f"<{t}>\x02{link(kind) if rng.random() < 0.3 else words(int(rng.integers(1, 18)), kind)}{'.' if rng.random() < 0.5 else ''}</{t}>" for t in [pick("p div p")] * int(rng.integers(1, 4)))
            if rng.random() < 0.5:
                inner = "\x02" + words(int(rng.integers(1, 20)), kind) + pick(". . &copy;")
        return f"<{tag}{name}>{inner}</{tag}>"

    def maybe(kind: str, chance: float) -> str:
        return box(kind) if rng.random() < chance else ""

    parts = [f"<h1>\x01{words(int(rng.integers(1, 14)))}{pick('. ! ? ,') if rng.random() < 0.4 else ''}</h1>"] if rng.random() < 0.85 else []
    parts.append(maybe("meta", 0.2))
    prose = 0.72 if rng.random() < 0.6 else 1  # many articles are paragraphs only
    for _ in range(rng.integers(1, 14) if rng.random() < 0.8 else rng.integers(14, 60)):
        kind = rng.random()
        if kind < prose:
            close = "" if rng.random() < 0.1 else "</p>"
            parts.append(f"<p>\x01{'<b>' if rng.random() < 0.1 else ''}{sentence(1, 4) if rng.random() < 0.3 else ' '.join(sentence(1, 25) for _ in range(rng.integers(1, 7)))}{link('nav') if rng.random() < 0.1 else ''}{'<br>' if rng.random() < 0.1 else ''}{close}")
        elif kind < 0.8:
            parts.append(f"<h{rng.integers(2, 5)}>\x01{words(int(rng.integers(1, 8)))}</h2>")
        elif kind < 0.87:
            parts.append("<ul>" + "".join(f"<li>\x01{words(int(rng.integers(1, 16)))}</li>" for _ in range(rng.integers(1, 7))) + "</ul>")
        elif kind < 0.91:
            parts.append(f"<blockquote>\x01{sentence(4, 30)}</blockquote>")
        elif kind < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>\x01{words(2)}</td><td>\x01{words(1)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
        else:
            parts.append(box(pick("ad ad related form notice")))
    inner = "".join(parts)
    tag = pick("article article main div div section")
    body = f"<{tag}{named('body') if tag != 'div' else ' class=' + chr(34) + (words(1) if plain else pick(_BODY)) + chr(34)}>{inner}</{tag}>"
    if rng.random() < 0.3:
        body = f'<div class="{pick("wrapper container page row layout")}">{body}{maybe("sidebar", 0.4)}</div>'
    return f"<html><body>{maybe('notice', 0.25)}{maybe('header', 0.5)}{maybe('nav', 0.8)}{maybe('ad', 0.5)}{maybe('sidebar', 0.2)}{body}{maybe('ad', 0.2)}{maybe('related', 0.3)}{maybe('sidebar', 0.3)}{maybe('form', 0.2)}{maybe('comments', 0.35)}{maybe('footer', 0.85)}</body></html>"


def training_pages(n: int, seed: int) -> tuple[list[list[Leaf]], np.ndarray]:
    """n generated pages as leaves, and each leaf's label."""
    rng, pages, y = np.random.default_rng(seed), [], []
    while len(pages) < n:
        page = leaves(_page(rng))
        for leaf in page:
            y.append(leaf.text.startswith("\x01") or "\x01" in leaf.text)
            leaf.text = " ".join(leaf.text.replace("\x01", "").replace("\x02", "").split()) or "."
        pages.append(page)
    return pages, np.array(y, np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = 1500, epochs: int = 8, seed: int = 11) -> BlockLSTM:
    """The labeller trained on generated pages: the same weights at every call and for every corpus."""
    made, y = training_pages(pages, seed)
    return BlockLSTM().fit(features(made), [len(p) for p in made], y, epochs)
