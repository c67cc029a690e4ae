"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads the leaf blocks of a page in order. A
block is hashed bags of the tags and of the class, id and role words of all
open elements, a hashed bag of all its words and a few shape figures; both directions give every decision the whole page as context.
The network is trained here, on pages made from templates: articles in many
kinds of wrappers among menus, headers, notices, adverts, sidebars, forms,
comments and footers, some of them deep and full of classes. The number of pages and passes is a parameter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .html_blocks import Block, read_blocks

TAG_DIM, CLASS_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 64, 192, 24, 6, 20
DIM = TAG_DIM + CLASS_DIM + WORD_DIM + SHAPE_DIM
_BAGS = (slice(0, TAG_DIM), slice(TAG_DIM, TAG_DIM + CLASS_DIM), slice(TAG_DIM + CLASS_DIM, DIM - SHAPE_DIM))


class _PathBags:
    """Hashed bags of the tag and class words of paths. An element's bag is its
    parent's and its own words, made once for all blocks below it; only the
    bags of the path last read are held."""

    def __init__(self):
        self.held: dict[int, tuple[np.ndarray, int]] = {}
        self.path: list[tuple] = []

    def of(self, path) -> tuple[np.ndarray, int]:
        last = path.last
        if last is None:
            return np.zeros(TAG_DIM + CLASS_DIM, np.float32), 0
        fresh = []
        while last is not None and id(last) not in self.held:
            fresh.append(last)
            last = last[1]
        while self.path and self.path[-1] is not last:
            del self.held[id(self.path.pop())]
        for element in reversed(fresh):
            bag, n = self.held[id(self.path[-1])] if self.path else (np.zeros(TAG_DIM + CLASS_DIM, np.float32), 0)
            bag = bag.copy()
            for w in element[0]:
                h = zlib.crc32(w.encode())
                bag[TAG_DIM + h % CLASS_DIM if "." in w else h % TAG_DIM] += 1.0 if (h >> 16) & 1 else -1.0
            self.path.append(element)
            self.held[id(element)] = (bag, n + len(element[0]))
        return self.held[id(self.path[-1])]


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row for each block."""
    out = np.zeros((len(blocks), DIM), np.float32)
    total = max(len(blocks), 1)
    bags = _PathBags()
    for i, b in enumerate(blocks):
        row = out[i]
        row[: TAG_DIM + CLASS_DIM], path_words = bags.of(b.path)
        for w in b.text.lower().split():
            h = zlib.crc32(w.encode(errors="replace"))
            row[TAG_DIM + CLASS_DIM + h % WORD_DIM] += 0.03 if (h >> 16) & 1 else -0.03
        n = len(b.text)
        row[DIM - SHAPE_DIM :] = (
            np.log1p(n) / 6, b.link_chars / n, i / total, path_words / 10, b.text.count(".") * 20 / (n + 20), 1.0
        )
    for bag in _BAGS:
        out[:, bag] /= np.sqrt(np.abs(out[:, bag]).sum(1, keepdims=True) + 0.1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over (time, batch, DIM); gates in the order in, forget, cell, out."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.15, (DIM, 4 * HIDDEN))
        self.u = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        self.b = np.zeros(4 * HIDDEN)
        self.b[HIDDEN : 2 * HIDDEN] = 1.0

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t_max, batch, _ = x.shape
        z_in = x @ self.w + self.b
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out, tape = np.zeros((t_max, batch, HIDDEN)), []
        for t in range(t_max):
            z = z_in[t] + h @ self.u
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 3 * HIDDEN :])
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, g, o, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> list[np.ndarray]:
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        du = np.zeros_like(self.u)
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, g, o, tc, m = tape[t]
            dh = dh + dout[t]
            do, dcn = m * dh * tc, m * dh * o * (1 - tc**2) + m * dc
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dcn * i * (1 - g**2), do * o * (1 - o)], 1)
            dz_all[t] = dz
            du += h.T @ dz
            dh, dc = dz @ self.u.T + (1 - m) * dh, dcn * f + (1 - m) * dc
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, DIM).T @ flat, du, flat.sum(0)]


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.fore, self.back = Direction(rng), Direction(rng)
        self.v, self.c = rng.normal(0, 0.15, 2 * HIDDEN), np.zeros(1)

    def params(self) -> list[np.ndarray]:
        return [self.fore.w, self.fore.u, self.fore.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, pages))
        x, mask = np.zeros((t, len(pages), DIM)), np.zeros((t, len(pages)))
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability that each block is main text; pages of like length run
        together, a very long one alone."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            group = [order.pop()]
            while order and len(group) < 128 and len(pages[group[0]]) * (len(group) + 1) <= 20_000:
                group.append(order.pop())
            x, mask = self._pad([pages[k] for k in group])
            a, _ = self.fore.forward(x, mask)
            b, _ = self.back.forward(x[::-1], mask[::-1])
            p = _sigmoid(np.concatenate([a, b[::-1]], 2) @ self.v + self.c)
            for k, page in enumerate(group):
                out[page] = p[: len(pages[page]), k]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], passes: int, batch: int = 16, rate: float = 0.01) -> None:
        rng = np.random.default_rng(9)
        first, second = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), batch):
                group = order[s : s + batch]
                x, mask = self._pad([pages[k] for k in group])
                y = np.zeros(mask.shape)
                for k, page in enumerate(group):
                    y[: len(labels[page]), k] = labels[page]
                a, ta = self.fore.forward(x, mask, True)
                b, tb = self.back.forward(x[::-1], mask[::-1], True)
                both = np.concatenate([a, b[::-1]], 2)
                d = (_sigmoid(both @ self.v + self.c) - y) * mask / mask.sum()
                dboth = d[:, :, None] * self.v
                grads = self.fore.backward(x, ta, dboth[:, :, :HIDDEN])
                grads += self.back.backward(x[::-1], tb, dboth[::-1, :, HIDDEN:])
                grads += [(both * d[:, :, None]).sum((0, 1)), np.array([d.sum()])]
                step += 1
                size = np.sqrt(sum((g**2).sum() for g in grads))
                for p, g, m1, m2 in zip(self.params(), grads, first, second, strict=True):
                    g = g * min(1.0, 1.0 / (size + 1e-9))
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)


# Template pages: (html, marks) where main text blocks carry the mark character.
_MARK = "\u0002"
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la qu eau ment ción sch ung keit".split()
_MENU = ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="navbar"', 'div role="navigation"')
_HEADER = ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="top-bar"')
_FOOTER = ("footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"')
_SIDE = ("aside", 'div class="sidebar"', 'div class="related"', 'div id="sidebar"', 'section class="recommended"', 'div class="widget"', 'div class="share social"')
_NOTICE = ('div class="cookie-banner"', 'div class="notice"', 'div id="cookie-consent"', 'div role="alert"', 'div class="subscribe popup"', 'div class="newsletter"')
_ADVERT = ('div class="ad"', 'div class="advert"', 'div id="ads"', 'div class="sponsored promo"', 'aside class="ad banner"')
_COMMENTS = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="discussion comments"', 'div id="disqus-thread"')
_UTILITY = "flex grid block p m px py mt mb mx text bg rounded shadow border w full h auto items center justify between gap col row md lg sm font bold leading tight space hover dark gray relative z top max min".split()
_MAIN = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="article-body"', 'section class="story"', 'article class="post entry"', 'main id="content"', 'div class="entry-content"', 'td class="body"', 'div role="main"')


def _words(rng, low: int, high: int) -> str:
    sizes = rng.integers(1, 4, int(rng.integers(low, high + 1)))
    ids = iter(rng.integers(0, len(_SYLLABLES), int(sizes.sum())).tolist())
    return " ".join("".join(_SYLLABLES[next(ids)] for _ in range(k)) for k in sizes.tolist())


def _sentence(rng, low: int, high: int) -> str:
    words = _words(rng, low, high)
    return words[:1].upper() + words[1:] + ("." if rng.random() < 0.9 else "")


def _wrap(kind: str, inner: str) -> str:
    return f"<{kind}>{inner}</{kind.split()[0]}>"


def _classes(rng, low: int, high: int) -> str:
    return " ".join(str(x) for x in rng.choice(_UTILITY, int(rng.integers(low, high + 1))))


def _deepen(rng, page: str) -> str:
    """The page with utility classes on plain tags and its sections' insides in
    nested divs, as page builders write them."""
    low, high = int(rng.integers(1, 5)), int(rng.integers(5, 14))
    page = re.sub(r"<(p|div|ul|li|h[1-3])>", lambda m: f'<{m[1]} class="{_classes(rng, low, high)}">', page)
    layers = int(rng.integers(0, 5))
    opened = "".join(f'<div class="{_classes(rng, low, high)}">' for _ in range(layers))
    sections = r"nav|header|footer|aside|article|main|section"
    page = re.sub(rf"<({sections})( [^>]*)?>", lambda m: m[0] + opened, page)
    return re.sub(rf"</({sections})>", lambda m: "</div>" * layers + m[0], page)


def _links(rng) -> str:
    items = [f'<a href="/x">{_words(rng, 1, 3)}</a>' for _ in range(int(rng.integers(2, 9)))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.8 else "".join(f"<div>{x}</div>" for x in items)


def _aside(rng, kinds: tuple[str, ...]) -> str:
    kind = str(rng.choice(kinds))
    parts = []
    for _ in range(int(rng.integers(1, 4))):
        parts.append([_links(rng), f"<p>{_sentence(rng, 3, 40)}</p>", _sentence(rng, 3, 14), f"<h3>{_words(rng, 1, 4)}</h3>"][int(rng.integers(4))])
    return _wrap(kind, " ".join(parts))


def template_page(rng, deep: bool | None = None) -> str:
    """A page; ``deep`` ones have many classes and nested wrappers, by chance if not told."""
    pick = lambda p: rng.random() < p
    body = []
    if pick(0.6):
        body.append(_aside(rng, _HEADER))
    if pick(0.9):
        body.append(_wrap(str(rng.choice(_MENU)), _links(rng)))
    if pick(0.3):
        body.append(_aside(rng, _NOTICE))
    if pick(0.5):
        body.append(_aside(rng, _ADVERT))
    if pick(0.3):
        body.append(_aside(rng, _SIDE))
    main = [f"<h1>{_MARK}{_words(rng, 1, 10)}</h1>"] if pick(0.9) else []
    many = int(rng.integers(1, 12)) if pick(0.9) else 0
    for _ in range(many):
        text = _MARK + " ".join(_sentence(rng, 1, 30) for _ in range(int(rng.integers(1, 5))))
        if pick(0.15):
            text = _MARK + " | ".join(_words(rng, 1, 1) for _ in range(int(rng.integers(3, 30))))
        kind = rng.random()
        if kind < 0.75:
            main.append(f"<p>{text}</p>" if pick(0.7) else f"<p><b>{text}<br>")
        elif kind < 0.82:
            main.append(f"<h2>{_MARK}{_words(rng, 1, 8)}</h2>")
        elif kind < 0.88:
            main.append("<ul>" + "".join(f"<li>{_MARK}{_sentence(rng, 2, 14)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        elif kind < 0.92:
            main.append(f"<blockquote>{text}</blockquote>")
        else:
            main.append(f"<div>{text}</div>")
        if pick(0.04):
            main.append(_aside(rng, _ADVERT))
        if pick(0.03):
            main.append(_aside(rng, _SIDE))
        if pick(0.02):
            main.append(f"<form><label>{_words(rng, 1, 4)}</label><p>{_sentence(rng, 2, 12)}</p></form>")
    if pick(0.12):
        main.append(_aside(rng, _COMMENTS))
    kind = str(rng.choice(_MAIN)) if pick(0.6) else "article"
    body.append(f"<table><tr>{_wrap(kind, ''.join(main))}</tr></table>" if kind.startswith("td") else _wrap(kind, "".join(main)))
    if pick(0.3):
        body.append(_aside(rng, _COMMENTS))
    if pick(0.35):
        body.append(_aside(rng, _SIDE))
    if pick(0.25):
        body.append(f"<form><p>{_sentence(rng, 2, 14)}</p><label>{_words(rng, 1, 3)}</label></form>")
    if pick(0.9):
        foot = f"&copy; {_words(rng, 1, 3)} &middot; " + " ".join(_sentence(rng, 2, 14) for _ in range(int(rng.integers(1, 4))))
        body.append(_wrap(str(rng.choice(_FOOTER)) if pick(0.5) else "footer", foot if pick(0.6) else f"<p>{foot}</p>{_links(rng)}"))
    inner = "".join(body)
    if deep if deep is not None else pick(0.35):
        inner = _deepen(rng, inner)
    page = f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 6)}</title></head><body>{inner if pick(0.6) else _wrap('div class=\"wrapper container page\"', inner)}</body></html>"
    return page[: int(len(page) * rng.uniform(0.5, 1))] if pick(0.1) else page


def template_set(pages: int, seed: int, deep: bool | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < pages:
        blocks = read_blocks(template_page(rng, deep))
        if not blocks:
            continue
        ys.append(np.array([_MARK in b.text for b in blocks], float))
        xs.append(block_features([Block(b.path, b.text.replace(_MARK, "") or ".", b.link_chars) for b in blocks]))
    return xs, ys


@lru_cache(maxsize=4)
def trained(pages: int = 1200, passes: int = 6, seed: int = 5) -> Labeller:
    """The labeller after ``passes`` over ``pages`` shallow and as many deep templates."""
    model = Labeller(seed)
    shallow, deep = template_set(pages, seed, False), template_set(pages, seed + 1, True)
    model.train(shallow[0] + deep[0], shallow[1] + deep[1], passes=passes)
    return model


def main_text(sources: list[str | None], model: Labeller, threshold: float = 0.5) -> list[str]:
    pages = [read_blocks(s or "") for s in sources]
    scores = model.scores([block_features(b) for b in pages])
    return ["\n".join(b.text for b, s in zip(blocks, score, strict=True) if s >= threshold) for blocks, score in zip(pages, scores, strict=True)]


def extract_pages(pages: DataFrame, train_pages: int = 1200, passes: int = 6) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each input row. Null or empty
    html, and pages without main text, give an empty text; ids and urls pass
    through as they are."""
    model = trained(train_pages, passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = main_text(batch.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_recurrent_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
