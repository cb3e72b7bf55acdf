"""Main text of web pages, by a recurrent block labeller.

A page is cut into leaf blocks (see ``html_blocks``).  A bidirectional LSTM in
numpy reads the page's whole sequence of blocks, each as the hashed features of
the elements around it, its hashed words and a few measures, and labels every
block as main text or not, so a block's label rests on the whole document.  The
main text is the labelled blocks in page order, joined by newlines.

The weights are trained here, once in a driver process, on seeded synthetic
pages (``training_page``): articles among menus, headers, footers, sidebars,
notices, adverts, forms and comments, under many names and structures.  No page
of the input is used for training.

Defined results: a null or empty page, or one without a block of main text, has
empty text and 0 characters; repeated rows are treated alike; pages of any
length and depth are read whole, in time proportional to their length and, above
``PIECE`` blocks, piece by piece; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.html_blocks import Block, blocks

PATH, WORDS, MEASURES, HIDDEN = 256, 48, 8, 20
SIZE = PATH + WORDS + MEASURES
_PATHS: dict[tuple, np.ndarray] = {}
#: Blocks of a page that are read at once; longer pages are read piece by piece, with the states carried on.
PIECE = 2048


# what the labeller reads


def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH, np.float32)
        features = [f for element in path for f in element]
        for f in set(features):
            h = crc32(f.encode("utf-8", "surrogatepass"))
            found[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
        for f in features[-1:]:
            found[crc32(b"last " + f.encode("utf-8", "surrogatepass")) % PATH] += 1.0
        if len(_PATHS) > 5_000:
            _PATHS.clear()
        _PATHS[path] = found
    return found


def vectors(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row for each block, or for a part of them."""
    part = page[start:stop]
    x = np.zeros((len(part), SIZE), np.float32)
    for row, b in enumerate(part):
        i = start + row
        x[row, :PATH] = _path_vector(b.path)
        words = b.text.lower().split()
        counts = np.bincount([crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        x[row, PATH : PATH + WORDS] = counts / np.sqrt((counts * counts).sum())
        n = len(b.text)
        ends = sum(b.text.count(c) for c in ".!?,;:")
        x[row, PATH + WORDS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, min(1.0, b.linked / n), min(1.0, 10 * ends / n), i / len(page), 1.0 / (1 + i), 1.0 / (len(page) - i), np.log1p(len(page)) / 5)
    return x


# the network


class Labeller:
    """Bidirectional LSTM with a logistic output; weights by name."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"w{d}"] = (rng.standard_normal((SIZE, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.w[f"u{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            self.w[f"c{d}"] = bias
        self.w["v"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.w["o"] = np.zeros(1, np.float32)

    def _forward(self, x: np.ndarray, d: str, keep: bool, state: list | None = None) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of the inputs (time, batch, size); ``state`` [h, c] is carried on from piece to piece."""
        steps, n, _ = x.shape
        z_all = (x.reshape(-1, SIZE) @ self.w[f"w{d}"]).reshape(steps, n, -1) + self.w[f"c{d}"]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_all[t] + h @ self.w[f"u{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            s = np.tanh(c)
            if keep:
                tape.append((i, f, o, g, before, s, h))
            h = o * s
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out, tape

    def _backward(self, x: np.ndarray, d: str, tape: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        steps, n, _ = x.shape
        dz_all = np.empty((steps, n, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        du = np.zeros_like(self.w[f"u{d}"])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, s, h = tape[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - s * s)
            dz = dz_all[t]
            dz[:, :HIDDEN] = dc * g * i * (1 - i)
            dz[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            dz[:, 2 * HIDDEN : 3 * HIDDEN] = dh * s * o * (1 - o)
            dz[:, 3 * HIDDEN :] = dc * i * (1 - g * g)
            du += h.T @ dz
            dh = dz @ self.w[f"u{d}"].T
            dc = dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        into[f"w{d}"], into[f"u{d}"], into[f"c{d}"] = x.reshape(-1, SIZE).T @ flat, du, flat.sum(0)

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs forwards and backwards, both from step 0, and the mask (time, batch)."""
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), SIZE), np.float32)
        y = np.zeros_like(x)
        mask = np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], y[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
        return x, y, mask

    @staticmethod
    def _turned(states: np.ndarray, lengths: list[int]) -> np.ndarray:
        out = np.zeros_like(states)
        for k, n in enumerate(lengths):
            out[:n, k] = states[:n, k][::-1]
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log odds of each block of each page to be main text."""
        x, y, _ = self._padded(pages)
        lengths = [len(p) for p in pages]
        forth, _ = self._forward(x, "f", False)
        back, _ = self._forward(y, "b", False)
        s = forth @ self.w["v"][:HIDDEN] + self._turned(back, lengths) @ self.w["v"][HIDDEN:] + self.w["o"]
        return [s[:n, k] for k, n in enumerate(lengths)]

    def long_scores(self, page: list[Block]) -> np.ndarray:
        """``scores`` of one page of any length: only the states' share of each score is kept."""
        out = np.full(len(page), self.w["o"][0], np.float32)
        cuts = list(range(0, len(page), PIECE))
        for d, order, v in (("f", cuts, self.w["v"][:HIDDEN]), ("b", cuts[::-1], self.w["v"][HIDDEN:])):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for at in order:
                x = vectors(page, at, at + PIECE)
                states, _ = self._forward((x if d == "f" else x[::-1])[:, None], d, False, state)
                share = states[:, 0] @ v
                out[at : at + PIECE] += share if d == "f" else share[::-1]
        return out

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss, and its gradients."""
        x, y, mask = self._padded(pages)
        lengths = [len(p) for p in pages]
        target = np.zeros_like(mask)
        for k, lab in enumerate(labels):
            target[: len(lab), k] = lab
        forth, tape_f = self._forward(x, "f", True)
        back, tape_b = self._forward(y, "b", True)
        turned = self._turned(back, lengths)
        s = forth @ self.w["v"][:HIDDEN] + turned @ self.w["v"][HIDDEN:] + self.w["o"]
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        loss = -(mask * np.log(np.where(target > 0, p, 1 - p) + 1e-9)).sum() / mask.sum()
        ds = ((p - target) * mask / mask.sum()).astype(np.float32)
        grads = {"o": np.array([ds.sum()], np.float32), "v": np.concatenate([np.einsum("tn,tnh->h", ds, forth), np.einsum("tn,tnh->h", ds, turned)])}
        self._backward(x, "f", tape_f, ds[..., None] * self.w["v"][:HIDDEN], grads)
        self._backward(y, "b", tape_b, self._turned(ds[..., None] * self.w["v"][HIDDEN:], lengths), grads)
        return float(loss), grads


# training pages

# Names under which pages hold their parts (fixed values).
MAIN = ["<article>", "<article class='post'>", "<main>", "<main role='main'>", "<div class='content'>", "<div id='main-content'>", "<div class='post-body'>", "<section class='entry-content'>", "<div class='article-body'>", "<div class='story'>", "<td class='body'>", "<div class='text'>", "<div itemprop='articleBody'>", "<div class='page'><article>", "<main><article class='entry'>", "<div class='main'><div class='article'>"]
MENU = ["<nav>", "<nav class='menu'>", "<div class='nav'>", "<div id='menu'>", "<ul class='navbar'>", "<div class='breadcrumbs'>", "<div class='navigation' role='navigation'>", "<div class='topnav'>", "<div class='pagination'>", "<div class='tags'>", "<div class='toc'>"]
HEADER = ["<header>", "<header class='site-header'>", "<div class='header'>", "<div id='masthead'>", "<div class='topbar'>", "<div class='branding'>", "<header role='banner'>"]
FOOTER = ["<footer>", "<footer class='site-footer'>", "<div class='footer'>", "<div id='footer'>", "<div class='copyright'>", "<div class='bottom'>", "<footer role='contentinfo'>"]
SIDE = ["<aside>", "<aside class='sidebar'>", "<div class='sidebar'>", "<div id='right'>", "<div class='widget'>", "<div class='related'>", "<section class='related-posts'>", "<div class='recommended'>", "<div class='trending'>", "<div class='author-bio'>", "<div class='popular'>"]
NOTICE = ["<div class='cookie'>", "<div class='cookie-banner'>", "<div class='notice'>", "<div id='gdpr'>", "<div class='consent'>", "<div role='alert'>", "<div class='alert'>", "<dialog>", "<div class='popup'>", "<noscript>", "<div class='modal'>", "<div class='warning'>", "<div class='disclaimer'>", "<div class='message'>", "<div class='paywall'>"]
ADVERT = ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='sponsored'>", "<div class='banner'>", "<ins class='adsbygoogle'>", "<div class='promo'>", "<section class='ad-slot'>", "<div class='sponsor'>", "<p class='ad'>", "<aside class='ad'>"]
FORM = ["<form>", "<form class='search'>", "<form id='login'>", "<div class='newsletter'><form>", "<form class='subscribe'>", "<div class='signup'>", "<div class='subscribe'>", "<form class='comment-form'>"]
SHARE = ["<div class='share'>", "<div class='social'>", "<ul class='share-links'>", "<div class='sharing'>"]
COMMENT = ["<section class='comments'>", "<div id='comments'>", "<div class='comment-list'>", "<ol class='commentlist'>", "<section id='discussion'>", "<div class='responses'>", "<div id='disqus'>", "<div class='reviews'>", "<div class='replies'>"]
STOCK = "home about contact login register search menu next previous share reply comments subscribe newsletter cookies accept privacy terms policy copyright rights reserved advertisement sponsored related popular follow send name email message by the and of in".split()


def _word(rng: random.Random) -> str:
    if rng.random() < 0.04:
        return rng.choice(["2019", "x@y.example", "&amp;", "***", "10.0.0.1", "http://a.example/b", "$5", "###", "+1 555", "A!!"])
    w = "".join(rng.choice("b c d f g l m n p r s t v th st ch".split()) + rng.choice("a e i o u é ü ñ".split()) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))
    return w.upper() if rng.random() < 0.02 else w


def _prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = _word(rng)
        out.append((w.capitalize() if not out or out[-1].endswith(".") else w) + rng.choice(["", "", "", "", "", "", ",", "."]))
        if rng.random() < 0.02:
            out[-1] = f"<{(t := rng.choice(['a href=/x', 'b', 'em', 'strong', 'i', 'code', 'span']))}>{out[-1]}</{t.split()[0]}>"
    text = " ".join(out)
    return text + ("." if rng.random() < 0.85 else "")


def _ending(opening: str) -> str:
    names = [t[1:].split(" ")[0].rstrip(">") for t in opening.replace("><", "> <").split(" ") if t.startswith("<")]
    return "".join(f"</{n}>" for n in reversed(names))


def _links(rng: random.Random, n: int) -> str:
    words = [rng.choice(STOCK) if rng.random() < 0.4 else _word(rng) for _ in range(n)]
    kind = rng.random()
    if kind < 0.6:
        return "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words) + "</ul>"
    return (" | " if kind < 0.8 else "").join(f"<a href='/{w}'>{w}</a>" if kind < 0.8 else f"<div><a href='/{w}'>{w} {_word(rng)}</a></div>" for w in words)


def _noise(rng: random.Random, names: list[str], plain: bool = False) -> str:
    opening = rng.choice(["<div>", "<div>", "<p>", "<td>"]) if plain else rng.choice(names)
    opening = opening.replace(">", " data-mark=\"0\">", 1)
    if names is MENU or names is SHARE:
        inner = _links(rng, rng.randint(2, 9))
    elif names is FORM:
        inner = f"<label>{rng.choice(STOCK)}</label><input name=q><select><option>{_word(rng)}<option>{_word(rng)}</select><textarea>{_word(rng)}</textarea><button>{rng.choice(STOCK)}</button>"
        inner = (f"<h3>{_prose(rng, 3)}</h3>" if rng.random() < 0.3 else f"<p>{_prose(rng, rng.randint(3, 25))}</p>" if rng.random() < 0.4 else "") + inner
    elif names is COMMENT:
        kind = rng.choice(["<div class='comment'>", "<li>", "<article class='comment'>", "<div>", "<div class='reply'>", "<p>"])
        inner = (f"<h3>{rng.randint(1, 40)} {rng.choice(STOCK)}</h3>" if rng.random() < 0.5 else "") + "".join(f"{kind}<b>{_word(rng)}</b> <p>{_prose(rng, rng.randint(2, 50))}</p>{_ending(kind)}" for _ in range(rng.randint(1, 6)))
    elif names is FOOTER:
        inner = f"{rng.choice(['&copy;', '&copy;', '&copy;', 'Copyright', 'Copyright &copy;', '(c)'])} {rng.choice([f'{rng.randint(1998, 2030)} ', ''])}{_word(rng)}.example {rng.choice(['', '', 'All rights reserved. '])}{rng.choice(['&middot;', '|', '-'])} {_prose(rng, rng.randint(1, 18))}" + (_links(rng, 4) if rng.random() < 0.4 else "")
    elif names is SIDE and rng.random() < 0.6:
        inner = (f"<h3>{_prose(rng, 2)}</h3>" if rng.random() < 0.6 else "") + _links(rng, rng.randint(2, 6))
    else:
        body = _prose(rng, rng.randint(1, 30))
        inner = rng.choice([body, f"<p>{body}</p>", f"<h2>{_prose(rng, 2)}</h2><p>{body}</p>", f"<span>{body}</span> <button>{rng.choice(STOCK)}</button>"])
    return opening + inner + _ending(opening)


def _article(rng: random.Random, opening: str | None = None) -> str:
    opening = opening or (rng.choice(MAIN) if rng.random() < 0.6 else "<article>")
    out = [opening.replace(">", " data-mark=\"1\">", 1)]
    if rng.random() < 0.75:
        out.append(f"<h1>{_prose(rng, rng.randint(1, 12))}</h1>")
    ragged = rng.random() < 0.4
    for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14, 22))):
        text = _prose(rng, rng.choice((1, 2, 3, 5, 8, 14, 25, 45, 80)))
        junk = rng.random()
        if junk < 0.06:  # repeated words, shouting, symbols
            few = [_word(rng) for _ in range(rng.choice((1, 1, 2, 6)))]
            text = " ".join((few * 60)[: rng.randint(2, 60)])
            text = text.upper() if junk < 0.02 else text.replace(" ", rng.choice(["*** ", "$$$ ", "!! ", " "]))
        elif junk < 0.1:  # a notice that is part of the article
            text = " ".join(sorted([rng.choice(STOCK) for _ in range(rng.randint(1, 5))] + [_word(rng) for _ in range(rng.randint(1, 8))], key=lambda _: rng.random())).capitalize() + "."
        kind = rng.random()
        if ragged and kind < 0.4:
            out.append(f"<p><b>{text}<br>")
        elif kind < 0.78:
            out.append(f"<p>{text}</p>" if not (ragged and kind < 0.5) else f"<p>{text}")
        elif kind < 0.83:
            out.append(f"<h2>{text[:60].split('<')[0]}</h2>")
        elif kind < 0.87:
            out.append("<ul>" + "".join(f"<li>{_prose(rng, rng.randint(1, 12))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.9:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.92:
            out.append(f"<table><tr><td>{_word(rng)}<td>{_word(rng)}<tr><td>{_word(rng)}</table>")
        elif kind < 0.94:
            out.append(f"<div><p>{text}</p></div>")
        elif kind < 0.95:
            out.append(f"<pre>{text}</pre>")
        else:
            out.append(_noise(rng, rng.choice([ADVERT, SHARE, SIDE, FORM, NOTICE, MENU, ADVERT, COMMENT])))
    if rng.random() < 0.15:
        out.append(_noise(rng, COMMENT))
    return "".join(out) + _ending(opening)


def training_page(rng: random.Random) -> str:
    """A page whose blocks carry their label in ``data-mark``."""
    some = lambda p, names: _noise(rng, names) if rng.random() < p else ""
    if rng.random() < 0.07:  # nothing is named: only what can be told by its words and links
        plain = lambda p, names: _noise(rng, names, True) if rng.random() < p else ""
        body = plain(0.7, MENU) + plain(0.2, FORM) + _article(rng, rng.choice(["<div>", "<div>", "<td>", "<article>", "<main>"])) + plain(0.3, MENU) + plain(0.8, FOOTER)
        return f"<html><head><title>{_prose(rng, 4)}</title></head><body data-mark=\"0\">{body}</body></html>"
    before = [some(0.4, HEADER), some(0.75, MENU), some(0.3, NOTICE), some(0.5, ADVERT), some(0.25, FORM), some(0.2, SIDE)]
    after = [some(0.3, SIDE), some(0.3, COMMENT), some(0.3, ADVERT), some(0.2, FORM), some(0.2, NOTICE), some(0.15, MENU), some(0.75, FOOTER), some(0.1, NOTICE)]
    if rng.random() < 0.3:
        rng.shuffle(before)
    middle = _article(rng)
    if rng.random() < 0.25:
        wrap = rng.choice(["<div class='container'>", "<div id='wrapper'>", "<div class='row'>", "<section>", "<div>"])
        middle = wrap + middle + _ending(wrap)
    head = f"<!DOCTYPE html><html><head><title>{_prose(rng, 4)}</title></head><body data-mark=\"0\">"
    return head + "".join(before) + middle + "".join(after) + ("</body></html>" if rng.random() < 0.9 else "")


@functools.lru_cache(maxsize=2)
def train(pages: int = 3000, steps: int = 600, batch: int = 24, rate: float = 0.006, seed: int = 9) -> Labeller:
    """The labeller after ``steps`` of Adam over seeded synthetic pages."""
    rng = random.Random(seed)
    made = [p for p in (blocks(training_page(rng)) for _ in range(pages)) if 0 < len(p) <= 90]
    inputs = [vectors(p) for p in made]
    labels = [np.array([b.mark == "1" for b in p], np.float32) for p in made]
    net, order = Labeller(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        pick = order.choice(len(made), batch, replace=False)
        dropped = []
        for k in pick:  # without some features, so that none decides alone
            x = inputs[k].copy()
            x[:, : PATH + WORDS] *= order.random(PATH + WORDS) > 0.08
            dropped.append(x)
        _, grads = net.step(dropped, [labels[k] for k in pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.w[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


# the operator


def extract(pages: list[str | None], net: Labeller) -> list[str]:
    """Main texts of the pages."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        if len(parsed[order[at]]) > PIECE:
            i = order[at]
            out[i] = "\n".join(b.text for b, x in zip(parsed[i], net.long_scores(parsed[i]), strict=True) if x > 0)
            parsed[i] = []
            at += 1
            continue
        n = max(1, min(64, 12_000 // len(parsed[order[at]])))
        group = order[at : at + n]
        while len(group) > 1 and len(parsed[group[-1]]) > min(PIECE, 1.5 * len(parsed[group[0]]) + 8):
            group.pop()
        for i, s in zip(group, net.scores([vectors(parsed[i]) for i in group]), strict=True):
            out[i] = "\n".join(b.text for b, x in zip(parsed[i], s, strict=True) if x > 0)
        at += len(group)
    return out


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages``' columns but ``html``, with ``text`` and ``n_chars`` (columns of those names are replaced)."""
    own = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    scratch.small_batches(pages.sparkSession)
    net = pages.sparkSession.sparkContext.broadcast(train())  # a fixed number of weights

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        out: list[str] = []
        rows = htmls.tolist()
        at = 0
        while at < len(rows):  # about 8 MB of pages at once
            size, end = 0, at
            while end < len(rows) and (end == at or size < 8_000_000):
                size += len(rows[end] or "")
                end += 1
            out += extract(rows[at:end], net.value)
            at = end
        return pd.Series(out, dtype=object)

    made = pages.withColumn("__text", run(F.col(html)))
    return made.select(*own, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
