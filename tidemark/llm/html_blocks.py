"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the leaf texts between block-level tags. A block is described by its tag path (names, classes and ids of the open
elements, hashed), by its words (hashed) and by a few counts. A bidirectional LSTM in numpy reads the blocks of a page in order, so each
label depends on the whole page; blocks labelled as main text are joined in page order.

The network is trained here, on pages made by :func:`training_pages`: layouts of many kinds whose blocks are known, filled with
invented words. Nothing is learned from the pages it is applied to. Number of pages, passes and seed are parameters.

Null and empty pages, and pages without main text, give an empty text. Character references are decoded once; white space in a block becomes one
space. Scripts, styles, comments and markup hold no text. Nor do drawings, forms of choice and the like (``HELD``), from their tag to
the end tag that matches it; one that ends itself or is never closed loses its tag only. Whole pages are read; unclosed tags, stray
ends and cut-off pages are read as far as they go. Repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_column

PATH_BINS, WORD_BINS, COUNTS = 256, 32, 8
WIDTH = PATH_BINS + WORD_BINS + COUNTS
HIDDEN = 24
PAGES, EPOCHS, SEED = 2_000, 6, 7
#: Pages that run through the network together: so many at most, and so many blocks with the padding. A longer page runs alone, in
#: slices of so many blocks.
GROUP, GROUP_BLOCKS = 128, 16_384

#: Elements whose text is no markup; without an end tag they reach to the end of the page.
_RAW = r"<(script|style|iframe|title|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
#: Elements whose content is dropped, if they are closed.
HELD = "noscript|template|svg|object|canvas|select"
_HELD_TAG = re.compile(rf"<(/?)({HELD})(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.I)
_OUTSIDE = re.compile(rf"<!--.*?(?:-->|\Z)|{_RAW}|<(/?)({HELD})(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S | re.I)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|{_RAW}|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br button".split())
#: An opening tag of the key ends an open element of the values, if that is nearer than the fence.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = set("ul ol dl table body html article section div nav aside footer header main form td th".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """What the path says of one element."""
    names = [part for m in _NAMES.findall(attributes) for part in _PART.findall(" ".join(m).lower())]
    return (tag, *names)


def without_held(page: str) -> str:
    """``page`` with an empty declaration in place of each closed element of ``HELD``, and of the tag of each that is not closed."""
    if not _HELD_TAG.search(page):
        return page
    spans: list[tuple[int, int]] = []
    open_: dict[str, list[tuple[int, int]]] = {}
    at, depth = 0, 0
    # comments and scripts are passed over, but not inside of an open element: there an end tag is one wherever it stands
    while match := (_HELD_TAG if depth else _OUTSIDE).search(page, at):
        at = match.end()
        closing, tag, attributes = match.groups()[-3:]
        if tag is None:
            continue
        waiting = open_.setdefault(tag.lower(), [])
        if not closing:
            spans.append(match.span())
            if not (attributes.endswith("/") and tag.lower() in ("svg", "object")):
                waiting.append(match.span())
                depth += 1
        elif waiting:
            spans.append((waiting.pop()[0], match.end()))
            depth -= 1
    out, done = [], 0
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= done:
            out += [page[done:start], "<!>"]
            done = end
    return "".join([*out, page[done:]])


def blocks(page: str | None) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                found.append(Block(text, tuple(x for _, e in stack for x in e), min(linked, len(text))))
            buffer.clear()
        linked = 0

    for match in _TOKEN.finditer(without_held(page or "")):
        tag = match.group(3)
        if tag is None:
            text = match.group(5)
            if text is not None:
                buffer.append(text)
                if links:
                    linked += len(text)
            continue
        tag = tag.lower()
        closing = bool(match.group(2))
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
                links = 0
        elif tag not in _VOID:
            ends = _ENDS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in _FENCE:
                    break
            if not match.group(4).endswith("/") or tag in _FENCE:
                stack.append((tag, _element(tag, match.group(4))))
    flush()
    return found


@lru_cache(maxsize=16384)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_BINS, np.float32)
    for depth, part in enumerate(path):
        out[crc32(part.encode()) % PATH_BINS] = 1.0
    return out


_STEPS = np.cumprod(np.full(256, 0x01000193, np.uint64))


def _word_counts(page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words per block, and the number of words; all words of the page are hashed together."""
    data = np.frombuffer(" ".join(b.text for b in page).lower().encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.append(0, np.flatnonzero(data == 32) + 1)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    with np.errstate(over="ignore"):
        digests = np.add.reduceat(np.where(data == 32, 0, data).astype(np.uint64) * _STEPS[at % 256], starts)
        bins = (digests * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(WORD_BINS)
    words = np.array([b.text.count(" ") + 1 for b in page])
    owner = np.repeat(np.arange(len(page)), words)
    return np.bincount(owner * WORD_BINS + bins.astype(np.int64), minlength=len(page) * WORD_BINS).reshape(len(page), WORD_BINS), words


def features(page: list[Block]) -> np.ndarray:
    """One row per block: path, words, counts."""
    x = np.zeros((len(page), WIDTH), np.float32)
    if not page:
        return x
    counts, words = _word_counts(page)
    x[:, :PATH_BINS] = [_path_vector(b.path) for b in page]
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = np.sqrt(counts / words[:, None])
    chars = np.array([len(b.text) for b in page])
    x[:, PATH_BINS + WORD_BINS :] = np.column_stack([
        np.log1p(words) / 4,
        np.log1p(chars) / 6,
        [b.linked for b in page] / chars,
        [len(b.path) / 8 for b in page],
        [b.text[-1] in ".!?" for b in page],
        [b.text[0].isupper() for b in page],
        np.array([b.text.count(".") + b.text.count(",") + b.text.count(";") for b in page]) / chars * 10,
        np.ones(len(page)),
    ])
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logit per block. Sequences are padded at their ends, so padding never reaches a block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", make(WIDTH, 4 * HIDDEN)), ("h", make(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p |= {"o": make(2 * HIDDEN, 1)[:, 0], "z": np.zeros(1, np.float32)}

    def _scan(self, x: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        batch, steps, _ = x.shape
        gates_in = x.reshape(-1, WIDTH) @ self.p[f"x{d}"]
        gates_in = gates_in.reshape(batch, steps, -1) + self.p[f"c{d}"]
        h, c = state or (np.zeros((batch, HIDDEN), np.float32),) * 2
        out, trace = np.empty((batch, steps, HIDDEN), np.float32), []
        for t in range(steps):
            z = gates_in[:, t] + h @ self.p[f"h{d}"]
            s = _sigmoid(z)
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN : 3 * HIDDEN]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            shown = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, before, shown, h))
            h = o * shown
            out[:, t] = h
        return out, trace, (h, c)

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence back to front, padding left at the end."""
        at = lengths[:, None] - 1 - np.arange(x.shape[1])[None, :]
        return np.take_along_axis(x, np.where(at >= 0, at, np.arange(x.shape[1])[None, :])[:, :, None], axis=1)

    def logits(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        hf, tf, _ = self._scan(x, "f", keep)
        back = self._turned(x, lengths)
        hb, tb, _ = self._scan(back, "b", keep)
        both = np.concatenate([hf, self._turned(hb, lengths)], axis=2)
        return both @ self.p["o"] + self.p["z"][0], (both, back, tf, tb)

    def _back(self, x: np.ndarray, grad: np.ndarray, trace: list, d: str) -> dict[str, np.ndarray]:
        batch, steps, _ = x.shape
        dz = np.zeros((batch, steps, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(self.p[f"h{d}"])
        dh = dc = np.zeros((batch, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, shown, h = trace[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - shown**2)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dwh += h.T @ dz[:, t]
            dh, dc = dz[:, t] @ self.p[f"h{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        return {f"x{d}": x.reshape(-1, WIDTH).T @ flat, f"h{d}": dwh, f"c{d}": flat.sum(axis=0)}

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, (both, back, tf, tb) = self.logits(x, lengths, keep=True)
        real = np.arange(x.shape[1])[None, :] < lengths[:, None]
        p = _sigmoid(z)
        error = np.where(real, p - y, 0).astype(np.float32) / max(1, real.sum())
        loss = float(-(np.where(real, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0)).sum() / max(1, real.sum()))
        grad = error[:, :, None] * self.p["o"]
        out = {"o": (both * error[:, :, None]).sum(axis=(0, 1)), "z": np.array([error.sum()], np.float32)}
        out |= self._back(x, grad[:, :, :HIDDEN], tf, "f")
        out |= self._back(back, self._turned(np.ascontiguousarray(grad[:, :, HIDDEN:]), lengths), tb, "b")
        return loss, out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int, batch: int = 32, rate: float = 0.01) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        step, loss = 0, 0.0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, lengths = padded([pages[i][0] for i in groups[g]])
                y = np.zeros(x.shape[:2], np.float32)
                for row, i in enumerate(groups[g]):
                    y[row, : len(pages[i][1])] = pages[i][1]
                loss, grads = self.gradients(x, lengths, y)
                size = np.sqrt(sum(float((q**2).sum()) for q in grads.values()))
                step += 1
                for k, q in grads.items():
                    q = q * min(1.0, 1.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.99 * v[k] + 0.01 * q * q
                    pace = rate * (1 - epoch / epochs) ** 0.5
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def _long(self, page: Sequence, describe: Callable[[Sequence], np.ndarray]) -> np.ndarray:
        """Logits of one page of any length: both directions go over it in slices and keep one number a block."""
        z = np.full(len(page), self.p["z"][0], np.float32)
        starts = range(0, len(page), GROUP_BLOCKS)
        for d, weights, order in (("f", self.p["o"][:HIDDEN], starts), ("b", self.p["o"][HIDDEN:], reversed(starts))):
            state, turn = None, 1 if d == "f" else -1
            for at in order:
                x = describe(page[at : at + GROUP_BLOCKS])[None, ::turn]
                h, _, state = self._scan(x, d, False, state)
                z[at : at + GROUP_BLOCKS] += (h[0] @ weights)[::turn]
        return z

    def label(self, pages: Sequence[Sequence], describe: Callable[[Sequence], np.ndarray] = np.asarray) -> list[np.ndarray]:
        """Probability of main text per block and page; pages of like length go through together.

        ``describe`` gives the features of a page or a slice of one; they are made for one group at a time.
        """
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < min(len(order), at + GROUP) and (end + 1 - at) * len(pages[order[end]]) <= GROUP_BLOCKS:
                end += 1
            group, at = order[at:end], end
            if len(pages[group[-1]]) > GROUP_BLOCKS:
                out[group[0]] = _sigmoid(self._long(pages[group[0]], describe))
                continue
            x, lengths = padded([describe(pages[i]) for i in group])
            p = _sigmoid(self.logits(x, lengths)[0])
            for row, i in enumerate(group):
                out[i] = p[row, : lengths[row]].copy()
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), max(1, lengths.max(initial=0)), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, lengths


# --- training pages: layouts with known blocks ---

MAIN_WRAPS = [("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' class="post-content entry"'), ("div", ' id="story"'), ("section", ' class="article"'), ("div", ' class="main-text"'), ("div", ' itemprop="articleBody" class="body"')]
BOILER = {
    "nav": [("nav", ""), ("nav", ' class="menu"'), ("div", ' class="navbar"'), ("ul", ' class="menu nav"'), ("div", ' id="navigation"'), ("div", ' class="breadcrumbs"'), ("div", ' class="topnav links"')],
    "header": [("header", ""), ("div", ' class="header"'), ("div", ' id="masthead"'), ("header", ' class="site-header"'), ("div", ' class="site-title banner"')],
    "ad": [("div", ' class="ad"'), ("div", ' class="ads"'), ("aside", ' class="advert"'), ("div", ' class="advertisement"'), ("div", ' id="sponsor"'), ("div", ' class="promo"'), ("section", ' class="sponsored ad-box"'), ("div", ' class="banner-ad"')],
    "sidebar": [("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' class="widget"'), ("div", ' class="related"'), ("section", ' class="recommended popular"'), ("div", ' id="sidebar"'), ("div", ' class="tags share social"')],
    "notice": [("div", ' class="cookie-notice"'), ("div", ' class="notice"'), ("div", ' id="consent"'), ("div", ' class="newsletter"'), ("div", ' class="alert"'), ("section", ' class="gdpr banner"'), ("div", ' class="paywall subscribe"'), ("div", ' class="popup modal"'), ("div", ' role="alert"'), ("div", ' role="dialog"')],
    "form": [("form", ""), ("form", ' class="search"'), ("form", ' id="login"'), ("div", ' class="form signup"'), ("form", ' class="subscribe"'), ("form", ' class="comment-form"')],
    "comments": [("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'), ("ul", ' class="comments"'), ("ol", ' class="commentlist"'), ("div", ' class="reader-comments discussion"'), ("section", ' id="responses"')],
    "footer": [("footer", ""), ("footer", ' class="site-footer"'), ("div", ' class="footer"'), ("div", ' id="footer"'), ("div", ' class="copyright legal"'), ("div", ' class="bottom"')],
}
STOCK = {
    "nav": "Home|About us|Contact|News|Sports|Archive|Login|Help".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all|Sign up for our newsletter today!|Please enable JavaScript.|Subscribe to read more.".split("|"),
    "form": "Name|E-mail|Search|Submit|Your message|Password|Send".split("|"),
    "comments": "Reply|Leave a comment|Posted by guest|3 comments|Report".split("|"),
    "footer": "&copy; 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Contact".split("|"),
    "ad": "Advertisement|Buy now!|Sponsored|Shop the sale today.".split("|"),
    "sidebar": "Related articles|Most read|Share this|Tags|Follow us".split("|"),
    "header": "Daily News|Welcome|The Blog".split("|"),
}
_SYLLABLES = "an ber cha de el fo gur ha in jo ka lo mi nor ou pra que ri sta ti un ver wo xa yé zü ment tion lich ción".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, set()

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def sentence(self, low: int = 1, high: int = 16) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize() + self.rng.choice(["."] * 8 + ["!", "?", ""])

    def prose(self, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, high)))

    def spoken(self, text: str) -> str:
        """A main text with some inline markup."""
        self.main.add(" ".join(_html.unescape(text).split()))
        words = text.split(" ")
        if self.rng.random() < 0.3:
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(words[i])
        return " ".join(words)

    def body(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{self.spoken(self.sentence(1, 12))}</{h}>")
            if rng.random() < 0.4:
                out[-1] = f"<header>{out[-1]}</header>" if rng.random() < 0.5 else out[-1]
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.70:
                out.append(f"<p>{self.spoken(self.prose(rng.choice([1, 3, 8])))}" + ("</p>" if rng.random() < 0.85 else ""))
            elif kind < 0.78:
                out.append(f"<p><b>{self.spoken(self.prose(3))}<br>")
            elif kind < 0.84:
                out.append(f"<h2>{self.spoken(self.sentence(1, 6))}</h2>")
            elif kind < 0.90:
                out.append("<ul>" + "".join(f"<li>{self.spoken(self.sentence())}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{self.spoken(self.prose(2))}</p></blockquote>")
            elif kind < 0.97:
                out.append("<table><tr>" + "".join(f"<td>{self.spoken(self.word() + self.word())}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>")
            else:
                out.append(self.boiler(rng.choice(["ad", "sidebar", "notice", "form"])))
        return "".join(out)

    def boiler(self, kind: str) -> str:
        rng = self.rng
        tag, attributes = rng.choice(BOILER[kind])
        stock = lambda: rng.choice(STOCK[kind]) if rng.random() < 0.4 else self.sentence(1, 5)
        if kind == "nav" or (kind == "sidebar" and rng.random() < 0.6):
            items = "".join(f'<li><a href="/{self.word()}">{rng.choice([self.word, stock])()}</a></li>' for _ in range(rng.randint(1, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
            inner = (f"<h3>{stock()}</h3>" if kind == "sidebar" and tag != "ul" else "") + inner
        elif kind == "form":
            inner = "".join(rng.choice([f"<label>{stock()}</label><input>", f"<p>{stock()}</p>", f"<button>{stock()}</button>", f"<div>{self.sentence()}</div>"]) for _ in range(rng.randint(1, 4)))
        elif kind == "comments":
            item = "li" if tag in ("ul", "ol") else "div"
            inner = "".join(f'<{item} class="comment">' + rng.choice([f"<p>{self.prose(4)}</p>", f"<b>{self.word()}</b> {self.prose(2)}", f"<h4>{self.word()}</h4><p>{self.prose(3)}</p><p>{stock()}</p>"]) + f"</{item}>" for _ in range(rng.randint(1, 6)))
        else:
            inner = rng.choice([lambda: self.prose(3), stock, lambda: f"<p>{self.prose(3)}</p>", lambda: f"<p>{stock()}</p><p>{self.sentence()}</p>", lambda: f"&copy; {self.word()}.example &middot; {self.prose(2)}", lambda: f"<h2>{stock()}</h2><p>{self.prose(2)}</p>"])()
        return f"<{tag}{attributes}>{inner}</{tag}>"


def training_pages(n: int, seed: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of ``n`` made-up pages."""
    rng = random.Random(seed)
    for _ in range(n):
        w = _Writer(rng)
        before = [k for k in ("header", "nav", "notice", "ad", "form", "sidebar") if rng.random() < 0.45]
        after = [k for k in ("sidebar", "ad", "comments", "form", "notice", "footer", "nav") if rng.random() < 0.45]
        rng.shuffle(before)
        tag, attributes = rng.choice(MAIN_WRAPS)
        body = w.body()
        main = f"<{tag}{attributes}>{body}</{tag}>" if rng.random() < 0.9 else body
        if rng.random() < 0.2:
            main = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}">{main}</div>'
        page = "".join(map(w.boiler, before)) + main + "".join(map(w.boiler, after))
        page = f"<html><head><title>{w.sentence()}</title></head><body>{page}</body></html>"
        if rng.random() < 0.1:
            page = page[: rng.randrange(len(page) // 2, len(page))]
        found = blocks(page)
        if found:
            yield found, np.array([b.text in w.main for b in found], np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The network, trained once per process."""
    made = [(features(b), y) for b, y in training_pages(pages, seed)]
    network = Labeller(seed)
    network.fit(made, epochs, seed)
    return network


def main_texts(pages: list[str | None], network: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    labels = network.label(cut, features)
    return ["\n".join(b.text for b, p in zip(found, ps) if p >= 0.5) for found, ps in zip(cut, labels)]


def extract(pages: DataFrame, *, html: str = "html", out: str = "text", network: Labeller | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the main text of each page. The network has a fixed size and travels with the tasks."""
    network = network or trained()

    def make():
        return lambda batch: {out: main_texts(batch, network)}

    return map_column(pages, html, [T.StructField(out, T.StringType())], make, keep)
