"""Main text of web pages: a recurrent labeller over the page's sequence of text blocks.

A page is cut into leaf blocks (runs of text that no block-level tag interrupts).
Each block becomes a vector of its tag path (tags, class and id words, hashed), its
words (hashed) and a few measures; a bidirectional LSTM in numpy reads the page's
whole sequence and decides for each block, in the light of all others, whether it
is article text. The model is trained once per process, in seconds and from a
fixed seed, on pages that ``layouts`` composes from many site structures; it is
some hundred kilobytes and travels with the task.

One pass, no shuffle. Pages of like length go through the model together, at most
``CELLS`` blocks at once; a longer page goes through alone, in slices that hand the
state on, so memory doesn't grow with the number of blocks times the vector. Edge cases: null or empty html gives the empty text; a page
cut off anywhere is read as far as it goes; scripts, styles, templates, titles,
markup and HTML comments are never text, and what stands inside any other element
(svg, math, iframe, noscript, object, canvas, custom elements) is judged as text;
nothing is capped, and a very long block or page is read whole; repeated rows give
equal results; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH_TERMS, WORD_TERMS, MEASURES = 96, 64, 10
INPUTS = PATH_TERMS + WORD_TERMS + MEASURES
HIDDEN = 20
#: Blocks that go through the model at once.
CELLS = 1 << 14

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?A-Za-z][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"\w+")

#: Elements that run inside a line of text, and those that have no content.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Drawings and formulas, and what stands for a thing that isn't shown, are part of the line as well.
INLINE |= set("svg g path circle ellipse line rect polygon polyline use defs symbol desc text tspan".split())
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded semantics annotation".split())
INLINE |= set("iframe noscript object canvas".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag on the left closes open ones on the right, up to the nearest block around them.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Block:
    path: tuple[str, ...]  # tags and names, outermost first
    text: str
    linked: int  # code points inside links


@functools.lru_cache(maxsize=4096)
def _names(attrs: str) -> tuple[str, ...]:
    return tuple(sorted({w.lower() for m in _NAMES.finditer(attrs) for w in _PART.findall(m[1] or m[2] or m[3] or "")}))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: white space is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(x for tag, names in stack for x in (tag, *names) if tag not in INLINE)
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tags: set[str], fence: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in fence:
                return

    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            text = html_lib.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m["end"] else 1))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        links = 0
        if m["end"]:
            close({tag}, set())
            continue
        if tag in _ENDS_P:
            close({"p"}, {"div", "section", "article", "td", "li", "blockquote", "body"})
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "dl", "table"})
        if not m["attrs"].endswith("/"):
            stack.append((tag, _names(m["attrs"])))
    flush()
    return out


@functools.lru_cache(maxsize=65536)
def _hash(term: str, size: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=4096)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_TERMS, np.float32)
    for x in path:
        v[_hash(x, PATH_TERMS)] = 1
    if path:
        v[_hash("last:" + path[-1], PATH_TERMS)] = 1
    return v


def features(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """Vectors of the blocks ``first`` to ``last`` - 1 of a page."""
    some = page[first:last]
    x = np.zeros((len(some), INPUTS), np.float32)
    for k, b in enumerate(some):
        x[k, :PATH_TERMS] = _path_vector(b.path)
        n = len(b.text)
        for m in _WORD.finditer(b.text):
            x[k, PATH_TERMS + _hash(m[0].lower(), WORD_TERMS)] += 1
        words = max(1, b.text.count(" ") + 1)
        dots = sum(map(b.text.count, ".!?"))
        x[k, -MEASURES:] = (
            math.log1p(n) / 8,
            math.log1p(words) / 6,
            b.linked / n,
            min(1.0, dots / words * 4),
            b.text[-1:] in ".!?",
            "©" in b.text,
            (first + k) / len(page),
            1 / (1 + first + k),
            len(b.path) / 10,
            len(page) < 4,
        )
    w = x[:, PATH_TERMS : PATH_TERMS + WORD_TERMS]
    np.divide(w, np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1), out=w)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each step; parameters are plain arrays."""

    def __init__(self, rng: np.random.Generator, inputs: int = INPUTS, hidden: int = HIDDEN):
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[d + "w"] = (rng.normal(size=(inputs, 4 * hidden)) / math.sqrt(inputs)).astype(np.float32)
            self.p[d + "u"] = (rng.normal(size=(hidden, 4 * hidden)) / math.sqrt(hidden)).astype(np.float32)
            self.p[d + "c"] = np.zeros(4 * hidden, np.float32)
            self.p[d + "c"][hidden : 2 * hidden] = 1
        self.p["o"] = (rng.normal(size=(2 * hidden + inputs,)) * 0.05).astype(np.float32)
        self.p["oc"] = np.zeros(1, np.float32)

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        steps, n, _ = x.shape
        size = self.hidden
        z_in = x @ self.p[d + "w"] + self.p[d + "c"]
        h, c = state or (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
        out, tape = np.zeros((steps, n, size), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[d + "u"]
            i, f, o = (_sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
            g = np.tanh(z[:, 3 * size :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            h_new = o * tc
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, h_new, h)
            out[t] = h
        return out, tape, (h, c)

    def _output(self, *parts: np.ndarray) -> np.ndarray:
        return _sigmoid(np.concatenate(parts, axis=2) @ self.p["o"] + self.p["oc"][0])

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: steps, pages, inputs. Probability that a block is article text, for each step and page."""
        f, tf, _ = self._scan(x, mask, "f", keep)
        b, tb, _ = self._scan(x, mask, "b", keep)
        p = self._output(f, b, x)
        return (p, np.concatenate([f, b, x], axis=2), tf, tb) if keep else p

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, joined, tf, tb = self.forward(x, mask, True)
        size = self.hidden
        dz = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        g = {"o": np.tensordot(dz, joined, ([0, 1], [0, 1])), "oc": dz.sum(keepdims=True).reshape(1)}
        dh_all = dz[:, :, None] * self.p["o"]
        for d, tape, dh_out in (("f", tf, dh_all[:, :, :size]), ("b", tb, dh_all[:, :, size : 2 * size])):
            dw, du, dc0 = (np.zeros_like(self.p[d + k]) for k in "wuc")
            dh, dc = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][1])
            for t, h, c, i, f, o, gg, tc, m in reversed(tape):
                dh = dh + dh_out[t]
                dhm, dcm = dh * m, dc * m
                dcn = dcm + dhm * o * (1 - tc * tc)
                dzz = np.concatenate([dcn * gg * i * (1 - i), dcn * c * f * (1 - f), dhm * tc * o * (1 - o), dcn * i * (1 - gg * gg)], axis=1)
                dw += x[t].T @ dzz
                du += h.T @ dzz
                dc0 += dzz.sum(axis=0)
                dh = dzz @ self.p[d + "u"].T + dh * ~m
                dc = dcn * f + dc * ~m
            g |= {d + "w": dw, d + "u": du, d + "c": dc0}
        return g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probabilities for the blocks of each page; pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            if len(pages[order[-1]]) > CELLS:
                k = order.pop()
                out[k] = self._alone(pages[k])
                continue
            n = max(1, CELLS // len(pages[order[-1]]))
            some, order = order[-n:], order[:-n]
            x, mask = _padded([features(pages[k]) for k in some])
            p = self.forward(x, mask)
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
        return out

    def _alone(self, page: list[Block]) -> np.ndarray:
        """The same for one long page, ``CELLS`` blocks at a time: forwards, then backwards."""
        cuts = [(a, min(len(page), a + CELLS)) for a in range(0, len(page), CELLS)]
        ahead, state = [], None
        for a, b in cuts:
            out, _, state = self._scan(features(page, a, b)[:, None], np.ones((b - a, 1), bool), "f", False, state)
            ahead.append(out)
        p, state = np.zeros(len(page), np.float32), None
        for (a, b), f in zip(reversed(cuts), reversed(ahead), strict=True):
            x = features(page, a, b)[:, None]
            back, _, state = self._scan(x, np.ones((b - a, 1), bool), "b", False, state)
            p[a:b] = self._output(f, back, x)[:, 0]
        return p


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, True
    return x, mask


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1000, rounds: int = 14, seed: int = 11, part: int | None = None) -> Labeller:
    """The model, fitted by Adam to composed pages; ``part`` leaves out every second layout family."""
    from corvane.llm import layouts

    rng = np.random.default_rng(seed)
    model = Labeller(rng)
    families = layouts.FAMILIES if part is None else layouts.FAMILIES.half(part)
    data = []
    for _ in range(pages):
        page, truth = layouts.compose(rng, families)
        found = blocks(page)
        data.append((features(found), np.array([layouts.is_main(b.text, truth) for b in found], np.float32)))
    data = sorted((d for d in data if len(d[0])), key=lambda d: len(d[0]))
    groups = [data[k : k + 24] for k in range(0, len(data), 24)]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for r in range(rounds):
        for k in rng.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, d in enumerate(groups[k]):
                y[: len(d[1]), j] = d[1]
            step += 1
            rate = 0.012 * (1 - r / rounds) + 0.001
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.99 * s[name] + 0.01 * g * g
                model.p[name] = (model.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = model.label(found)
    return ["\n".join(b.text for b, p in zip(f, ps, strict=True) if p >= 0.5) for f, ps in zip(found, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = main_texts(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
