"""Pages with known main text, composed from many site structures: training data for the block labeller.

``compose`` gives a page and the set of its article texts; ``is_main`` finds a parsed block
in it. Of a page that was cut off, or a text that a tag ends early, the block is a
beginning of an article text.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, fields

import numpy as np

_SYLLABLES = "an re ti ou the en ha es in th er st on ed ing ea la que le ion der sch un co mi ra lo do ca ni".split()

MAIN = [("article", ""), ("main", ""), ("article", 'class="post"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'id="main"'), ("div", 'class="post-content"'), ("main", 'role="main"'), ("article", ""), ("article", "")]
NAV = [("nav", ""), ("div", 'class="menu"'), ("div", 'id="navigation"'), ("ul", 'class="nav"'), ("header", ""), ("div", 'class="breadcrumb"'), ("nav", 'class="topbar"'), ("div", 'class="navbar"')]
NOISE = [
    ("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'class="banner"'), ("aside", ""), ("div", 'class="sidebar"'), ("div", 'class="cookie-notice"'), ("div", 'class="cookie"'), ("div", 'id="cookies"'), ("div", 'class="newsletter"'), ("div", 'class="related"'),
    ("section", 'class="related"'), ("div", 'class="share"'), ("div", 'class="social"'), ("div", 'class="promo"'), ("div", 'class="sponsored"'), ("aside", 'class="sidebar"'), ("div", 'class="notice"'), ("div", 'class="popup"'), ("div", 'class="widget"'), ("div", 'class="ads"'), ("div", 'class="advertisement"'),
]
COMMENTS = [("div", 'id="comments"'), ("section", 'class="comments"'), ("div", 'class="comment"'), ("ol", 'class="comment-list"'), ("div", 'class="replies"'), ("section", 'id="comments"')]
FOOT = [("footer", ""), ("div", 'id="footer"'), ("div", 'class="footer"'), ("div", 'class="copyright"'), ("footer", 'class="site-footer"')]
HEAD = [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("header", 'class="site-header"')]


@dataclass(frozen=True)
class Families:
    """Elements that sites wrap each kind of content in."""

    main: list
    nav: list
    noise: list
    comments: list
    foot: list
    head: list

    def half(self, part: int) -> Families:
        """Every second family, from ``part`` on: those that a model trained on the other half has not seen."""
        return Families(**{f.name: getattr(self, f.name)[part::2] for f in fields(self)})


FAMILIES = Families(MAIN, NAV, NOISE, COMMENTS, FOOT, HEAD)
#: Share of elements whose name says nothing about their content.
OPAQUE = 0.2
SMALL = ["Home", "About", "Contact", "Login", "Sign up", "Subscribe", "Menu", "Search", "Privacy policy", "Terms", "Read more", "Share", "Reply", "Next", "Previous", "Advertisement"]
NOTES = ["We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter", "All rights reserved.", "Sign up for updates", "Follow us", "Leave a comment", "Related articles", "Posted by"]


def _words(rng: np.random.Generator, n: int) -> str:
    style = rng.random()
    out = []
    for _ in range(n):
        w = "".join(rng.choice(_SYLLABLES, rng.integers(1, 5)))
        w += "." if rng.random() < 0.1 else "," if rng.random() < 0.06 else ""
        if style < 0.05:
            w += ["###", "***", "&&&", "%%%"][rng.integers(4)]
        elif style < 0.1:
            w = w.upper() + "!!"
        elif style < 0.13:
            w += " |"
        out.append(w)
    text = " ".join(out)
    return text[:1].upper() + text[1:] + ("." if rng.random() < 0.7 else "")


def _some(rng: np.random.Generator) -> int:
    return int(min(160, rng.geometric([0.5, 0.1, 0.03][rng.integers(3)])))


def _wrap(el: tuple[str, str], body: str, rng: np.random.Generator | None = None) -> str:
    """``rng`` gives some elements a name that says nothing, as generated style sheets do."""
    if rng is not None and rng.random() < OPAQUE:
        name = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
        el = ("div" if rng.random() < 0.6 else el[0], f'class="{name}"' if rng.random() < 0.7 else "")
    return f"<{el[0]}{' ' if el[1] else ''}{el[1]}>{body}</{el[0]}>"


def _pick(rng: np.random.Generator, options: list):
    return options[rng.integers(len(options))]


def _links(rng: np.random.Generator) -> str:
    items = [(_pick(rng, SMALL) if rng.random() < 0.4 else _words(rng, 1 + int(rng.integers(3)))) for _ in range(rng.integers(1, 9))]
    kind = rng.random()
    if kind < 0.6:
        return "<ul>" + "".join(f'<li><a href="/x">{html.escape(x)}</a></li>' for x in items) + "</ul>"
    return "".join(f'<a href="/x">{html.escape(x)}</a> ' for x in items)


def _plain(rng: np.random.Generator) -> str:
    text = _pick(rng, NOTES) if rng.random() < 0.4 else _words(rng, _some(rng))
    kind = rng.random()
    return html.escape(text) if kind < 0.4 else f"<p>{html.escape(text)}</p>"


def _noise(rng: np.random.Generator, by: Families) -> str:
    kind = rng.random()
    if kind < 0.12:
        return f'<form action="/s"><label>{_pick(rng, SMALL)}</label><input name="q"><button>{_pick(rng, SMALL)}</button></form>'
    body = _links(rng) if rng.random() < 0.35 else "".join(_plain(rng) for _ in range(rng.integers(1, 3)))
    if rng.random() < 0.2:
        body = f"<h3>{html.escape(_words(rng, 3))}</h3>" + body
    return _wrap(_pick(rng, by.noise), body, rng)


def _comments(rng: np.random.Generator, by: Families) -> str:
    one = lambda: _wrap(("div", 'class="comment"') if rng.random() < 0.7 else ("li", ""), "".join(f"<p>{html.escape(_words(rng, _some(rng)))}</p>" for _ in range(rng.integers(1, 3))))
    head = f"<h3>{_pick(rng, ['Comments', 'Replies', 'Leave a comment'])}</h3>" if rng.random() < 0.5 else ""
    return _wrap(_pick(rng, by.comments), head + "".join(one() for _ in range(rng.integers(1, 5))), rng)


def _main(rng: np.random.Generator, truth: set[str], by: Families) -> str:
    def said(n: int) -> str:
        text = _words(rng, n)
        truth.add(" ".join(text.split()))
        return html.escape(text)

    parts = []
    if rng.random() < 0.85:
        head = f"<h1>{said(int(rng.integers(2, 12)))}</h1>"
        parts.append(f"<header>{head}</header>" if rng.random() < 0.1 else head)
    for _ in range(int(min(40, rng.geometric(0.12)))):
        kind = rng.random()
        if kind < 0.72:
            parts.append(f"<p>{said(_some(rng))}</p>")
        elif kind < 0.8:
            parts.append(f"<p><b>{said(_some(rng))}<br>")
        elif kind < 0.86:
            parts.append(f"<h2>{said(int(rng.integers(1, 7)))}</h2>")
        elif kind < 0.91:
            parts.append("<ul>" + "".join(f"<li>{said(_some(rng))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
        elif kind < 0.94:
            parts.append(f"<blockquote>{said(_some(rng))}</blockquote>")
        elif kind < 0.96:
            parts.append("<table>" + "".join(f"<tr><td>{said(2)}</td><td>{said(2)}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.98:
            parts.append(f"<pre>{said(5)}</pre>")
        elif rng.random() < 0.5:
            parts.append(_noise(rng, by))
    body = "".join(parts)
    if rng.random() < 0.15:
        body += _comments(rng, by)
    body = _wrap(_pick(rng, by.main), body, rng)
    if rng.random() < 0.3:
        body = _wrap(_pick(rng, [("main", ""), ("div", 'class="wrapper"'), ("div", 'id="page"'), ("div", 'class="container"')]), body)
    return body


def compose(rng: np.random.Generator, by: Families = FAMILIES) -> tuple[str, set[str]]:
    """A page and the texts of its article blocks."""
    truth: set[str] = set()
    main = _main(rng, truth, by)
    before, after = [], []
    if rng.random() < 0.4:
        before.append(_wrap(_pick(rng, by.head), _plain(rng) + (_wrap(_pick(rng, by.nav), _links(rng)) if rng.random() < 0.5 else "")))
    if rng.random() < 0.8:
        before.append(_wrap(_pick(rng, by.nav), _links(rng), rng))
    for _ in range(rng.integers(0, 3)):
        before.append(_noise(rng, by))
    for _ in range(rng.integers(0, 3)):
        after.append(_noise(rng, by))
    if rng.random() < 0.3:
        after.append(_comments(rng, by))
    if rng.random() < 0.85:
        after.append(_wrap(_pick(rng, by.foot), ("&copy; " if rng.random() < 0.6 else "") + (_links(rng) if rng.random() < 0.3 else _plain(rng)), rng))
    page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"
    if rng.random() < 0.1:
        page = page[: int(len(page) * (0.5 + rng.random() / 2))]
    return page, truth


def is_main(text: str, truth: set[str]) -> bool:
    return text in truth or any(t.startswith(text) for t in truth)
