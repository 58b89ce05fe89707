"""Hand-written pages of sites unlike the composed ones, held-out layout families, and pages of great length."""

import numpy as np
import pytest

from corvane.llm import html_text, layouts

P1 = "The harbour council met on Tuesday to decide whether the old pier should be repaired before the winter storms arrive."
P2 = "Most of the fishermen who spoke at the meeting said that they would rather wait until the spring, when the prices of timber usually fall."
P3 = "A final vote is expected next month, after the engineers have finished their survey of the foundations."
H = "Council weighs repair of the old pier"

#: Markup with [[ ]] around what is to be extracted.
PAGES = {
    "news": f"<body><div id='cookie-consent'><p>We value your privacy.</p><button>Accept</button></div><header class='masthead'><a href='/'>Harbour Times</a><nav><a href='/a'>World</a> <a href='/b'>Sport</a></nav></header>"
    f"<main><article class='story'><h1>[[{H}]]</h1><p>[[{P1}]]</p><p>[[{P2}]]</p><p>[[{P3}]]</p></article><aside class='related'><h3>More stories</h3><ul><li><a href='/1'>Ferry timetable changes</a></li></ul></aside></main><footer>&copy; 2024 Harbour Times</footer></body>",
    "blog": f"<body><div class='header'><h2><a href='/'>My notes</a></h2></div><div class='post hentry'><h1>[[{H}]]</h1><div class='entry-content'><p>[[{P1}]]</p><blockquote>[[{P2}]]</blockquote><p>[[{P3}]]</p></div></div>"
    f"<div id='comments'><h3>2 Comments</h3><div class='comment'><p>Great write-up, thank you for posting this long report about the pier.</p></div></div><div class='footer'>Powered by a blog engine</div></body>",
    "docs": f"<body><nav class='sidebar'><ul><li><a href='/i'>Install</a></li><li><a href='/u'>Usage</a></li></ul></nav><main role='main'><h1>[[{H}]]</h1><p>[[{P1}]]</p><pre>[[make survey --all]]</pre><h2>[[Next steps]]</h2><p>[[{P3}]]</p></main><footer><a href='/p'>Privacy</a></footer></body>",
    "bare divs": f"<body><div><a href='/'>Home</a> <a href='/x'>Archive</a> <a href='/y'>About</a></div><div><div>[[{P1}]]</div><div>[[{P2}]]</div><div>[[{P3}]]</div></div><div>Copyright 2024. All rights reserved.</div></body>",
    "generated names": f"<body><div class='x7f9a'><a href='/'>Start</a><a href='/n'>News</a></div><div class='q1w2e'><h1>[[{H}]]</h1><p>[[{P1}]]</p><p>[[{P2}]]</p></div><div class='zz81k'><p>Subscribe to our newsletter</p></div></body>",
    "tables": f"<body><table><tr><td><a href='/'>Home</a><br><a href='/m'>Map</a></td><td><h1>[[{H}]]</h1><p>[[{P1}]]</p><p>[[{P2}]]</p></td></tr></table></body>",
    "recipe": f"<body><header><a href='/'>Kitchen</a></header><article><h1>[[Bread of the harbour]]</h1><p>[[{P2}]]</p><ul><li>[[500 g of flour]]</li><li>[[300 ml of water]]</li></ul><ol><li>[[Mix everything in a large bowl and let it rest for an hour.]]</li></ol></article><div class='share'><a href='/s'>Share</a></div></body>",
    "wiki": f"<body><div id='navigation'><ul><li><a href='/m'>Main page</a></li><li><a href='/r'>Random</a></li></ul></div><div id='content'><h1>[[{H}]]</h1><div id='bodyContent'><p>[[{P1}]]</p><h2>[[History]]</h2><p>[[{P2}]]</p><p>[[{P3}]]</p></div></div><div id='footer'>This page was last edited in May.</div></body>",
    "advert inside": f"<body><article><h1>[[{H}]]</h1><p>[[{P1}]]</p><div class='ad'><p>Buy timber now</p></div><p>[[{P2}]]</p><form><label>E-mail</label><button>Sign up</button></form><p>[[{P3}]]</p></article></body>",
    "other language": "<body><nav><a href='/'>Start</a> <a href='/k'>Kontakt</a></nav><article><h1>[[Der alte Pier wird geprüft]]</h1><p>[[Am Dienstag beriet der Rat darüber, ob der alte Pier noch vor den Winterstürmen ausgebessert werden soll.]]</p><p>[[Die meisten Fischer wollen lieber bis zum Frühjahr warten, wenn das Holz billiger ist.]]</p></article><footer>Impressum</footer></body>",
    "unclosed": f"<body><nav><ul><li><a href=/>Home<li><a href=/b>Blog</ul></nav><article><h1>[[{H}]]</h1><p>[[{P1}]]<p>[[{P2}]]<p>[[{P3}]]</article><footer>&copy; someone</footer>",
    "notice after": f"<body><section class='story'><h1>[[{H}]]</h1><p>[[{P1}]]</p><p>[[{P3}]]</p></section><section class='comments'><p>I was there on Tuesday and nobody asked the fishermen.</p></section><div class='cookie-notice'>This site uses cookies.</div></body>",
}


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


def marked(page):
    """Blocks of a page and which of them are marked."""
    found = html_text.blocks(page)
    truth = [b.text.startswith("[[") for b in found]
    return html_text.blocks(page.replace("[[", "").replace("]]", "")), truth


def test_blocks_of_hand_written_pages(model):
    right, total, lost = 0, 0, {}
    for name, page in PAGES.items():
        found, truth = marked(page)
        got = model.label([found])[0] >= 0.5
        right, total = right + int((got == truth).sum()), total + len(truth)
        missed = [b.text for b, g, t in zip(found, got, truth, strict=True) if g != t]
        if missed:
            lost[name] = missed
    assert right / total >= 0.93, lost


def test_families_that_were_never_seen(model):
    half = html_text.trained(part=0)
    rng = np.random.default_rng(31)
    right = total = 0
    for _ in range(80):
        page, truth = layouts.compose(rng, layouts.FAMILIES.half(1))
        found = html_text.blocks(page)
        y = np.array([layouts.is_main(b.text, truth) for b in found], bool)
        right, total = right + int(((half.label([found])[0] >= 0.5) == y).sum()), total + len(y)
    assert right / total > 0.95


def test_a_long_page_goes_through_in_slices(model, monkeypatch):
    page = [html_text.Block(("div", "p") if k % 50 else ("nav", "a"), f"Some words of block {k}, and more.", 0) for k in range(3000)]
    whole = model.label([page])[0]
    monkeypatch.setattr(html_text, "CELLS", 256)
    sliced = model.label([page, page[:40]])
    assert np.abs(sliced[0] - whole).max() < 1e-5 and len(sliced[1]) == 40


def test_memory_of_a_huge_page_is_bounded(model, monkeypatch):
    """No array with all blocks' vectors is made, however many blocks a page has."""
    most = []
    inner = html_text.features
    monkeypatch.setattr(html_text, "features", lambda page, first=0, last=None: most.append((len(page) if last is None else last) - first) or inner(page, first, last))
    page = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    text = html_text.main_texts([page, None, "<p>x</p>"] + ["<p>a</p><p>b</p>" * 30] * 300, model)
    assert max(most) <= html_text.CELLS and len(text) == 303
    assert text[0].count("word") in (0, 100_000) or text[0].count("word") > 90_000


def test_the_middle_of_a_long_block_counts():
    ends = "and some words of an article. " * 20
    one, other = (html_text.features([html_text.Block(("p",), ends + w * 50 + ends, 0)])[0] for w in ("cookies ", "harbour "))
    assert (one != other).any()
