"""Blocks of pages with drawings, formulas, fallbacks and custom elements."""

import pytest

from corvane.llm import html_text


def texts(page):
    return [b.text for b in html_text.blocks(page)]


@pytest.mark.parametrize("element", ["<svg width='1'/>", "<math/>", "<object>", "<canvas id=c>", "<svg><path d='M0'/></svg>", "<iframe src=x></iframe>", "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<template-card>", "<script-x/>", "<style-x>"])
def test_an_element_takes_no_text_with_it(element):
    assert texts(f"<p>one</p>{element}<p>two</p><svg></svg><math></math><object></object><canvas></canvas><p>three</p>") == ["one", "two", "three"]


@pytest.mark.parametrize("name", ["noscript", "math", "object", "canvas", "iframe", "svg"])
def test_text_inside_is_kept_in_its_line(name):
    assert texts(f"<div>before <{name}>inside</{name}> after</div>") == ["before inside after"]
    assert texts(f"<{name}><p>one</p><p>two</p></{name}>") == ["one", "two"]


def test_raw_elements_are_no_text():
    page = "<title>t</title><SCRIPT >var a</script><style\n>b</style><template/>c</template><p>x <svg><title>icon</title><path d='M0'/></svg>y <math><mi>a</mi><mo>=</mo><mn>1</mn></math></p><script>end"
    assert texts(page) == ["x y a=1"]


def test_words_of_a_whole_block_are_features():
    def hashed(text):
        x = html_text.features([html_text.Block((), text, 0)])[0]
        return x[html_text.PATH_TERMS : html_text.PATH_TERMS + html_text.WORD_TERMS]

    ends = "aa " * 100
    assert hashed(ends + "aa " * 100 + ends).nonzero()[0].size == 1
    assert hashed(ends + "bb " * 100 + ends)[html_text._hash("bb", html_text.WORD_TERMS)] > 0
