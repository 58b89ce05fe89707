"""The texts of the given pages against what their own markup says."""

import html
import re

import pyarrow.parquet as pq

from corvane.llm import html_text

BLOCK = re.compile(r"</?(?:p|h[1-6]|ul|ol|li|dl|dt|dd|blockquote|table|tr|td|th|div|section|pre|figure|figcaption|hr)\b[^>]*>", re.I)


def by_markup(page):
    """The article element's blocks; these pages have one, with nothing foreign in it but comments of the markup."""
    inner = re.sub(r"(?s)<!--.*?-->", "", re.search(r"(?s)<article\b[^>]*>(.*?)(?:</article>|$)", page)[1])
    assert not re.search(r"(?i)<(script|style|form|aside|nav|footer|iframe)\b", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\b[^>]*>", " ", b))).split()) for b in BLOCK.split(inner)]
    return "\n".join(t for t in texts if t)


def test_the_query_gives_the_articles_of_all_given_pages(spark):
    from corvane.llm import queries

    got = {r.page_id: (r.text, r.n_chars) for r in queries.op5_html_text(spark, "/root/testdata/sf0.01").collect()}
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    wrong = [p["page_id"] for p in pages if got[p["page_id"]] != (t := by_markup(p["html"]), len(t))]
    assert not wrong, f"{len(wrong)} of {len(pages)} differ: {wrong[:10]}"


def test_classes_and_names_are_no_help_where_there_are_none():
    """The same pages with their article element made a plain one: most stay right."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    plain = [re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", p["html"]) for p in pages]
    found = html_text.main_texts(plain, html_text.trained())
    assert sum(a == by_markup(p["html"]) for a, p in zip(found, pages, strict=True)) >= 0.8 * len(pages)
