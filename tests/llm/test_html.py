import re
from html import unescape

import pytest

from siftwork.llm import html_extract as he
from siftwork.llm.html_training import Maker
from siftwork.llm.html_tree import TOKENS, Page, decode, features, main_text


@pytest.fixture(scope="module")
def trees(spark):
    return he.train(spark, pages=500)


def test_held_out_pages(trees):
    """Pages of other seeds: most texts come out exactly, and most blocks are right."""
    exact = right = n = 0
    for seed in range(50_001, 50_121):
        html, main = Maker(seed).page()
        wanted = [re.sub(r"\s+", " ", m).strip() for m in main]
        got = he.extract(html, trees).split("\n")
        exact += got == wanted
        right += len(set(got) & set(wanted))
        n += len(set(got) | set(wanted))
    assert exact >= 0.75 * 120 and right >= 0.95 * n


def test_tables_pages(spark, trees):
    """The driver's pages: headings and paragraphs of the article, whatever is broken in them."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html).group(1)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:h1|p)>", body)]
        assert he.extract(r.html, trees) == "\n".join(filter(None, blocks))


def test_parsing():
    html = "<body><div>a <b>b</b>&amp;\n c<br>d<p>e<p>f<ul><li>g<li>h</ul><script>x</script><!-- y --><table><tr><td>i<td>j</table><style>k</style>l<select><option>m</select></div>"
    page = Page(html)
    assert [t for _, t in page.blocks] == ["a b& c d", "e", "f", "g", "h", "i", "j", "l"]
    assert features(page).shape[0] == len(page.tags)
    for broken in ("", "<", "<p", "</p></p>", "<a<b>", "<script>never ends", "&#xFFFFFFF; &bogus;", "<div " * 50, "<p>" * 3000):
        Page(broken)


def test_heads_and_long_attributes():
    """A head ends at its end tag, at a tag that cannot stand in it, or at text; attribute tokens count wherever they stand."""
    for html in ("<head><title>t</title><p>a</p>", "<head><meta charset=x><body><p>a", "<head><script>x</script>a", "<head><style>x</style></head><p>a"):
        assert [t for _, t in Page(html).blocks] == ["a"]
    page = Page(f'<div class="{"x1 " * 400}sidebar">a</div>')
    assert page.kinds[1][list(TOKENS).index("side")] == 1


def test_grouped_pages_equal_single_ones(trees):
    """Pages scored together come out as they do alone, in order."""
    pages = [Maker(seed).page()[0] for seed in range(60_000, 60_040)] + ["", "<p>" * 5000 + "a"]
    assert list(he.extract_all(iter(pages), trees)) == [he.extract(p, trees) for p in pages]


def test_decoding_is_consistent():
    page = Page("<div><p>a</p><p>b</p></div><section><p>c</p></section>")
    names = dict(zip(page.tags, range(len(page.tags)), strict=False))
    odds = [0.0] * len(page.tags)
    odds[names["div"]], odds[names["section"]] = -1.0, -5.0
    for i, t in enumerate(page.tags):
        if t == "p":
            odds[i] = 2.0
    import numpy as np

    kept = decode(page, np.array(odds))
    assert main_text(page, kept) == "a\nb"
    assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_edges(spark, trees):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<nav><a href=/>x</a></nav>", "x"), (3, "u", "<article><h1>T</h1><p>" + "Long words here. " * 3000 + "</p></article>", "x")]
    rows += [rows[-1]]
    out = he.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), trees).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, None)] == ["", ""]
    assert [r.n_chars for r in out if r.page_id == 3] == [len("T\n" + ("Long words here. " * 3000).strip())] * 2
    assert he.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), trees).count() == 0
