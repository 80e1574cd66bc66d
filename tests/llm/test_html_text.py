"""Main text of pages: hosts with and without telling markup, damaged markup, copies, and the given pages by rule."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import html_text
from shelfwise.llm.html_text import Page, extract_text

WORDS = "river stone market paper signal garden winter bridge copper letter window harbor silver meadow".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n)) + f" {seed}."


def labelled(source):
    """The text with named presentation left out, as where a host is too small to tell."""
    p = Page(source)
    return p.text({q for q, w in zip(p.paths(), p.weight) if w == 0.5})


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>a<p>b <b>c</b>d<br>e</p>tail", "a b cd e tail"),
        ("<article><h1>T</h1><p><b>x y<br><p>z</p></article><footer>f</footer>", "T x y z"),
        ("<body><nav><ul><li><a href=/>m</a></ul></nav><main><p>x &amp; y&nbsp;&#8212;  z</p><form>q</form></main><aside>s</aside></body>", "x & y — z"),
        ("<header>Site<h1>Name</h1></header><article><header><h1>Title</h1></header><p>x</p><section id=comments><article><p>nice</p></article></section></article>", "Title x"),
        ("<div class='cookie-notice'>we use</div><div id=content><p>x</p><div class=shareButtons>share</div></div><div class=siteFooter>f</div>", "x"),
        ("<div class=content-with-sidebar><article>x<div class=ad-slot>buy</div></article><div class=left-sidebar>s</div></div>", "x"),
        ("<form action=/><article><p>x</p></article></form>", "x"),
        ("<div class=ad>buy<article><p>x</p></article>", "x"),
        ("<script>var t='</p><article>no</article>';</script><style>p{}</style><p>x</p><!-- no --><noscript>no</noscript><textarea>no</textarea>", "x"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul><pre>f\n  g</pre></article>", "a b c d e f g"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>1 < 2 &lt; 3 &unknown; &am", "1 < 2 < 3 &unknown; &am"),
        ("<article><p title=\"a>b\" data-x='it''s'>x</p></article><!-- open", "x"),
        ("<p>x</p><script>open", "x"),
        ("<article><p>x</p></article>beside<div>more</div>", "x"),
        ("<div><p>text that is long</p></div><div><a href=1>one</a> <a href=2>two</a></div>", "text that is long"),
        ("<ARTICLE><P CLASS=Comment>no</P><P>Yes</P></ARTICLE>", "Yes"),
    ],
)
def test_named_presentation(source, text):
    assert labelled(source) == text


def unnamed(i, body, host="h.example"):
    """A page whose markup tells nothing: boxes of the same kinds for all."""
    # of each box, texts come from a few that the host repeats
    return (
        i, f"https://{host}/{i}",
        f"<html><body><div class=b1><span>{prose(3, i % 2)}</span><p>Home and more</p></div><div class=b2><h1>{prose(2, 1000 + i)}</h1>{body}</div><div class=b3><p>All rights {i % 3}</p><p>Write to us</p></div></body></html>",
    )


def body(i):
    return "".join(f"<p>{prose(12, 5000 + 10 * i + k)}</p>" for k in range(1 + i % 3))


@pytest.mark.parametrize("most", [200_000, 0])
def test_repeated_branches_of_a_host_go(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST_NODES", most)  # the tree in every task, or joined
    rows = [unnamed(i, body(i)) for i in range(30)]
    # a host of copies and near copies: their text is no template
    rows += [unnamed(100 + i, f"<p>{prose(40, 9)}</p>" + (f"<p>{prose(5, i)}</p>" if i % 2 else ""), "copies.example") for i in range(24)]
    # hosts of a page each take what their paths are elsewhere
    rows += [unnamed(200 + i, body(50 + i), f"single{i}.example") for i in range(3)]
    rows += [(300, None, None), (301, "no address", ""), (None, "https://x.example", "<p>null id</p>"), (302, "https://h.example/1", "<script></script>"), (0, *unnamed(0, body(0))[1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "k1", "path", "removed", "text", "digest")}).repartition(5)
    out = extract_text(df)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}

    def main(row):
        inner = re.search(r"<div class=b2>(.*?)</div>", row[2])[1]
        return " ".join(x for x in re.split(r"<[^>]*>", inner) if x)

    for row in [*rows[:30], *rows[54:57]]:
        assert text[row[:2]] == main(row)
    for row in rows[30:54]:
        assert main(row) in text[row[:2]]
    assert (text[300, None], text[301, "no address"], text[None, "https://x.example"], text[302, "https://h.example/1"]) == ("", "", "null id", "")
    assert extract_text(df.filter("false")).collect() == []


def test_given_pages_by_rule(spark):
    """Whole articles of the given table, cut out by its one layout."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want[r["page_id"]] = " ".join(filter(None, (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inner))))
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == want


def test_long_page_is_linear():
    source = "<article>" + "<p>some words & more</p>" * 50_000 + "<div " * 20_000 + "</article>"
    assert len(labelled(source)) == 50_000 * 18 - 1
