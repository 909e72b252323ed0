import numpy as np
import pytest

from driftscope.llm import extraction
from driftscope.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def model():
    return extraction.train()


@pytest.mark.parametrize("page, texts", [
    ("<p>a<p>b<b>c</b> d<br>e</p>", ["a", "bc d e"]),
    ("<ul><li>a<li>b &amp; c&nbsp;d</ul>t", ["a", "b & c d", "t"]),
    ("<script>x='</p>'</script><p title='a>b'>c<!-- <p>no</p> -->d", ["cd"]),
    ("<STYLE>p{}</style ><title>t</title><div>a &#xe9; &unknown; &lt</DIV>", ["a é &unknown; <"]),
    ("a < b <3 <p", ["a < b <3"]), ("</p></div>x</nav>", ["x"]), ("<p></p> \n ", []), ("", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<script>never closed <p>x", []),
    ("<article><p>one</p><svg>\u2026<p>two</p></article>", ["one", "\u2026", "two"]), ("a <math>x</math> b", ["a x b"]),
    ("<object>fallback</object>", ["fallback"]), ("<template><p>a</template>b<svg/>c", ["a", "bc"]),
    ("<p>one<object data=x><p>two<math><mi>y</mi>", ["one", "twoy"]),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_paths():
    page = '<div class="sideBar wide-2" id=x><ul><li><a href="/">home</a> more</ul></div><p>end'
    first, last = blocks(page)
    assert first.path == ("div side bar wide x", "ul", "li") and (first.link_chars, last.path) == (4, ("p",))


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model = extraction.Model([rng.standard_normal((extraction.WIDTH, 4 * extraction.HIDDEN)) * 0.1 for _ in range(2)],
                             [rng.standard_normal((extraction.HIDDEN, 4 * extraction.HIDDEN)) * 0.3 for _ in range(2)],
                             [rng.standard_normal(4 * extraction.HIDDEN) * 0.1 for _ in range(2)],
                             rng.standard_normal(2 * extraction.HIDDEN), np.zeros(1))
    x = rng.standard_normal((3, 5, extraction.WIDTH))
    length, label = np.array([5, 3, 1]), (rng.random((3, 5)) > 0.5).astype(float)
    _, gradient = extraction._gradients(model, x, length, label)
    for parameter, own in zip(model.parameters(), gradient):
        at = tuple(rng.integers(0, s) for s in parameter.shape)
        before, step = parameter[at], 1e-2
        losses = []
        for value in (before + step, before - step):
            parameter[at] = value
            losses.append(extraction._gradients(model, x, length, label)[0])
        parameter[at] = before
        assert own[at] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=2e-3)


def test_held_out_pages(model):
    pages = extraction.labelled_pages(150, seed=4321)
    wrong = sum(int((got != (want > 0)).sum()) for got, (_, want) in
                zip(extraction.label(model, [v for v, _ in pages]), pages))
    assert wrong / sum(len(y) for _, y in pages) < 0.02


def test_given_pages(spark, model):
    """The article of every given page, as its markup says."""
    import html
    import re
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert extraction.extract(model, [row.html]) == ["\n".join(p for p in parts if p)]


def test_odd_pages(spark, model):
    article = "<article>" + "".join(f"<p>{'words of a long article ' * 30}{i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (3, "u", "<p>"), (None, None, article), (5, "u", "<nav><a>x</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS main")
    found = extraction.main_text(pages)
    assert found.columns == pages.columns
    texts = {r.page_id: r.text for r in found.collect()}
    assert [texts[i] for i in (1, 2, 3, 5)] == ["", "", "", ""]
    assert texts[None].count("\n") == 2999
    assert extraction.main_text(pages.where("false")).count() == 0


def test_side_by_side_equals_one_by_one(model):
    pages = [v for v, _ in extraction.labelled_pages(40, seed=77)]
    together, alone = extraction.label(model, pages), [extraction.label(model, [p])[0] for p in pages]
    assert all((a == b).all() for a, b in zip(together, alone))
