"""Main-text extraction on pages that no rule of the library made, and its inference against full enumeration."""

import itertools
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import html_extract as H

#: (name, page, the text blocks that are its article), written by hand.
PAGES = [
    ("bare body", "<body><p>The ferry left at nine, as it always does.</p><p>By noon the fog had lifted, and we could see the far shore.</p></body>", ["The ferry left at nine, as it always does.", "By noon the fog had lifted, and we could see the far shore."]),
    ("layout table", "<html><body><table><tr><td><a href='/'>Home</a> <a href='/news'>News</a> <a href='/us'>About us</a></td><td><p>Rain fell on the valley for six days, and the river rose.</p><p>On the seventh day people began to sweep out their houses.</p></td></tr></table></body></html>", ["Rain fell on the valley for six days, and the river rose.", "On the seventh day people began to sweep out their houses."]),
    ("unnamed divs", "<body><div><ul><li><a href=/a>Start</a></li><li><a href=/b>Shop</a></li></ul></div><div><h1>How to prune roses</h1><p>Wait until the last frost is over, then cut above a bud.</p><p>Use sharp shears. A clean cut heals faster.</p></div><div>Copyright 2020 <a href=/c>Imprint</a></div></body>", ["How to prune roses", "Wait until the last frost is over, then cut above a bud.", "Use sharp shears. A clean cut heals faster."]),
    ("compound names", "<body><article><h1>Study results</h1><p>We asked four hundred people, and most agreed.</p><div class='social-proof-study'><p>They followed the choice of others, even when it was wrong.</p></div><p>More work is needed.</p></article><div class='related-stories'><h3>Related</h3><ul><li><a href='/q'>Another story</a></li></ul></div></body>", ["Study results", "We asked four hundred people, and most agreed.", "They followed the choice of others, even when it was wrong.", "More work is needed."]),
    ("semantic frame", "<body><header><a href='/'>The Daily</a></header><nav><a href='/s'>Sport</a><a href='/w'>World</a></nav><main><h1>Bridge reopens</h1><p>Cars cross the old bridge again, two years after the flood.</p><blockquote>It feels like coming home.</blockquote></main><footer>&copy; The Daily</footer></body>", ["Bridge reopens", "Cars cross the old bridge again, two years after the flood.", "It feels like coming home."]),
    ("advert and comments", "<body><div id='content'><h2>Bread at home</h2><p>Mix flour, water and salt. Let it rest overnight.</p><div class='ad'><p>Buy our oven today, and save!</p></div><p>Bake it hot, with steam.</p></div><div class='comments'><div class='comment'><p>Worked for me, thank you.</p></div></div></body>", ["Bread at home", "Mix flour, water and salt. Let it rest overnight.", "Bake it hot, with steam."]),
    ("list and pre", "<body><article><p>Install it in two steps:</p><ol><li>Unpack the archive.</li><li>Run the script.</li></ol><pre>make all</pre></article><aside><h3>Popular</h3><p>Ten tips that you must not miss.</p></aside></body>", ["Install it in two steps:", "Unpack the archive.", "Run the script.", "make all"]),
    ("empty article", "<body><nav><a href='/'>Home</a></nav><article></article><footer>2020</footer></body>", []),
    ("sidebar left", "<body><div class='sidebar'><h3>Archive</h3><ul><li><a href='/1'>May</a></li><li><a href='/2'>June</a></li></ul></div><div class='post-content'><h1>A long walk</h1><p>We set out before dawn, with bread and cheese.</p><p>The hill was steeper than the map had promised.</p></div></body>", ["A long walk", "We set out before dawn, with bread and cheese.", "The hill was steeper than the map had promised."]),
    ("cookie notice", "<body><div class='cookie notice'><p>We use cookies. Accept all?</p><button>Accept</button></div><section class='story'><p>The museum opens its new wing in spring, the director said.</p><p>Entry is free on Sundays.</p></section></body>", ["The museum opens its new wing in spring, the director said.", "Entry is free on Sundays."]),
]


def overlap(got, want):
    """Word F1."""
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 1.0 if not a and not b else 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_accuracy_on_pages_written_by_hand():
    model = H.default_model()
    scores = {name: overlap(H.extract(page, model), "\n".join(want)) for name, page, want in PAGES}
    assert np.mean(list(scores.values())) > 0.95 and min(scores.values()) > 0.8, scores


@pytest.mark.parametrize("page", [
    "<body><div class='menu'><a href=/>x</a></div><p>Some text, here.</p><ul><li>One</li></ul></body>",
    "<article><h1>T</h1><p>Body. <b>x</b></p><aside>y</aside></article><footer>z</footer>",
    "<p>alone</p>",
])
def test_messages_give_the_marginals_of_full_enumeration(page):
    model = H.default_model()
    nodes, _ = H.parse(page)
    total = H._totals(nodes)
    phi = [np.array([0.0, -8.0])] + [sum((model["node"].get(f, np.zeros(2)) for f in H.features(x, total[k])), np.zeros(2)) for k, x in enumerate(nodes) if k]
    flat = np.log(np.full((2, 2), 0.5))
    weight, on = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(phi[k][y] for k, y in enumerate(labels)) + sum(model["edge"].get(H.kind(x.tag), flat)[labels[x.parent], labels[k]] for k, x in enumerate(nodes) if k)
        weight += np.exp(score)
        on += np.exp(score) * np.array(labels)
    assert np.allclose(H.marginals(nodes, model)[1:], (on / weight)[1:], atol=1e-9)


def test_query_on_written_pages(spark, tmp_path):
    """op5 over a table of the pages: one row each, text and length those of the single-page inference."""
    rows = [(k, f"http://x/{k}", page) for k, (_, page, _) in enumerate(PAGES)] + [(98, None, None), (99, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in H.op5_html_extract(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all((got[k].url, got[k].text, got[k].n_chars) == (u, H.extract(h or "", H.default_model()), len(got[k].text)) for k, u, h in rows)
    assert got[98].text == got[99].text == ""
