"""What the induced template decides, on pages whose tags and names say nothing."""

import time

import pytest

from quire.llm import wrapper


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in wrapper.main_texts(df).orderBy("page_id").collect()]


def neutral(k, slogan="We sell tools"):
    return f"<div class=x1><p>Home</p><p>Shop</p></div><div class=x2>{slogan}</div><div class=x3><h2>Title {k}</h2><p>Body {k} one</p><p>Body {k} two</p></div><div class=x4>Call us now</div>"


def test_template_without_articles_or_names(spark):
    rows = [("http://a.example/", neutral(k)) for k in range(19)] + [("http://a.example/", neutral(19, "Closed today"))]
    got = run(spark, rows)
    assert got == [f"Title {k}\nBody {k} one\nBody {k} two" for k in range(20)]  # the odd slogan stands in a template slot


def test_two_pages_are_enough_and_one_is_not(spark):
    got = run(spark, [("http://b.example/", neutral(1)), ("http://b.example/", neutral(2)), ("http://c.example/", neutral(3))])
    assert got[:2] == [f"Title {k}\nBody {k} one\nBody {k} two" for k in (1, 2)]
    assert got[2] == "Home\nShop\nWe sell tools\nTitle 3\nBody 3 one\nBody 3 two\nCall us now"


def test_copies_of_a_page_have_one_vote(spark):
    rows = [("http://d.example/", neutral(1))] * 4 + [("http://e.example/", neutral(k)) for k in (1, 1, 1, 2, 3, 4)]
    got = run(spark, rows)
    assert all("Title 1" in x for x in got[:4]) and got[4] == got[5] == got[6] == "Title 1\nBody 1 one\nBody 1 two"


def test_articles(spark):
    page = lambda k: f"<nav>Menu {k}</nav><p>Around {k}</p><article><h1>Head {k}</h1><div class=related-work><p>Earlier work {k}</p></div><div id=search>How we searched {k}</div><p>Subscribe to our letter</p><div class=comments>Reader {k}</div><p>End {k}</p></article><footer>{k}</footer>"
    got = run(spark, [("http://f.example/", page(k)) for k in range(12)])
    assert got[5] == "Head 5\nEarlier work 5\nHow we searched 5\nEnd 5"
    same = run(spark, [("http://g.example/", f"<nav>{k}</nav><article><h1>One</h1><p>Text</p></article>") for k in range(9)])
    assert set(same) == {"One\nText"}  # an article that is the same on all pages is an article still


def test_a_rare_block_stays(spark):
    page = lambda k: f"<article><h1>H {k}</h1><p>P {k}</p>" + ("<h3>Sources</h3><ul><li>a</li><li>b</li></ul>" if k < 3 else "") + "</article>"
    got = run(spark, [("http://h.example/", page(k)) for k in range(40)])
    assert got[1] == "H 1\nP 1\nSources\na\nb"


def test_deep_pages(spark):
    deep = "<div>" * 500 + "<nav>menu</nav><p>text</p>" + "</div>" * 500 + "<p>after</p>"
    assert run(spark, [("http://i.example/", deep)]) == ["text\nafter"]
    began = time.time()
    assert wrapper.content(None, *wrapper.Shapes().fold(wrapper.parse("<section>" * 50_000 + "x" + "</b></div>" * 50_000)))[0].text == "x"
    assert time.time() - began < 20


def test_long_rows_of_children():
    shapes = wrapper.Shapes()
    page = lambda k, n: "".join(f"<p>{k} {i}</p><div>{k}<ul><li>{i}</li></ul></div>" for i in range(n))
    template = wrapper.Template(shapes)
    began = time.time()
    for k in (0, 1):
        template.learn(*shapes.fold(wrapper.parse(f"<h{k + 1}>x</h{k + 1}>" + page(k, 1000))), 1.0)
    assert time.time() - began < 1
    assert template.slots and max(s[0] for s in template.slots) == 2


@pytest.mark.parametrize("cells", [wrapper.CELLS, 4])
def test_alignment_matches_most_nodes(monkeypatch, cells):
    """Against all ordered matchings, tried one by one."""
    monkeypatch.setattr(wrapper, "CELLS", cells)
    shapes = wrapper.Shapes()
    leaf = [shapes.number(c) for c in "abc"]
    node = [shapes.number("d", (leaf[i], leaf[j])) for i in range(3) for j in range(2)]
    kinds = leaf + node

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), shapes.weight(xs[0], ys[0]) and shapes.weight(xs[0], ys[0]) + best(xs[1:], ys[1:]))

    state = 7
    for _ in range(60):
        rows = []
        for _ in range(2):
            row = []
            for _ in range(5):
                state = (state * 1103515245 + 12345) % (1 << 31)
                row.append(kinds[state // 65536 % len(kinds)])
            rows.append(tuple(row))
        xs, ys = rows
        pairs = shapes.pairs(xs, ys)
        assert sum(shapes.weight(xs[i], ys[j]) for i, j in pairs) == best(xs, ys) == shapes.matched(xs, ys)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
