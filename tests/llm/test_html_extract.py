from factlake.llm import html_extract as h


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = h.default_model()
    tree = h.parsed("<div class=post><p>Some words, here.</p><ul class=menu><li><a href=x>Link</a></li></ul></div>")
    ev, edges = h._evidence(tree), [model.edge.get(t) or model.edge["*"] for t in tree.tags]
    total, on = 0.0, [0.0] * len(tree.tags)
    for y in itertools.product((0, 1), repeat=len(tree.tags)):
        s = sum(model.node[f][y[i]] for i, fs in enumerate(ev) for f in fs if f in model.node)
        s += sum(edges[i][y[tree.parents[i]]][y[i]] for i in range(1, len(y)))
        p = math.exp(s)
        total += p
        for i, v in enumerate(y):
            on[i] += p * v
    for got, want in zip(model.marginals(tree), on, strict=True):
        assert abs(got - want / total) < 1e-9


def test_held_out_layouts():
    """Layouts of the labelled set, each read by a model that has not seen it."""
    right = blocks = 0
    for k in range(0, len(h.LABELLED), 9):
        model = h.Model([p for i, p in enumerate(h.LABELLED) if i // 9 != k // 9])
        for page in h.LABELLED[k: k + 9]:
            tree = h.parsed(page, marks=True)
            content = model.marginals(tree)
            for at, _ in tree.blocks:
                right += (content[at] >= 0.5) == (tree.marks[at] != 0)
                blocks += 1
    assert right / blocks > 0.9


def test_article_without_its_frame():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
            '<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is good.</div>'
            "<article><h1>Head &amp; line</h1><p><b>Bold\n  text&nbsp;here.<br><p>Unclosed paragraph &lt;x&gt;.</p><p>Yes.</article>"
            "<aside>More of it</aside><form>Name</form><footer>&copy; me</footer>")
    assert h.extract(page, h.default_model()) == "Head & line\nBold text here.\nUnclosed paragraph <x>.\nYes."


def test_odd_rows(spark):
    rows = [(1, "u", None, "clash"), (2, "u", "", None), (2, "u", "", None), (None, None, "<p>Plain words, and more of them.", "x"),
            (3, "u", "<nav><a href=x>only</a></nav>", "x"), (4, "u", "<p>" + "long words. " * 50_000, "x"), (5, "u", "<<<>&#0;</b></p><p", "x")]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, tags string"))
    by = {(r.page_id, r.tags): r.text for r in got.collect()}
    assert got.count() == 7 and by[1, "clash"] == by[2, None] == by[3, "x"] == ""
    assert by[None, "x"] == "Plain words, and more of them." and len(by[4, "x"]) == 12 * 50_000 - 1
    assert h.main_text(got.drop("text").limit(0)).count() == 0


def test_names_after_many_others():
    words = "flex px-4 py-2 mt-8 text-sm bg-gray-100 " + " ".join(f"utility-{'x' * i}" for i in range(60))
    tree = h.parsed(f'<div class="{words} sidebar" id="comments" role="banner"><p>Words.</p></div>')
    assert {"name=sidebar", "name=comments", "name=banner"} <= set(h._evidence(tree)[1])
    story = "<article><h1>Head</h1><p>" + "The words of a long story, with commas. " * 3 + "</p></article>"
    for name in ("sidebar", "advert", "comments"):
        page = '<body>{}<div class="{}{}"><p>Words of a longer sentence in a box, with commas, and an end.</p></div>'
        few, many = (h.extract(page.format(story, before, name), h.default_model()) for before in ("", "flex px-4 py-2 mt-8 sm bg-gray-100 rounded shadow "))
        assert few == many and "box" not in many


def test_head_that_is_never_closed():
    meta = '<meta charset=utf-8><title>T</title><link rel=x><style>p{}</style><script>var t;</script><noscript><img src=x></noscript>'
    want = ["The whole article.", "More of it."]
    for page in ("<html><head><title>T</title><p>The whole article.<p>More of it.", f"<head>{meta} <p>The whole article.</p><p>More of it.",
                 f"<head>{meta}<div><p>The whole article.<p>More of it.</div>", f"<head>{meta}The whole article.<p>More of it.",
                 f"<head>{meta}</head><p>The whole article.<p>More of it.", f"<head>{meta}<body><p>The whole article.<p>More of it.",
                 f"<head><head>{meta}<article><p>The whole article.<head><p>More of it."):
        assert [" ".join("".join(x).split()) for _, x in h.parsed(page).blocks] == want, page
    assert h.extract("<html><head><title>T</title><p>The whole article.", h.default_model()) == "The whole article."
    assert h.extract(f"<html><head>{meta}", h.default_model()) == ""


def test_time_is_linear_in_depth():
    """100,000 elements in each other, with end tags that close none of them, and text at every depth."""
    import time

    n = 100_000
    html = "<article>" + "".join(f"<{('b', 'div', 'p', 'span', 'li')[i % 5]}>t</x></table>" for i in range(n))
    began = time.process_time()
    tree = h.parsed(html)
    assert time.process_time() - began < 20 and len(tree.tags) > n
    assert sum(len("".join(pieces)) for _, pieces in tree.blocks) == n
