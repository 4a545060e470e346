"""Links inside the article and role words on the page's own elements."""

from edgewise.llm import wrapper

SCHEMA = "page_id long, url string, html string"


def _texts(spark, pages):
    rows = [(i, f"http://a/{i}", page) for i, page in enumerate(pages)]
    got = wrapper.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_links_in_the_article_are_text_and_beside_it_are_not(spark):
    page = (
        "<body class='has-sidebar'><div><a href='/'>home {0}</a></div><main class='content-header'>"
        "<article class='post share'><h1><a href='/x'>head {0}</a></h1><p>body {0}<p><a href='/y'>link {0}</a>"
        "<ul><li><a href='/1'>one {0}</a><li><a href='/2'>two {0}</a></ul><div class='share'>tell {0}</div></article></main>"
    )
    got = _texts(spark, [page.format(i) for i in range(6)])
    assert got == [f"head {i}\n\nbody {i}\n\nlink {i}\n\none {i}\n\ntwo {i}" for i in range(6)]


def test_without_an_article_the_slot_decides(spark):
    page = "<body><ul><li><a href='/'>go {0}</a></ul><h1><a href='/x'>head {0}</a></h1><p>body {0}<p>{1}"
    ends = ["<a href='/y'>link</a>", "end 1", "end 2", "end 3", "end 4", "end 5"]
    got = _texts(spark, [page.format(i, e) for i, e in enumerate(ends)])
    assert got == [f"head {i}\n\nbody {i}\n\n{'link' if not i else e}" for i, e in enumerate(ends)]
    # one page alone says nothing on its slots
    assert _texts(spark, [page.format(0, "end")]) == ["go 0\n\nhead 0\n\nbody 0\n\nend"]


def test_template_goes_from_short_pages_too(spark):
    frame = "<body>" + "".join(f"<div class='c{k}'>always {k}</div>" for k in range(5))
    got = _texts(spark, [f"{frame}<p>only {i}</p></body>" for i in range(20)])
    assert got == [f"only {i}" for i in range(20)]


def test_copies_of_a_page_do_not_make_it_template(spark):
    frame = "<body><div class='top'>always</div><div class='text'><p>{}<p>{}</div>"
    pages = [frame.format("copied", "twice copied")] * 30 + [frame.format(f"a {i}", f"b {i}") for i in range(8)]
    got = _texts(spark, pages)
    assert got == ["copied\n\ntwice copied"] * 30 + [f"a {i}\n\nb {i}" for i in range(8)]


def test_deep_broken_and_long_pages_end_soon(spark):
    import time

    started = time.perf_counter()
    deep = "<div>" * 20_000 + "deep" + "</p>" * 20_000
    texts = _texts(
        spark,
        [
            deep,
            "<p data-x=it's>Hello</p> there",
            "start<a " * 20_000,
            "<p class='open>x</p><p title=\"never>y",
            "<i '" * 30_000,
            "<h2>h<p>p" * 20_000,
            "".join(f"<div class=k{i}>t</div>" for i in range(3000)),
            "a<!-- " * 20_000,
            "1 < 2 <3 </ p> &lt;b&gt; <p/>end",
        ],
    )
    assert time.perf_counter() - started < 60
    assert texts[:2] == ["deep", "Hello\n\nthere"]
    assert texts[2] == "start" and texts[7] == "a"
    assert texts[5].count("p") == 20_000 and texts[6] == "\n\n".join(["t"] * 3000)
    assert texts[8] == "1 < 2 <3 </ p> <b>\n\nend"
    assert all("<" not in t for t in texts[:8])


def test_alignment_is_the_largest_mapping():
    import random

    def size(x, y):
        """Simple tree matching as it is told, by recursion over all prefixes."""
        if x.label != y.label:
            return 0
        a, b = list(x.children.values()), list(y.children.values())
        best = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + size(a[i - 1], b[j - 1]))
        return best[len(a), len(b)] + 1

    def draw(rng, depth):
        if depth == 0:
            return "t"
        names = rng.sample(["div", "p", "ul", "section", "h1", "table"], rng.randint(0, 4))
        return "".join(f"<{n}>{draw(rng, depth - 1)}</{n}>" for n in names)

    for seed in range(200):
        rng = random.Random(seed)
        trees = [wrapper.parse(draw(rng, 3))[0] for _ in range(2)]
        page, reference = map(wrapper.number, trees)
        slots = wrapper.align(page, reference)
        assert sum(s >= 0 for s in slots) == size(*trees)
        labels = [[n[0] for n in wrapper.tree(x)] for x in (page, reference)]
        assert all(labels[0][i] == labels[1][s] for i, s in enumerate(slots) if s >= 0)
        mapped = [s for s in slots if s >= 0]
        assert mapped == sorted(set(mapped))  # both trees are numbered in page order


def test_pages_equal_a_plain_wrapper(spark):
    """Slots, counts and choices in plain loops over all pages of a host."""
    import random
    from collections import Counter

    rng = random.Random(5)
    pages = []
    for i in range(60):
        host = f"h{i % 3}"
        top = "<div class='top'>always here</div>" if i % 3 else f"<div class='top'>top {i}</div>"
        side = "<section><p>same line</p></section>" * (rng.random() < 0.7)
        body = "".join(rng.choice(["<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>"]).format(rng.choice([f"text {i} {k}", "filler"])) for k in range(rng.randint(0, 5)))
        pages.append((i, f"http://{host}/{i}", f"<body>{top}{side}<div class='text'>{body}</div><div class='footer'>f</div></body>"))
    want = {}
    for host in ("h0", "h1", "h2"):
        own = {i: wrapper.parse(page) for i, url, page in pages if f"//{host}/" in url}
        shapes = {i: wrapper.number(root) for i, (root, _) in own.items()}
        counts = Counter(shapes.values())
        most = max(counts.values())
        tied = [s for s, n in counts.items() if n == most]
        if len(tied) > 1:
            continue  # the hash of the tree decides
        slots = {i: wrapper.align(s, tied[0]) for i, s in shapes.items()}
        blocks = {i: [(slots[i][n.at], t) for n, t, _ in found if not n.silent] for i, (_, found) in own.items()}
        different = {tuple(t for _, t in b): b for b in blocks.values()}
        seen = Counter(x for b in different.values() for x in {x for x in b if x[0] >= 0})
        for i, b in blocks.items():
            want[i] = "\n\n".join(t for x in b for t in [x[1]] if not (seen[x] >= 5 and seen[x] >= 0.8 * len(different)))
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert len(want) >= 20 and {i: got[i] for i in want} == want
    assert any("always here" in p[2] for p in pages) and not any("always here" in t for t in want.values())
