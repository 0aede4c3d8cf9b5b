import random

from tidegauge.llm import wrappers

PAGES = "page_id long, url string, html string"


def texts(page):
    return [t for _, _, t, _ in wrappers.blocks(page)]


def own(page):
    found = list(wrappers.blocks(page))
    slots = set(wrappers.main_slots(wrappers.expression(found)))
    return "\n\n".join(t for path, _, t, _ in found if path in slots)


def test_blocks_of_broken_markup():
    assert texts("<p><b>One &amp; two<br>three<p>four") == ["One & two three", "four"]
    assert texts("a < b <i>c</i>d &lt;p&gt; &nbsp; e") == ["a < b cd <p> e"]
    assert texts("<ul><li>x<li>y<ul><li>z</ul></ul>t") == ["x", "y", "z", "t"]
    assert texts("<p>a<!-- > <p>b</p> -->c<script>var t='</p>';</script>d</p>") == ["acd"]
    assert texts('<div title="a>b">c</div><p class=\'x\'>d</p') == ["c", "d"]
    assert texts("x<a href='cut") == ["x"]
    assert texts("a<!-- never closed <p>b</p>") == ["a"]
    assert texts("<style>p{}") == [] == texts("") == texts("<<<>>>"[:0])
    assert texts("&am &amp &a; &#228;&#x20AC;") == ["&am & &a; ä€"]
    deep = "<div>" * 3000 + "in" + "</div>" * 3000 + "<p>out</p>"
    assert texts(deep) == ["in", "out"]


def test_long_pages_take_time_in_proportion():
    for page in ("<a" * 200_000, "<p x=\"" * 100_000, "<!--" * 100_000, "<b><p>" * 100_000, "&" * 300_000, "<" * 300_000 + ">"):
        list(wrappers.blocks(page))


def test_alignment_resolves_mismatches():
    def one(page):
        return wrappers.expression(list(wrappers.blocks(page)))

    merged = one("<div><h1>A</h1><p>x</p><p>y</p><i>same</i></div>")
    for other in ("<div><h1>B</h1><p>x</p><ul><li>1</li><li>2</li></ul></div>", "<div><h1>C</h1><ul><li>3</li></ul></div>"):
        wrappers.align(merged, one(other))
    assert merged.pages == 3
    assert wrappers.render(merged) == "<div><h1>#</h1> <p>#</p>+? <ul><li>#</li>+</ul>? \"#\"?</div>"
    looped = one("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>")
    assert wrappers.render(looped) == "<div>(<h2>#</h2> <p>#</p>)+</div>"
    turned = wrappers.align(one("<div><p>a</p><h2>b</h2></div>"), one("<div><h2>a</h2><p>b</p></div>"))
    assert turned.kids["div"].loop
    many = one("<div>" + "".join(f"<p class='m{chr(97 + k // 26)}{chr(97 + k % 26)}'>{k}</p>" for k in range(200)) + "</div>")
    wide = wrappers.align(many, one("<div><p>x</p><section>y</section></div>"))
    assert len(wide.kids["div"].kids) <= 3


def test_expressions_travel_as_json():
    import json

    part = wrappers.expression(list(wrappers.blocks("<div><h2>a</h2><p>b</p><h2>c</h2></div>")))
    again = wrappers.Part.of(json.loads(json.dumps(part.plain())))
    assert wrappers.render(again) == wrappers.render(part) and again.plain() == part.plain()


def test_boilerplate_of_one_page_goes():
    body = "<p>First words of it.</p><h2>Part</h2><ul><li>one</li><li>two</li></ul><blockquote>said</blockquote><pre>x\n  y</pre>"
    page = (
        "<html><head><title>T</title><style>x</style></head><body class='has-sidebar'><header><a href=/>Site</a></header><nav><ul><li>Home</li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><div id=page><main><article><h1>Head &ndash; line</h1>" + body +
        "<aside>More</aside><div class='ad'>Buy</div><form>Mail <input></form></article><section class='comments'><article class='comment'>First!</article></section></main>"
        "<div class='sidebar widget'>Popular</div></div><footer>&copy; us</footer><script>1</script></body></html>"
    )
    want = "Head – line\n\nFirst words of it.\n\nPart\n\none\n\ntwo\n\nsaid\n\nx y"
    assert own(page) == want
    assert own(page.replace("<article>", "<div>").replace("</article><section", "</div><section")) == want
    assert own("<body><form>" + "<p>All of it stands in a form.</p>" + "</form></body>") == "All of it stands in a form."
    assert own("<nav>Home</nav><footer>Us</footer>") == ""
    assert own("plain words") == "plain words"


def site(rng, k, marked):
    """A page whose template is known, and its main text."""
    words = lambda n: " ".join(rng.choice(["ka", "mo", "ri", "te", "su"]) + str(rng.randrange(99)) for _ in range(n))
    parts = [words(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 7))]
    head, extra = words(4), "<ul>" + "".join(f"<li>{w}</li>" for w in ("x1", words(9))) + "</ul>" if k % 3 == 0 else ""
    main = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in parts) + extra
    main = f"<article>{main}</article>" if marked else f"<div class='c'>{main}</div>"
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(6).split())
    page = (
        f"<html><body><nav><a href='/'>{words(2)}</a></nav><div class='t'>Welcome to the site of all sites</div>{main}"
        f"<div class='r'><ul>{links}</ul></div><div class='ads'>{words(12)}</div><footer>{words(5)}</footer></body></html>"
    )
    listed = page.split("<ul>")[1].split("</ul>")[0] if extra else ""
    items = [t.split("</li>")[0] for t in listed.split("<li>")[1:]]
    return page, "\n\n".join([head, *parts, *items])


def test_hosts_give_their_main_text_whatever_the_partitions(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(90):
        host = ["https://www.hot.example/a?b", "http://plain.example:80/x", "https://user@mixed.example"][k % 3]
        page, text = site(rng, k, marked=k % 3 == 0 or (k % 3 == 2 and k % 2 == 0))
        rows.append((k, f"{host}/{k}", page))
        want[k] = text
    rows += [(200, None, "<article>alone</article>"), (201, "", ""), (202, "no host", None), (203, "https://hot.example", ""), (None, "https://a.example", "<p>x</p>")]
    rows += [(204, "https://www.hot.example/same", rows[0][2])] * 3 + [(205, "https://hot.example/other", "<p>No article on this one page</p>")]
    want |= {200: "alone", 201: "", 202: "", 203: "", None: "x", 204: want[0], 205: "No article on this one page"}
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'y' AS text", "1 AS salt", "2 AS slots")
    for parts, config in ((1, wrappers.WrapperConfig()), (7, wrappers.WrapperConfig(fan_in=2, hot=3, salts=4, held=1))):
        out = wrappers.main_text(table.repartition(parts), config)
        assert out.columns == ["page_id", "url", "text", "n_chars"]
        got = out.collect()
        assert len(got) == len(rows)
        wrong = [(r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id]]
        assert not wrong, wrong[:2]
        assert all(r.n_chars == len(r.text) for r in got)


def test_no_pages_give_no_rows(spark):
    assert wrappers.main_text(spark.createDataFrame([], PAGES)).isEmpty()


def test_pages_against_a_plain_reading(spark):
    """On the given pages an article is marked; its blocks are read here by splitting at its tags."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.main_text(table).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        inside = r.html.partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
