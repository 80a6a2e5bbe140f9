import pytest

from touchcredit.llm.wrappers import Part, aligned, extract, folded, page_texts, parsed, wrappers

SCHEMA = "page_id bigint, url string, html string, text string, host int"


def names(*xs):
    return [Part(x) for x in xs]


def test_alignment_makes_optional_and_repeated_parts():
    once = aligned(names("h1", "p", "footer"), names("h1", "footer"))
    assert [(p.name, p.often) for p in once] == [("h1", ""), ("p", "?"), ("footer", "")]
    assert [(p.name, p.often) for p in folded(names("li", "li", "li"))] == [("li", "+")]
    pairs = folded(names("dt", "dd", "dt", "dd", "dt", "dd"))
    assert [p.shape() for p in pairs] == ["(dt dd)"] and pairs[0].often == "+"
    again = aligned(pairs, [])
    assert [p.often for p in again] == ["*"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script><style>p{}</style></head><body>
<header>Site <a href="/">name</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp; bold<br>line</b> &lt;x&gt; &#233;&eacute;<p>Second</p>
<aside>Aside</aside><div class="ad">Buy</div><form><input>Name</form><ul><li>one</li><li>two</li></ul>
<section id="comments"><p>Nice post</p></section></article>
<div class="sidebar"><p>Related</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold line <x> éé\n\nSecond\n\none\n\ntwo"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE, TEXT),
        (PAGE.replace("article", "main"), TEXT),
        (PAGE.split("<div class=\"sidebar\"")[0].replace("</article>", ""), TEXT),
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a < b & c", "a < b & c"),
        ("<div><script>never closed <p>x", ""), ("<p title='a>b'>x</p>", "x"), ('<p title="open>x</p><p>y</p>', "x\n\ny"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" + "word " * 100_000, ("word " * 100_000).strip()),
    ],
)
def test_one_page(spark, html, text):
    frame = spark.createDataFrame([(1, "http://x.org/1", html, "own", 1)], SCHEMA)
    row = extract(frame).first()
    assert row.text == text and row.n_chars == len(text) and row.host == 1


def plain_page(i):
    items = "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(3 + i % 2))
    paragraphs = "".join(f"<p>Paragraph {i}.{k} " + "with words " * 20 + "</p>" for k in range(1 + i % 4))
    note = "<h2>Note</h2>" if i % 3 else ""
    return f"<html><body><ul>{items}</ul><div class='content'><h1>Head {i}</h1>{note}{paragraphs}</div><div>All rights</div></body></html>"


def test_pages_without_a_marked_article(spark):
    rows = [(i, f"https://Host.org:80/p/{i}?q", plain_page(i), None, 0) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for r in page_texts(frame).collect():
        blocks = r.text.split("\n\n")
        assert blocks[0] == f"Head {r.page_id}" and "Menu" not in r.text and "All rights" not in r.text
        assert sum(b.startswith("Paragraph") for b in blocks) == 1 + r.page_id % 4
    (found,) = wrappers(frame).collect()
    assert found.host == "host.org" and found.pages == 12
    assert "(<li><a" not in found.wrapper and "<li>#</li>)+" in found.wrapper and "<h2>#</h2>)?" in found.wrapper


def test_parts_of_a_large_host(spark, monkeypatch):
    import touchcredit.llm.wrappers as module

    rows = [(i, f"https://host{int(i % 3 > 0) * i}.org/{i}", plain_page(i), None, 0) for i in range(40)]
    frame = spark.createDataFrame(rows + rows[:5], SCHEMA)
    whole = sorted(tuple(r) for r in page_texts(frame).collect())
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in page_texts(frame).collect()) == whole and len(whole) == 45


def test_streams_of_a_host_in_parts(spark, monkeypatch):
    import touchcredit.llm.wrappers as module

    rows = [(i, f"https://host.org/{i}", plain_page(i), None, 0) for i in range(24)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(tuple(r) for r in page_texts(frame).collect())
    monkeypatch.setattr(module, "STREAMS", 3)
    assert sorted(tuple(r) for r in page_texts(frame).collect()) == whole
    assert {r.pages for r in wrappers(frame).collect()} == {24}


def test_fixed_texts_of_a_marked_article_go_and_varying_ones_stay(spark):
    """Position by position: the last paragraph is the same on all pages, a heading with its path differs."""
    page = "<body><article><h1>Head {i}</h1><p>Story {i}</p><p class='related-work'>See {i}</p><ul><li>Item {i}</li></ul><p>Follow us</p></article></body>"
    rows = [(i, f"http://fixed.org/{i}", page.replace("{i}", str(i)), None, 0) for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for r in page_texts(frame).collect():
        assert r.text.split("\n\n") == [f"Head {r.page_id}", f"Story {r.page_id}", f"Item {r.page_id}"] or "See" in r.text
        assert "Follow us" not in r.text and r.text.startswith(f"Head {r.page_id}")
    two = frame.where("page_id < 2")  # too few pages to tell
    assert all(r.text.endswith("Follow us") for r in page_texts(two).collect())


def test_the_alignment_decides(spark, monkeypatch):
    """With alignment replaced by concatenation, positions of different streams no longer meet, and the rows change."""
    import touchcredit.llm.wrappers as module

    rows = []
    for i in range(6):  # three shapes of two pages each: no shape alone shows that the last text is fixed
        extra = "<ul><li>x {i}</li></ul>" * (i % 3 > 0) + "<table><tr><td>t {i}</td></tr></table>" * (i % 3 > 1)
        html = f"<body><article><p>Story {{i}}</p>{extra}<blockquote>Follow us</blockquote></article></body>".replace("{i}", str(i))
        rows.append((i, f"http://align.org/{i}", html, None, 0))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert not any("Follow us" in r.text for r in page_texts(frame).collect())

    def read():
        """(stream, slot) that hold the article, as the two steps of inference say."""
        found = module.streams(frame).toPandas().assign(own=0)
        part = module._partial(found)
        whole = module._whole(part[part["kind"] != "map"])
        article = set(whole[whole["kind"] == "article"]["place"])
        mapped = part[part["kind"] == "map"]
        return {(r.name_, r.slot) for r in mapped.rename(columns={"name": "name_"}).itertuples() if r.place in article}

    aligned_ones = read()
    monkeypatch.setattr(module, "aligned_streams", lambda frame, trees: Part("", "", [p for t in trees for p in t.parts]))
    assert aligned_ones < read()  # the last text of every shape is read as well
