import pytest

from passages.llm.extraction import Template, extract, main_text, templates, tokens


def page(n, article, extra="", host="h.example"):
    html = (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        f"<body><nav><ul><li><a href='/{n}'>Menu {n}</a></li></ul></nav><div class='ad'>Buy {n}</div>{article}{extra}"
        f"<footer>&copy; {host}</footer></body></html>"
    )
    return n, f"https://{host}/p/{n}", html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>Bold<br><p>x\n\t y&nbsp;z</article>", "A & B\nBold\nx y z"),
        ("<body><header>H</header><p>one<p>two<!-- no --></body>", "one\ntwo"),
        ("<main><p>a</p><aside>no</aside><div class='comments'><p>no</p></div><form>no</form><p>b</p></main>", "a\nb"),
        ("<article><p>cut <i>of", "cut of"),
        ("<article><script>if (a<b) '</article>'</script><p>ok &lt;b&gt;</article>", "ok <b>"),
        ("<div id='content'>in<div class='share-bar'>no</div> here</div><div>out</div>", "in\nhere"),
        ("<div class='cookie-notice'>no</div><article>1</article><article>2</article>", "1\n2"),
        ("plain < text & more", "plain < text & more"),
        ("<p title='>'>quoted</p>", "quoted"),
        ("", ""),
        ("<article></article>", ""),
        ("<p class='advert'>no</p><p>yes</p>", "yes"),
    ],
)
def test_main_text(html, text):
    assert main_text(html, None) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p class=ad>Buy<p>One<p>Two</article>", "One\nTwo"),
        ("<article><p class=ad>Buy<p class=ad>more<div>One</div><p>Two</article>", "One\nTwo"),
        ("<article><ul><li class=share>Share<li>One<li>Two</ul><p>Three</article>", "One\nTwo\nThree"),
        ("<article><ul><li class=share><p>Share<ul><li>no<li>no</ul>no<li>One</ul></article>", "One"),
        ("<article><h2 id=notice>No<p>One</article>", "One"),
        ("<article><table><tr><td class=ad>No<p>no<td>One<tr><td>Two</table>Three</article>", "One\nTwo\nThree"),
        ("<article><blockquote class=promo><p>no<p>no</blockquote><p>One</article>", "One"),
        ("<article><dl><dt class=ad>no<dd>One</dl></article>", "One"),
    ],
)
def test_asides_without_an_end_tag(html, text):
    assert main_text(html, None) == text


def test_templates_of_hosts(spark):
    text = "<p>Long text of page {0} with words that differ {0}.</p><p>And more of it &eacute;.</p>"
    rows = [page(n, f"<article><h1>T{n}</h1>{text.format(n)}</article>") for n in range(6)]
    # No element here says that it is the article; the host's slots do.
    odd = [
        page(10 + n, f"<div class='x1'><div class='x2'>{text.format(n)}</div><p>More</p></div>", f"<div class='x3'>tail {n}</div>", "odd.example")
        for n in range(5)
    ]
    rows += [*odd, (50, None, "<p>no address</p>"), (51, "https://h.example/null", None), (51, "https://h.example/null", None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, key string")
    found = {r["id"]: r for r in extract(frame).collect()}
    assert extract(frame).count() == len(rows)
    for n in range(6):
        assert found[n]["text"] == f"T{n}\nLong text of page {n} with words that differ {n}.\nAnd more of it é."
        assert found[n]["container"] == "/html/body/article"
    for n in range(5):
        assert found[10 + n]["text"] == f"Long text of page {n} with words that differ {n}.\nAnd more of it é."
    assert found[50]["text"] == "no address" and found[51]["text"] == ""


def test_tokens_have_occurrence_vectors():
    one = tokens("<body><div class='a b'><p>x</p><p>y</p></div></body>")
    assert one["/body/div.a"][0] == 1 and one["/body/div.a/p"][0] == 2 and one["/body"][2] == 2


def test_very_long_page_and_empty_table(spark):
    html = "<article>" + "<p>word</p>" * 50_000 + "<" * 50_000 + "</article>"
    frame = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    assert extract(frame).collect()[0]["text"].count("word") == 50_000
    assert extract(frame.limit(0)).collect() == []


def test_names_that_say_what_a_page_has(spark):
    rows = [
        (n, f"https://wrapped.example/{n}", f"<body><div class='site has-sidebar with-header'><div class='sidebar'>Menu</div>"
         f"<article class='content no-sidebar'><h1>T{n}</h1><p>The text of page {n}, which differs {n}.</p></article></div></body>")
        for n in range(6)
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["id"]: r["text"] for r in extract(frame).collect()}
    assert found == {n: f"T{n}\nThe text of page {n}, which differs {n}." for n in range(6)}


def _found(spark, pages):
    rows = [(n, f"https://t.example/{n}", html) for n, html in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["id"]: r["text"] for r in extract(frame).collect()}


def test_texts_of_the_template_are_no_values(spark):
    said = "Some words of page {0}, which no other page has {0}."
    pages = [
        f"<body><div class='x1'><div class='x2'><h4>Same on all</h4><p>{said.format(n)}</p><p>It ends.</p></div>"
        f"<p>{said.format(-n - 1)} And as much again {n}.</p></div></body>"
        for n in range(6)
    ]
    # A value that is alike on all pages stays where the element is one of a list.
    assert _found(spark, pages) == {
        n: f"{said.format(n)}\nIt ends.\n{said.format(-n - 1)} And as much again {n}." for n in range(6)
    }
    # Copies of one page are no evidence of a template.
    assert _found(spark, pages[:1] * 6 + pages[1:2]) [0].startswith("Same on all\nSome words of page 0")


def test_texts_of_a_class_that_repeats(spark):
    row = "<div class='entry'><div class='by'>written by</div><p>Line {0} of {1} here.</p><p>x{0}{1}</p></div>"
    pages = [f"<body><main>{''.join(row.format(i, n) for i in range(n % 3 + 2))}</main></body>" for n in range(7)]
    assert _found(spark, pages) == {
        n: "\n".join(f"Line {i} of {n} here.\nx{i}{n}" for i in range(n % 3 + 2)) for n in range(7)
    }


def test_tokens_of_one_path_are_told_apart_by_their_slot(spark):
    # One <div> before the heading and one after it: the path alone is twice on each page.
    pages = [
        f"<body><div><h5>Our rules</h5></div><h1>T{n}</h1><div><p>One {n}.</p><p>Two {n}, longer.</p></div></body>"
        for n in range(6)
    ]
    assert _found(spark, pages) == {n: f"T{n}\nOne {n}.\nTwo {n}, longer." for n in range(6)}


def test_tokens_that_change_places_are_given_up(spark):
    blocks = ["<div class='a'><h6>Left</h6></div>", "<div class='b'><h6>Right</h6></div>"]
    pages = [
        f"<body><main><h1>T{n}</h1>{''.join(blocks[:: 1 if n % 2 else -1])}<p>Text {n}.</p><p>More {n}.</p></main></body>"
        for n in range(6)
    ]
    rows = [("h", n, html) for n, html in enumerate(pages)]
    known = templates(spark.createDataFrame(rows, "host string, key long, html string")).collect()[0]
    anchors = [a["role"] for a in sorted(known["anchors"], key=lambda a: a["rank"])]
    assert len({"/body/main/div.a", "/body/main/div.b"} & set(anchors)) < 2
    assert {"/body", "/body/main", "/body/main/h1"} <= set(anchors)


def test_anchors_give_roles_by_slot():
    template = Template([{"role": "/body", "level": 0, "class": 1, "rank": 0}, {"role": "/body/h1", "level": 0, "class": 1, "rank": 1}], rounds=1)
    found = tokens("<body><p>a</p><h1>b</h1><p>c</p><p>d</p></body>", template)
    assert sorted(e[0] for r, e in found.items() if r.startswith("/body/p @") and e[6] is None) == [1, 2]
    assert [e[5] for e in tokens("<h1>x</h1>", template).values()] == [False, False]
