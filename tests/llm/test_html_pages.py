"""Pages of one host, judged by all of them."""

from quadloom.llm import html_extract


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    got = html_extract.extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_an_optional_section_is_kept(spark):
    second = '<div class="story2"><p>second {0}</p></div>'
    pages = [f'<html><body><div class="story"><p>first {i}</p></div>{second.format(i) if i == 37 else ""}</body></html>' for i in range(60)]
    got = extracted(spark, pages)
    assert got[37] == "first 37 second 37" and got[5] == "first 5"


def test_children_past_sixty_are_kept(spark):
    pages = ["<html><body>" + "".join(f'<div class="c{k}"><p>{k} {i if k in (2, 70) else ""}</p></div>' for k in range(80)) + "</body></html>" for i in range(3)]
    assert "70 2" in extracted(spark, pages)[2]


def test_constant_blocks_are_left_out(spark):
    box = '<div class="box"><h3>Our app</h3><p>Get it today.</p></div>'
    pages = [f"<html><body><article><h1>Title {i}</h1><h2>Method</h2><p>{' '.join(f'word{i}x{k}' for k in range(20))}</p>{box}</article></body></html>" for i in range(20)]
    got = extracted(spark, pages)
    assert all("app" not in t and "today" not in t for t in got.values())
    assert got[3] == "Title 3 Method " + " ".join(f"word3x{k}" for k in range(20))  # a constant heading stays
    copies = [f"<html><body><article><h1>One text</h1><p>{'the same words ' * 20}</p><p>seen {i}</p></article></body></html>" for i in range(20)]
    assert all(t.startswith("One text the same") for t in extracted(spark, copies).values())


def test_names_that_only_hold_a_word_of_boilerplate():
    words = " ".join(f"word{k}" for k in range(40))
    for name in ('class="content with-sidebar"', 'class="post no-comments"', 'class="sidebar"'):
        page = f"<html><body><div {name}><h2>Title</h2><p>{words}</p></div></body></html>"
        assert html_extract.extracted(page, None) == f"Title {words}"
    for slug in ("related-work", "social-history", "search-methods", "sharing-data", "search"):
        page = f'<html><body><article><h2 id="{slug}">Kept</h2><p id="{slug}">and this</p><p>{words}</p></article></body></html>'
        assert html_extract.extracted(page, None) == f"Kept and this {words}"
    for name in ('class="post-comments"', 'id="cookie-notice"', 'class="x widget-2"', 'class="relatedPosts"', 'role="search"'):
        assert html_extract.extracted(f"<body><article><p>{words}</p><div {name}>few words</div></article></body>", None) == words
    assert html_extract.extracted(f'<body><p>text</p><div class="menu"><a href="/">{words}</a></div></body>', None) == "text"


def site(i, article=True):
    """A page whose blocks have names that tell nothing, with text of its own in each, and the text expected of it."""
    body = f"Sentence one of page {i} about subject {i * 7 % 31}. " * (2 + i % 5)
    holder = "article" if article else 'div class="k3"'
    html = f"""<html><head><title>T{i}</title></head><body><div class="k1"><a href="/">Home</a> <a href="/{i}">Place {i}</a></div>
    <div class="k2">Read next: story {i * 13 % 97}</div>
    <{holder}><h1>Title {i}</h1><p>{body}</p><div class="k5"><p>Our app is out. Get it from the shop.</p></div><p class="social-history">Last word {i}.</p></{holder.split()[0]}>
    <div class="k4">Weather of day {i}: rain</div></body></html>"""
    return html, " ".join(f"Title {i} {body} Last word {i}.".split())


def test_wrappers_decide_where_names_tell_nothing(spark):
    """Teasers and adverts outside the content and a constant notice inside it go by structure alone."""
    for article in (True, False):
        made = [site(i, article) for i in range(40)]
        got = extracted(spark, [h for h, _ in made])
        assert [got[i] for i in range(40)] == [t for _, t in made]
    wrapper = html_extract.induced([site(i, False)[0] for i in range(40)])
    assert wrapper[0] == "html./body./div.k3/"
    changed = sum(html_extract.extracted(site(i, False)[0], wrapper) != html_extract.extracted(site(i, False)[0], None) for i in range(40))
    assert changed == 40


def test_headings_beside_the_text_and_several_sections_stay():
    long_ = lambda i, k: f"part {k} of {i} " + "and so on " * (i % 3 + 9)
    pages = [f'<body><h1>Name {i}</h1><div class="a"><p>{long_(i, 1)}</p></div><div class="t">see {i}</div></body>' for i in range(9)]
    assert html_extract.extracted(pages[4], html_extract.induced(pages)) == " ".join(f"Name 4 {long_(4, 1)}".split())
    pages = [f'<body><div class="a"><p>{long_(i, 1)}</p></div><div class="b"><p>{long_(i, 2)}</p></div><div class="t">see {i}</div></body>' for i in range(9)]
    assert html_extract.extracted(pages[5], html_extract.induced(pages)) == " ".join(f"{long_(5, 1)} {long_(5, 2)}".split())
    pages = [f'<body><div class="c"><div class="head"><h1>Name {i}</h1></div><div class="b"><p>{long_(i, 2)}</p></div></div></body>' for i in range(9)]
    assert html_extract.extracted(pages[5], html_extract.induced(pages)) == " ".join(f"Name 5 {long_(5, 2)}".split())


def test_a_crowded_host(spark):
    rows = [(i, f"http://big.example/{i}", site(i)[0]) for i in range(1200)] + [(5000 + i, f"http://h{i}.example/", site(i)[0]) for i in range(3)]
    got = html_extract.extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 1203 and all(r.text == site(r.page_id)[1] for r in got if r.page_id < 5000)
