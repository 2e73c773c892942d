"""Which part of a page its host's wrapper chooses."""

from fileloom.llm import html

PAGES = "page_id long, url string, html string"
LONG = " ".join(f"word{k}" for k in range(60))


def extract(spark, rows, parts=3):
    table = spark.createDataFrame(rows, PAGES).repartition(parts)
    got = html.extract_pages(table).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def story(k, lead="", tail=""):
    return f"<html><body><div>We use tokens</div><div class=x>{lead}<p>Story {k} begins here, long enough.</p><p>It ends, {k * 7}.</p></div>{tail}<p>Imprint</p></body></html>"


def test_hosts_whose_pages_are_equal_keep_their_texts(spark):
    flat = f"<html><body><div>{LONG}</div><p>Last</p></body></html>"
    rows = [(k, f"http://copies.example.org/{k}", flat) for k in range(4)]
    rows += [(10, "http://once.example.org/", flat)] * 3
    rows += [(20 + k, None, flat) for k in range(3)]
    rows += [(30 + k, f"http://near.example.org/{k}", flat.replace("<p>", f"<i>{k} views</i><p>")) for k in range(4)]
    rows += [(40 + k, f"http://hidden.example.org/{k}", flat.replace("<p>", f"<script>{k}</script><p>")) for k in range(4)]
    got = extract(spark, rows)
    assert len(got) == 16 and all(LONG in t for t in got.values())
    assert got[40] == f"{LONG}\n\nLast" and got[31] == f"{LONG}\n\n1 views\n\nLast"


def test_a_shared_text_within_the_root_stays(spark):
    lead = "<h1>Daily column</h1>"
    got = extract(spark, [(k, f"http://col.example.org/{k}", story(k, lead)) for k in range(5)])
    assert got[3] == "Daily column\n\nStory 3 begins here, long enough.\n\nIt ends, 21."
    # A text that is fixed in one place stays in another.
    rows = [(k, f"http://flat.example.org/{k}", f"<body><div>Note</div><h2>Day {k} of many</h2><p>{'Note' if k == 2 else f'{k} is long'}</p></body>") for k in range(5)]
    assert extract(spark, rows)[2] == "Day 2 of many\n\nNote"


def test_repeated_rows_are_no_evidence(spark):
    rows = [(1, "http://two.example.org/1", "<body><div>Both</div><p>First of two</p><h2>a</h2></body>")] * 5
    rows += [(2, "http://two.example.org/2", "<body><div>Both</div><h2>Second of two</h2></body>")]
    assert extract(spark, rows)[1] == "Both\n\nFirst of two\n\na"
    pages = {r.host: r.pages for r in html.infer_rules(spark.createDataFrame(rows, PAGES)).collect()}
    assert pages == {"two.example.org": 2}


def test_mixed_hosts_have_a_root_for_each_kind(spark):
    rows = [(k, f"http://mix.example.org/{k}", story(k)) for k in range(5)]
    rows += [(10 + k, f"http://mix.example.org/a{k}", f"<body><div>We use tokens</div><article><h1>Same title</h1><p>Article {k}</p></article></body>") for k in range(5)]
    rows += [(20, "http://mix.example.org/m", "<body><div>We use tokens</div><main><p>Main</p></main></body>")]
    got = extract(spark, rows)
    assert got[4] == "Story 4 begins here, long enough.\n\nIt ends, 28."
    assert got[13] == "Same title\n\nArticle 3" and got[20] == "Main"


def test_the_wrapper_overrules_articles_that_are_teasers(spark):
    teaser = "<article><h2>Read {}</h2></article>"
    rows = [(k, f"http://tease.example.org/{k}", story(k, f"<p>{LONG} {k}</p>", teaser.format(k) * 2)) for k in range(5)]
    rows += [(9, "http://tease.example.org/odd", "<body><div>We use tokens</div><article><p>Alone</p></article></body>")]
    got = extract(spark, rows)
    assert got[2] == f"{LONG} 2\n\nStory 2 begins here, long enough.\n\nIt ends, 14."
    assert got[9] == "Alone"


def test_articles_are_found_whatever_their_class(spark):
    page = "<body class='p{0}'><div>Other {0}</div><article class='post-{0}'><h1>T</h1><div><p>" + LONG + " {0}</p></div></article></body>"
    got = extract(spark, [(k, f"http://w.example.org/{k}", page.format(k)) for k in range(5)])
    assert got[4] == f"T\n\n{LONG} 4"
    wrapper = html.align(*(html.page_wrapper(html.parse(page.format(k))) for k in range(2)))
    assert [n[0] for n in wrapper] == ["body"] and [n[0] for n in wrapper[0][3]] == ["div", "article"]


def test_any_depth(spark):
    nest = lambda n, inner, tag="div": f"<{tag}>" * n + inner + f"</{tag}>" * n
    deep = nest(5000, "<p>Deep</p><nav>menu</nav><p>More</p>") + "<p>After</p>"
    rows = [(k, f"http://deep.example.org/{k}", f"<body>{deep.replace('Deep', f'Deep {k}')}</body>") for k in range(4)]
    rows += [(10, "http://spans.example.org/", "<article>" + nest(3000, "in", "span") + "<p>x</p></article>")]
    rows += [(11, "http://lists.example.org/", "<article>" + "<ul><li>a" * 900 + "</article>"), (12, "http://open.example.org/", "<div>" * 4000 + "end")]
    rows += [(13, "http://a.example.org/", "<article>" + nest(300, "<nav><p>m</p></nav><p>t</p>") + "<footer>f</footer></article><p>no</p>")]
    got = extract(spark, rows)
    assert got[2] == "Deep 2\n\nMore" and got[10].split() == ["in", "x"] and got[12] == "end" and got[13] == "t"
    assert got[11].split() == ["a"] * 900


def test_a_wrapper_does_not_grow_with_the_pages():
    import json

    page = "<body class='postid-{0}'><div class='menu'>Menu</div><div class='post post-{0} {1}'><p>Story {0} of the day</p></div><p class='{1}'>x</p></body>"
    slugs = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(1000)]
    wrapper, sizes = None, []
    for k, slug in enumerate(slugs):
        found = html.page_wrapper(html.parse(page.format(k, slug)))
        wrapper = found if wrapper is None else html.align(wrapper, found)
        sizes.append(len(json.dumps(wrapper)))
    assert sizes[-1] <= max(sizes[:200]) and sizes[-1] < 2000
    rule = html.content_rule(wrapper, 1000)
    assert rule["root"] == ["body", "div.post"]
    assert html.extract_text(page.format(7, "h"), {"": rule}) == "Story 7 of the day"
    # Children that are all different are known by their tags.
    many = html.page_wrapper(html.parse("".join(f"<div class='{s}'>{s}</div><p>{s}</p>" for s in slugs)))
    assert len(many) <= html.WIDE


def test_blocks_that_repeat_on_flat_pages_against_brute_force(spark):
    """Pages without article, main or a narrower element: what all pages have in the same place goes."""
    import random

    rng = random.Random(3)
    shared = ["Imprint", "All news", "Write to us"]
    pages = {}
    for k in range(12):
        story = [f"Sentence {k} {j} " + " ".join(rng.choice(["sea", "sky", "land"]) for _ in range(12)) for j in range(4)]
        pages[k] = [shared[0], *story, *shared[1:]]
    tags = ["h4", "p", "p", "p", "p", "h5", "h6"]
    rows = [(k, f"http://flat.example.org/{k}", "<body>" + "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks)) + "</body>") for k, blocks in pages.items()]
    everywhere = set.intersection(*(set(b) for b in pages.values()))
    assert extract(spark, rows) == {k: "\n\n".join(b for b in blocks if b not in everywhere) for k, blocks in pages.items()}


def test_articles_inside_elements_of_any_name(spark):
    """Layouts whose names have a word of the skipped kinds in them, forms around whole pages, and such names inside."""
    inside = {
        "p": ["market-share", "ad-hoc", "widget-theory"], "section": ["social-history"], "h2": ["related-work"], "div": ["comment-on-policy", "notice-period"],
    }
    blocks = [f'<{tag} {"id" if tag in ("h2", "div") else "class"}="{name}">About {name}</{tag}>' for tag, names in inside.items() for name in names]
    article = "<article><h1>Title {0}</h1><p>Body {0}</p>" + "".join(blocks) + '<div class="ad">Buy</div><section class="comments"><p>First!</p></section></article>'
    around = [
        '<div class="layout with-sidebar">{}</div>', '<div class="header-fixed">{}</div>', '<div class="content no-sidebar">{}</div>', '<form id="aspnetForm"><select><option>x</select>{}</form>',
        '<div class="sidebar">{}</div>', '<div class="widget"><form class="search">{}</form></div>', "{}",
    ]
    want = [f"About {name}" for names in inside.values() for name in names]
    rows = [(k, f"http://h{k}.example.org/", "<body><nav>Menu</nav>" + a.format(article.format(k)) + "<footer>F</footer></body>") for k, a in enumerate(around)]
    got = extract(spark, rows)
    for k in range(len(around)):
        assert got[k].split("\n\n") == [f"Title {k}", f"Body {k}", *want]
    # The same names on a host of many pages, where they vary.
    many = [(k, f"http://many.example.org/{k}", f'<body><form id="f"><main><p>Text {k}</p><p class="market-share">Share of {k}</p><div class="share-it"><p>Tell friends</p></div></main></form></body>') for k in range(5)]
    got = extract(spark, many)
    assert got[3] == "Text 3\n\nShare of 3"
    # Two pages say nothing about what is the same on all.
    assert extract(spark, many[:2])[1] == "Text 1\n\nShare of 1\n\nTell friends"


def test_forms_and_teasers_stay_out(spark):
    pages = [
        ("<body><form><label>Your name</label></form><div><p>The article itself is longer than the form</p></div></body>", "The article itself is longer than the form"),
        ("<body><form id=all><p>The page is in a form, with much text</p><button>Go</button></form><p>And a tail, not short</p></body>", "The page is in a form, with much text\n\nAnd a tail, not short"),
        ('<body><div class="sidebar"><article>Teaser</article></div><main><p>Main</p></main></body>', "Main"),
        ('<body><section id="comments"><article><p>I agree</p></article></section><p>Story</p></body>', "Story"),
        ('<body><article class="comment_12"><p>Me too</p></article><p>Story</p></body>', "Story"),
        ("<body><aside><article>Elsewhere</article></aside><p>Story</p></body>", "Story"),
        ('<body><article><header class="header"><h1>T</h1></header><p class="Ad_3">Buy</p><p class="related-posts">R</p>x</article></body>', "T\n\nx"),
    ]
    got = extract(spark, [(k, f"http://p{k}.example.org/", h) for k, (h, _) in enumerate(pages)])
    assert [got[k] for k in range(len(pages))] == [t for _, t in pages]


def plain_blocks(page):
    """The blocks of a well-formed page by another parser: text inside <article>, outside blocks that a list of tags,
    roles and whole names rules out."""
    from html.parser import HTMLParser

    out, open_tags = [], []
    void, inline = {"br", "img", "hr"}, {"b", "a", "i", "em", "span", "br", "img"}
    tags, names = {"nav", "footer", "aside", "form", "script", "style", "select", "head"}, {"ad", "comments", "sidebar", "cookie-banner", "promo"}

    class Parser(HTMLParser):
        text = ""

        def end_block(self):
            if self.text.split():
                out.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag not in inline:
                self.end_block()
            elif tag == "br":
                self.text += " "
            if tag not in void:
                given = dict(attrs)
                gone = tag in tags or bool(names & set((given.get("class") or "").split())) or given.get("role") == "search" or "hidden" in given
                open_tags.append((tag, gone))

        def handle_endtag(self, tag):
            if tag not in inline:
                self.end_block()
            open_tags.pop()

        def handle_data(self, data):
            if any(t == "article" for t, _ in open_tags) and not any(gone for _, gone in open_tags):
                self.text += data

    parser = Parser(convert_charrefs=True)
    parser.feed(page)
    parser.end_block()
    return "\n\n".join(out)


def test_random_pages_against_another_parser(spark):
    import random

    rng = random.Random(11)
    words = ["sea", "sky &amp; land", "a &lt; b", "caf&eacute;", "x&#233;y", "&nbsp;", "two  spaces", "1 &gt; 0\n"]

    def inline(depth=0):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
        kind = rng.choice(["", "", "b", "a", "i", "br"])
        return text if not kind or depth > 2 else f"{text} <br> {text}" if kind == "br" else f"<{kind}>{inline(depth + 1)}</{kind}> {text}"

    def block(depth):
        tag = rng.choice(["p", "p", "div", "section", "ul", "h2", "blockquote", "nav", "aside", "form", "script"])
        attrs = rng.choice(["", "", "", ' class="ad"', ' class="with-sidebar wide"', ' class="ad-hoc"', ' role="search"', " hidden", ' class="promo x"', ' class="lead"', ' id="q7"'])
        if tag == "script":
            return "<script>var a = 1;</script>"
        if tag == "ul":
            return f"<ul{attrs}>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        if tag in ("p", "h2") or depth > 3:
            return f"<{'p' if depth > 3 else tag}{attrs}>{inline()}</{'p' if depth > 3 else tag}>"
        return f"<{tag}{attrs}>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    rows = []
    for k in range(150):
        article = f"<article><h1>{inline()} {k}</h1>" + "".join(block(0) for _ in range(rng.randrange(1, 7))) + f"<p>End {k}.</p></article>"
        around = rng.choice(["{}", '<div class="no-sidebar">{}</div>', '<div id="header-fixed"><div>{}</div></div>'])
        page = f"<html><head><title>t {k}</title></head><body><nav><a>Home</a></nav>{around.format(article)}<div>More</div><footer>F {k}</footer></body></html>"
        rows.append((k, f"http://r{rng.randrange(90)}.example.org/{k}", page))
    got = extract(spark, rows)
    for k, _, page in rows:
        assert got[k] == plain_blocks(page), page
