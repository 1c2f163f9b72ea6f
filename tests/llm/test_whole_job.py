"""Cases in which an operator once did less than the whole job."""

from blockloom.llm import htmltext, linededup, neardup, secrets


def test_wrapper_around_articles_stays(spark):
    page = "<body><div id=page><header>site</header><div><span><{0}>Text number {1}</{0}></span></div><footer>end</footer></div></body>"
    pages = [(k, f"http://{tag}.example/{k}", page.format(tag, k)) for tag in ("article", "main") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (500_000, 0):
        rows = htmltext.extract(df, broadcast_keys=limit).collect()
        assert len(rows) == 24
        assert all(r.text == f"Text number {r.page_id}" for r in rows)


def test_quotes_in_attributes():
    def text(page):
        return htmltext.main_text(htmltext.parse(page))

    assert text("""<article><p><a title="Don't">one</a> two <img alt="Tom's">three</p><p>it's four</p></article>""") == "one two three\n\nit's four"
    assert text("""<p title='say "hi'>one</p><p>two "quoted" words</p>""") == 'one\n\ntwo "quoted" words'
    assert text('<p data-x="' + "a>b " * 10_000 + '">one</p>') == "one"
    assert text("""<p a=b'c d = 'x>y' e/f="z>" g>one</p>""") == "one"
    assert text("""<p title="never closed>one</p><p>two</p>""") == "one\n\ntwo"
    assert text("""<p title="see class=ad">one</p><div Class = 'x AD'>two</div><div id=ad>three</div>""") == "one"
    assert text("<p x=' " * 50_000) == text('<p x="' + "'" * 200_000) == ""


def test_attributes_against_a_state_machine():
    import random

    def end(page, at):
        """The tokenizer of the HTML standard, for tags whose quotes are closed; None if one isn't."""
        state = "before"
        while at < len(page):
            c = page[at]
            if state in "\"'":
                state = "before" if c == state else state
            elif c == ">":
                return at
            elif state == "value":
                state = c if c in "\"'" else state if c.isspace() else "bare"
            elif state == "bare":
                state = "before" if c.isspace() else state
            elif c == "/":
                state = "before"
            elif c.isspace():
                state = "after" if state in ("name", "after") else "before"
            elif c == "=" and state != "before":
                state = "value"
            else:
                state = "name"
            at += 1
        return None if state in "\"'" else -1

    r = random.Random(5)
    pages = ["".join(r.choice("ab=/ >\"'") for _ in range(r.randint(1, 16))) for _ in range(50_000)]
    judged = [(page, want) for page in pages if (want := end(page, 0)) is not None]
    assert len(judged) > 20_000
    for page, want in judged:
        assert htmltext._tag_end(page, 0) == want, page


def test_blocks_that_recur_in_articles_go(spark):
    page = "<body><{0}><div><section><h1>Title {1}</h1><div class=x1><p>Follow us on every channel</p></div><p>Text number {1}</p></section></div></{0}></body>"
    pages = [(k, f"http://{tag}.example/{k}", page.format(tag, k)) for tag in ("article", "main") for k in range(12)]
    pages += [(100 + k, f"http://few.example/{k}", page.format("article", k)) for k in range(9)]
    pages += [(200 + k, f"http://copies.example/?{k}", page.format("article", 0)) for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    own, notice = "Title {0}\n\n{1}Text number {0}", "Follow us on every channel\n\n"
    want = {k: own.format(k, "") for k in range(12)} | {100 + k: own.format(k, notice) for k in range(9)} | {200 + k: own.format(0, notice) for k in range(12)}
    for limit in (500_000, 0):
        assert {(r.page_id, r.text) for r in htmltext.extract(df, broadcast_keys=limit).collect()} == set(want.items())


def test_passages_count_by_documents(spark):
    passage = "\n".join(f"line {w} of the notice here" for w in ("one", "two", "three", "four", "five"))
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    # Lines of equal length that differ in one word would be a template of the tree, so the own lines differ in all.
    rows = [(k, f"{passage}\nown {n} text {n[::-1]} follows {n[1:]}") for k, n in enumerate(names)]
    alone = "\n".join(f"the same line again and again\nanother {n} line in between" for n in names)  # one document's own template
    shared = "a line of two documents only"
    rows += [(10, alone), (11, f"{shared}\nthen the words of one"), (12, f"{shared}\nthen the words of another")]
    rows += [(20 + k, "copies of a whole document stay\nwith both of their lines") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in linededup.drop_lines(df).collect()}
    assert got.pop(0) == (0, rows[0][1])
    for k, n in list(enumerate(names))[1:]:
        assert got.pop(k) == (5, f"own {n} text {n[::-1]} follows {n[1:]}")
    assert got == {d: (0, text) for d, text in rows[5:]}


def test_borderline_pair_that_leaders_leave_apart(spark):
    def edited(mark, places):
        words = [f"w{k}" for k in range(375)]
        for p in places:
            words[p] = mark
        return " ".join(words)

    # 341 of 401 shingles in common, but 53 of 80 coordinates; the groups of copies lead all four common buckets.
    rows = [(1, edited("z0x4", (19, 204, 254))), (2, edited("z0x240", (42, 96, 143)))]
    for g in range(8):
        own = [150 + 3 * g, 220 + 3 * g, 270 + 3 * g, 310 + 3 * g]
        for k in range(8):
            words = edited(f"g{g}", own).split()
            words[340 + 3 * k] = f"g{g}k{k}"
            rows.append((100 * (g + 1) + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {d: 1 if d < 100 else d // 100 * 100 for d, _ in rows}


def test_long_secrets_are_whole():
    import random

    r = random.Random(2)
    for size in (201, 350, 900, 50_000):
        value = "eyJ" + "".join(r.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789-_.") for _ in range(size - 3))
        text = f'set token = "{value}" and go on'
        assert [text[a:b] for a, b in secrets.candidates(text)] == [value]


def test_equal_pages_keep_their_text(spark):
    """Without an article: pages crawled often are one page each, and menus fall to their count alone."""
    body = "<body><div class=x1><a>Start</a><a>Shop</a></div><div class=x2><p>Text of page {0}</p><p>More of {0}</p></div></body>"
    pages = [(k, "http://crawled.example/a", body.format("only")) for k in range(15)]
    pages += [(100 + k, f"http://site.example/{k}", body.format(k)) for k in range(12)]
    pages += [(200 + k, None if k % 2 else "no url", body.format(k)) for k in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    menu = "StartShop\n\n"
    want = {k: f"{menu}Text of page only\n\nMore of only" for k in range(15)} | {100 + k: f"Text of page {k}\n\nMore of {k}" for k in range(12)}
    want |= {200 + k: f"{menu}Text of page {k}\n\nMore of {k}" for k in range(24)}
    for limit in (500_000, 0):
        assert {r.page_id: r.text for r in htmltext.extract(df, broadcast_keys=limit).collect()} == want


def test_templates_against_a_plain_count(spark, small):
    """Counting different pages by host in a dictionary finds the same hashes."""
    from collections import defaultdict

    boxes = ["<div class=q{0}><p>Read all of series {0} here</p></div>".format(k) for k in range(4)]
    made = [(k, f"https://{'ab'[k % 2]}.example/{k}", f"<body><article><p>Own words of {k}</p>{boxes[k % 3]}{boxes[3] if k % 5 else ''}</article></body>") for k in range(60)]
    df = small("pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(made, "page_id long, url string, html string"))
    tops, rows = defaultdict(set), df.collect()
    for r in rows:
        if r.html and (host := htmltext.host_of(r.url)):
            for key, top in htmltext.subtree_hashes(htmltext.parse(r.html), host, htmltext.page_hash(r.html)):
                tops[key].add(top)
    gone = {k for k, v in tops.items() if len(v) >= htmltext.MIN_PAGES}
    want, plain = {}, {}
    for r in rows:
        root = htmltext.parse(r.html or "")
        want[r.page_id] = htmltext.main_text(root, htmltext._template_elements(root, htmltext.host_of(r.url), gone))
        plain[r.page_id] = htmltext.main_text(root)
    assert {r.page_id: r.text for r in htmltext.extract(df).collect()} == want
    assert sum(want[k] != plain[k] for k, *_ in made) == 60
    assert all(want[k] == f"Own words of {k}" for k, *_ in made)
