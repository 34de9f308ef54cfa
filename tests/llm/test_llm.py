import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, html_extract, language, media, mixing, packing, quality, registry, sharding, simhash
from tests.oracle import SF, agree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the the the cat sat on the mat", "en", "a", 30), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "fr", "b", 3),
    (5, "x" * 5000 + " y" * 3000, "de", "b", 11000), (6, "the the the cat sat on the mat", "en", None, 30), (6, "the the the cat sat on the mat", "en", None, 30),
    (7, "é ü 漢字 😀 tab\tend", "es", "c", 17), (None, "no id here at all", "en", "a", 17),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], DOCS + ", fp string, size int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLES[name])


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ---------------------------------------------------------------- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs, got = texts(spark), defaultdict(list)
    for r in registry.QUERIES["op1_packing"](spark, SF).collect():
        got[r["doc_id"]].append(r)
    places, total = defaultdict(list), 0
    assert set(got) == set(docs)
    for d, text in docs.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        parts = sorted(got[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert len(ids) > 1024 or len(parts) == 1
        assert all(r["length"] == 1024 for r in parts[1:])
        for r in parts:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
            places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.02 * total / 1024 + 1


def test_encoder_agrees_on_odd_white_space():
    e = packing.Encoder()
    for t in ("a  b", "a   b", " a", "a ", "a \n b", "x\n y", "  a b", "don't we'll, 12 34.5!", "<|endoftext|> x", "  ", "é ü 漢字 😀"):
        assert e(t) == np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_plan_holds_the_histogram():
    h = Counter({n: 1 + n % 7 for n in range(1, 1025, 3)}) + Counter({700: 5000, 324: 100})
    held = Counter()
    for pattern, copies in packing.plan(h):
        assert copies > 0 and sum(n * m for n, m in pattern.items()) <= 1024
        for n, m in pattern.items():
            held[n] += m * copies
    assert held == h
    assert packing.plan({}) == []


def test_the_program_places_most_and_needs_no_more_than_best_fit(spark):
    """Lengths of the largest test table: its tokens below full length, by who places them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    h = {r["length"]: r["n"] for r in packing.pieces(docs).groupBy("length").agg({"*": "count"}).toDF("length", "n").collect()}
    tokens = sum(n * c for n, c in h.items() if n < 1024)
    placed, left = packing.programmed(h)
    assert all(sum(n * m for n, m in p.items()) == 1024 for p, _ in placed)
    assert sum(c * sum(n * m for n, m in p.items() if n < 1024) for p, c in placed) >= 0.8 * tokens
    copies = lambda patterns: sum(c for _, c in patterns)
    assert copies(placed) + copies(packing.best_fit(left, 1024)) <= copies(packing.best_fit(h, 1024))


def test_prices_against_brute_force():
    lengths, values = np.array([3, 4, 9]), np.array([2.0, 3.1, 7.0])
    best = packing.price(values, lengths, 30)
    for c in range(31):
        want = max(2.0 * a + 3.1 * b + 7.0 * d for a in range(11) for b in range(8) for d in range(4) if 3 * a + 4 * b + 9 * d <= c)
        assert best[c] == pytest.approx(want)


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(k, 1 + k % 9, k, 1, 2, 3, 4, 5) for k in range(40)]
    parts = spark.createDataFrame(rows, "doc_id long, length long, rank int, _rank int, _salt int, _n int, _row int, offset long")
    got = packing.pack(parts, 16).collect()
    assert sorted((r["doc_id"], r["length"], r["rank"], r["_rank"]) for r in got) == sorted(r[:4] for r in rows)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 16


def test_packing_odd(spark, odd, none):
    assert packing.pack_documents(odd).count() >= len(ODD)
    assert packing.pack_documents(none).count() == 0


# ---------------------------------------------------------------- html


def test_extraction():
    page = '<html><head><title>T</title></head><body><header>Site</header><nav><a>x</a></nav><div class="cookie-notice">We</div><article><h1>Head &amp; more</h1><p>One<br>two <b>bold<p>Next&nbsp;one<script>var a="</p>"</script><div class="ad">Buy</div><form>Go</form></article><section class="comments"><p>Nice</p></section><aside>Side</aside><footer>F</footer></body>'
    assert html_extract.extract(page, None) == "Head & more\n\nOne two bold\n\nNext one"
    assert html_extract.extract(None, None) == "" and html_extract.extract("<p>", None) == ""


def test_induction_drops_what_stays_the_same():
    page = lambda k: f"<html><body><div>Welcome to our site</div><div>{f'story {k} ' * 9}</div><div>{f'more {k}{k} ' * 7}</div><div>Bye</div></body></html>"
    template, seen = html_extract.induce([page(k) for k in range(5)])
    t = html_extract.Template.unpacked(json.loads(json.dumps(template.packed(3))))
    assert html_extract.extract(page(8), t, seen) == ("story 8 " * 9).strip() + "\n\n" + ("more 88 " * 7).strip()


def templated(pages):
    pdf = html_extract.pd.DataFrame({"host": "h", "bucket": range(len(pages)), "html": pages})
    got = html_extract._induce(pdf)
    return (html_extract.Template.unpacked(json.loads(got["template"][0])), int(got["seen"][0])) if len(got) else (None, 0)


def test_constant_prose_goes_from_named_articles():
    page = lambda k: f"<article><h1>Head {k}</h1><p>{f'story {k} ' * 9}</p>{'<p>A saying</p>' if k < 2 else ''}<ul><li>Sign up for our letter</li></ul><p>All rights are ours</p></article>"
    t, seen = templated([page(k) for k in range(6)])
    assert html_extract.extract(page(1), t, seen) == "Head 1\n\n" + ("story 1 " * 9).strip() + "\n\nA saying"
    assert html_extract.extract(page(9), t, seen) == "Head 9\n\n" + ("story 9 " * 9).strip()
    t, seen = templated([page(k) for k in (0, 1)])  # two pages are too few to take prose from named articles
    assert html_extract.extract(page(1), t, seen).endswith("All rights are ours")


def test_templates_of_boilerplate_and_of_two_pages():
    menu = "".join(f"<div class=x>part {k} of the site</div>" for k in range(12))
    page = lambda k: f"<div>{menu}</div><div>story {k}</div>"
    t, seen = templated([page(k) for k in range(6)])
    assert seen == 6 and html_extract.extract(page(7), t, seen) == "story 7"
    linked = "<ul>" + "".join(f"<li><a href=x>go {k}</a></li>" for k in range(12)) + "</ul>"
    two = lambda k: f"{linked}<div>Welcome</div><div>one {k}</div><div>two {k}</div>"
    t, seen = templated([two(1), two(2)])
    assert seen == 2 and html_extract.extract(two(3), t, seen) == "one 3\n\ntwo 3"
    copies = ["<div>" + "".join(f"<p>line {i} of a story</p>" for i in range(9)) + f"<p>copy {k}</p></div>" for k in range(2)]
    assert templated(copies) == (None, 0)


def test_long_lists_are_matched_like_short_ones():
    rng = np.random.default_rng(5)
    some = lambda n: "".join(f"<{t}>{w}</{t}>" for t, w in zip(rng.choice(["p", "div", "section"], n), rng.choice(list("abcdefgh"), n)))
    weigh = lambda pairs: sum(2 if n.mark in at.texts else 1 for n, at in pairs)
    for n in (1, 7, 30, 60):
        page, t = html_extract.parse(some(n)), html_extract.Template.of(html_extract.parse(some(40)))
        short, long = html_extract.align(page, t), html_extract.align(page, t, most_cells=0)
        assert weigh(short) == weigh(long) and [n.text for n, _ in short] == [n.text for n, _ in long]
    flat = lambda k, n: "".join(f"<p>words {k} {i}</p>" for i in range(n)) + "<p>Sign up here</p><p>All rights reserved</p>"
    template, seen = html_extract.induce([flat(k, 150 + k) for k in range(5)])
    text = html_extract.extract(flat(9, 140), html_extract.Template.unpacked(template.packed(3)), seen)
    assert text.endswith("words 9 139") and text.count("words") == 140


def test_ends_that_are_left_out():
    e = lambda h: html_extract.extract(h, None)
    assert e("<html><head><title>T</title><body><p>Hello world text</p></body></html>") == "Hello world text"
    assert e("<head><meta charset=x><title>T</title><p>One") == "One" and e("<head><title>T</title>Two <span>words</span>") == "Two words"
    assert e("<article><p>Body text.</p><table class='menu prices'><tr><th>Soup<td>4<tr><th>Bread<td>2</table></article>") == "Body text.\n\nSoup\n\n4\n\nBread\n\n2"
    assert e("<article><p>One <span class='ad' hidden>Buy <b>now</b></span> two <i hidden>x<p>Three <b>four</b></p></article>") == "One two\n\nThree four"
    assert e("<article><p>One</p><ul class='share'><li><a>x</a><li><a>y</a></ul><div class='related'>Two</div><p class='ad'>Buy</p></article>") == "One"
    assert e("<div class='has-sidebar'><article><p>One</p></article></div><div class=sidebar>x</div>") == "One"
    assert e("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "a\n\nb\n\nc\n\nd"


#: Pages and their main texts, written by hand: class words of blogs and frameworks, forms around pages, elements inside a run.
BY_HAND = [
    ('<article class="post hentry comments-open"><h1>T</h1><p>Body</p></article>', "T|Body"),
    ('<div class="post has-comments"><p>Body</p></div><div class="comments"><p>Nice</p></div>', "Body"),
    ('<article class="post promo-2019"><p>Body</p></article>', "Body"),
    ('<article class="post-17 post type-post status-publish format-standard category-ads tag-promo"><p>Body</p></article>', "Body"),
    ('<main><section class="alert-design"><p>On alerts</p></section></main>', "On alerts"),
    ('<article><p>One</p><section class="related-work"><h2>Related work</h2><p>Two</p></section></article>', "One|Related work|Two"),
    ('<article><p>One</p><section class="related-posts"><h2>More</h2><p>Two</p></section><div class="shareButtons">Share</div></article>', "One"),
    ('<article><p>One</p><section class="related-work"><a href=x>Link one</a><a href=y>Link two</a></section></article>', "One"),
    ("<article><header><div><h1>Title</h1></div></header><p>Body</p></article>", "Title|Body"),
    ("<article><header><div><span>By me</span></div></header><p>Body</p></article>", "Body"),
    ("<header><div><h1>Site</h1></div></header><article><p>Body</p></article>", "Body"),
    ("<article><p>Hello <script>var x</script>world again</p></article>", "Hello world again"),
    ("<article><p>Hello <button>Buy</button>world <video>no <p>video</video>again</p></article>", "Hello world again"),
    ("<article><p>One <my-tag>two</my-tag> <picture><source><img></picture>three <math><mi>x</mi></math></p></article>", "One two three x"),
    ("<article><p><ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby> here</p></article>", "kan(ji) here"),
    ('<article><p>One</p><div style="color: red; display:none">secret</div><p style="visibility: hidden">gone</p></article>', "One"),
    ("<form method=post><div><h1>Title</h1><p>All of the text of the page</p></div><div class=menu><a>x</a></div></form>", "Title|All of the text of the page"),
    ("<form><div class='main-content'><p>Body</p></div></form>", "Body"),
    ("<h1>Log in</h1><p>Welcome back to all of you here</p><form><p>Name <input></p></form>", "Log in|Welcome back to all of you here"),
    ("<article><p>One</p><form><h2>Join</h2><p>Mail</p></form></article>", "One"),
    ('<article><p>One</p></article><section id="respond"><p>Write</p></section><article class="comment byuser depth-1"><p>Nice</p></article>', "One"),
    ('<article><p>One</p><ol class="commentlist"><li id="comment-55"><p>Nice</p></li></ol></article>', "One"),
    ('<div class="content no-sidebar"><article><p>One</p></article></div><div class="sidebar"><p>x</p></div>', "One"),
    ('<article class="post ad"><p>Buy</p></article><article><p>One</p></article>', "One"),
    ('<article class="ad-box"><p>Buy</p></article><article><p>One</p></article>', "One"),
    ("<article><p>One <noscript><p>no</p></noscript>two</p></article>", "One two"),
    ("<article><p>One</p><div><button>Never closed</div><p>Two</p></article>", "One|Two"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><dl><dt>e<dd>f</dl></article>", "a|b|c|d|e|f"),
    ("<article><p>One<select><option>x<option>y</select> two</p><hr><blockquote>Said</blockquote></article>", "One two|Said"),
    ("<main><p>One</p><div class='newsletter-signup'><p>Join</p></div><div class='cookie-notice'>We</div><div class='social-history'><p>Two</p></div></main>", "One|Two"),
    ("<body><div><p>Only text</p></div><script>x()</script><template><p>no</p></template></body>", "Only text"),
    ("<article><p>A&amp;B &#8212; c&nbsp;d\n\t e</p><textarea>x</textarea></article>", "A&B \u2014 c d e"),
]


@pytest.mark.parametrize("page,want", BY_HAND)
def test_pages_by_hand(page, want):
    assert html_extract.extract(page, None).split("\n\n") == want.split("|")


def test_matching_against_brute_force():
    """The weight of simple tree matching by its definition, on random small trees."""
    rng = np.random.default_rng(11)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else rng.choice(list('ab'))}</{t}>" for t in rng.choice(["div", "section"], rng.integers(0, 4))) or str(rng.choice(list("ab")))

    def weight(x, y):
        if x.tag == "#":
            return 2 if x.mark in y.texts else 1

        def best(i, j):
            if i == len(x.kids) or j == len(y.kids):
                return 0
            with_ = weight(x.kids[i], y.kids[j]) + best(i + 1, j + 1) if (x.kids[i].tag, x.kids[i].name) == (y.kids[j].tag, y.kids[j].name) else 0
            return max(with_, best(i + 1, j), best(i, j + 1))

        return 1 + best(0, 0)

    for _ in range(100):
        x, y = html_extract.parse(some(2)), html_extract.Template.of(html_extract.parse(some(2)))
        for cells in (20_000, 0):
            assert html_extract.matchings(x, y, cells)[id(x), id(y)][0] == weight(x, y)


def unnamed(html, around):
    """A page without any name: every element of the body that is not prose is a div; menu, advert and footer are those of ``around``."""
    cut = lambda h: html_extract.re.search(r"(?s)(.*?<body>)(.*?)(<article>.*</article>)(.*)", h).groups()
    (head, _, article, _), (_, top, _, bottom) = cut(html), cut(around)
    return head + html_extract.re.sub(r"<(/?)(?:nav|article|footer|ul|li|a|div)\b[^>]*>", r"<\1div>", top + article + bottom)


def test_the_template_decides_where_nothing_is_named(spark):
    """Real articles, all names taken away, each within the menu, advert and footer of its host's first page: the template finds what names told before.

    The pages as they are have other menus, adverts and footers each, so their hosts show no constant text at all.
    """
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").withColumn("host", html_extract.host_of("url")).toPandas()
    pages = pages[pages.groupby("host")["html"].transform("size") >= 3]
    first = pages.groupby("host")["html"].transform("first")
    bare = pages.assign(html=[unnamed(h, f) for h, f in zip(pages["html"], first)])
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(bare)).collect()}
    alone = {k: html_extract.extract(h, None) for k, h in zip(bare["page_id"], bare["html"])}
    want = {k: html_extract.extract(h, None) for k, h in zip(pages["page_id"], pages["html"])}
    boiler = lambda got, k: len(set(got[k].split("\n\n")) - set(want[k].split("\n\n")))
    lost = sum(len(set(want[k].split("\n\n")) - set(got[k].split("\n\n"))) for k in want)
    assert sum(got[k] != alone[k] for k in want) >= 0.5 * len(want)
    assert sum(boiler(got, k) for k in want) < 0.5 * sum(boiler(alone, k) for k in want)
    assert lost <= 0.01 * sum(len(t.split("\n\n")) for t in want.values())


def test_deep_pages_pass_through(spark):
    deep = lambda k: "<div>" * 10_000 + f"<p>story {k} of this site</p>" + "</div>" * 10_000 + "<div>All rights</div>"
    d = spark.createDataFrame([(k, "http://h/x", deep(k), "x", "y", 1) for k in range(4)], "page_id long, url string, html string, host string, template string, seen int")
    for shipped in (1 << 24, 0):
        assert sorted((r["page_id"], r["text"]) for r in html_extract.extract_pages(d, shipped).collect()) == [(k, f"story {k} of this site") for k in range(4)]


def test_layouts_have_templates_of_their_own():
    one = lambda k: f"<div class=a><div>Welcome to us</div><div>story {k}</div><div>more {k}</div></div>"
    two = lambda k: f"<section class=b><h2>Our shop</h2><section>item {k}</section><section>price {k}</section><section>Buy here</section></section>"
    found = html_extract.layouts([one(k) for k in range(4)] + [two(k) for k in range(4)])
    known = [(html_extract.Template.unpacked(json.loads(json.dumps(t.packed(2)))), seen) for t, seen in found]
    assert [seen for _, seen in known] == [4, 4]
    assert html_extract.extract_by(one(9), known) == "story 9\n\nmore 9" and html_extract.extract_by(two(9), known) == "item 9\n\nprice 9"


def test_pages_odd(spark):
    d = spark.createDataFrame([(1, None, None, 1), (2, "http://h/x", "", 2), (2, "http://h/x", "<article>a</article>", 3), (3, "bad", "<p>t</p>", 4)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(d).collect()) == [(1, "", 0), (2, "", 0), (2, "a", 1), (3, "t", 1)]
    assert html_extract.extract_pages(d.limit(0)).count() == 0


# ---------------------------------------------------------------- language


def test_language(spark, odd, none):
    got = registry.QUERIES["op3_language"](spark, SF)
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in got.collect()}
    assert set(found) == set(want)
    assert sum(found[d]["language"] == want[d] for d in want) >= 0.98 * len(want)
    r = {x["doc_id"]: x for x in language.identify_documents(odd).collect()}
    assert not r[2]["accepted"] and not r[3]["accepted"] and not r[4]["accepted"] and r[1]["language"] == "en"
    assert language.identify_documents(none).count() == 0
    assert set(language.keep_identified(odd).columns) == set(odd.columns)


def test_text_decides_where_declarations_are_missing_or_wrong(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    langs, model = language.fit(docs)
    said = docs.where("length(text) > 200").selectExpr("doc_id", "text", "lang AS truth", "cast(null AS string) AS address", "'h' AS host")
    for declared in (F.lit(None).cast("string"), F.when(F.col("truth") == "en", "fr").otherwise("en")):
        got = language.identify(said.withColumn("declared", declared), ["doc_id", "truth"], langs, model, ["host"]).collect()
        assert sum(r["language"] == r["truth"] for r in got) >= 0.97 * len(got)


def test_languages_are_bounded(spark):
    rows = [(k, f"words of kind {k % 3} and more", ("en", "en", "de")[k % 3], "a", 1) for k in range(60)] + [(100 + k, "noise text", f"junk{k}", "a", 1) for k in range(50)]
    d = spark.createDataFrame(rows, DOCS)
    assert language.fit(d, most=2)[0] == ["de", "en"]
    assert language.identify_documents(d).count() == len(rows)


def test_pages_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = language.fit(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert language.identify_pages(pages, langs, model).count() == pages.count()


def test_pages_language_by_all_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = [(r["text"], r["lang"]) for r in docs.where("length(text) between 300 and 3000").orderBy("doc_id").limit(60).collect()]
    rows, want = [], {}
    for k, (text, lang) in enumerate(said):  # the text stands against a wrong declaration
        rows.append((k, f"http://h{k}.example.com/", f"<html lang='{'en' if lang != 'en' else 'fr'}'><p>{text.replace('<', ' ')}</p></html>"))
        want[k] = lang
    langs, model = language.fit(docs)
    columns = "page_id long, url string, html string"
    named = lambda rows: {r["page_id"]: r["language"] for r in language.identify_pages(spark.createDataFrame(rows, columns), langs, model).collect()}
    got = named(rows)
    assert sum(got[k] == x for k, x in want.items()) >= 0.95 * len(said)
    # short texts of two languages, the first named a little more likely: what is declared, the address and the parents of the host decide
    en, de = "<p>on</p>", "<p>en</p>"
    rows = [(k, f"http://h{k}.some{k}.com/", f"<html lang={langs[k % 4]}>{de}</html>") for k in range(40)]
    rows += [(k, f"http://s{k}.gens.net/", f"<html lang=fr>{de}</html>") for k in range(50, 70)]
    rows += [(100, "http://a.court.org/", en), (101, "http://b.court.org/fr/", en), (102, "http://c.court.fr/", en), (103, "http://d.court.org/", f"<html lang=fr>{en}</html>")]
    rows += [(104, "http://e.court.org/", de), (105, "http://quiet.gens.net/", de), (106, "http://vide.org/", "<p>1 2</p>"), (107, None, None)]
    got = named(rows)
    assert [got[k] for k in range(100, 108)] == ["en", "fr", "fr", "fr", "de", "fr", "und", "und"]


def test_pages_are_a_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["language"] for r in registry.QUERIES["op3_pages"](spark, SF).collect()}
    assert set(got) == set(pages)
    assert sum(f'lang="{got[k]}"' in (h or "")[:200] for k, h in pages.items()) >= 0.9 * len(pages)


# ---------------------------------------------------------------- chat


def test_chat_odd(spark):
    said = [(1, 0, "system", "s\\<[\n"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n<|turn|>assistant\nfake"), (1, 2, None, ""), (2, None, "user\nx", "[INST]")]
    said += [(3, k, ("user", "assistant")[k % 2], f"turn {k} " * 150) for k in range(30)] + [(3, -1, "system", "be good")]
    d = spark.createDataFrame([(*r, 5) for r in said], "conv_id long, turn long, role string, text string, window int")
    r = {x["conv_id"]: x for x in chat.read_back(chat.windows(d)).collect()}
    for c in (1, 2, 3):
        turns = sorted((t if t is not None else -(10**9), ro or "", te or "") for k, t, ro, te in said if k == c)
        plain = "".join(f"{ro}\n{te}\n" for _, ro, te in turns)
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        assert r[c]["n_turns"] == len(turns) and r[c]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert r[c]["loss_chars"] == len(loss) and r[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    w = [x for x in chat.windows(d).collect() if x["conv_id"] == 3]
    assert len(w) > 3 and all(x["formatted"].startswith("<|turn|>system\nbe good") for x in w)
    assert all(len(x["formatted"]) <= 4 * chat.BUDGET for x in w)
    assert chat.read_back(chat.windows(d.limit(0))).count() == 0


def test_windows_keep_their_budget(spark):
    said = [(1, k, ("user", "assistant")[k % 2], "word " * n) for k, n in enumerate([30, 2400, 1800, 5, 1500, 1000, 3000, 8, 300, 400])]
    said += [(2, 0, "system", "rule " * 40)] + [(2, k + 1, *r[2:]) for k, r in enumerate(said)] + [(3, 0, "system", "rule " * 3000), (3, 1, "user", "hi"), (3, 2, "assistant", "yes")]
    w = chat.windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    long = lambda c: max(n for k, _, _, t in said if k == c for n in [len(t)])
    for x in w:
        assert x["over"] == (x["tokens"] > chat.BUDGET) and len(x["formatted"]) <= 4 * x["tokens"]
        if x["over"]:
            assert x["formatted"].count(chat.OPEN) == (2 if x["conv_id"] == 2 else 1) or x["conv_id"] == 3
    assert long(1) > 4 * chat.BUDGET and sum(x["over"] for x in w if x["conv_id"] == 1) == 3  # the turns of over 8192 characters
    back = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).collect()}
    assert back == {1: 10, 2: 11, 3: 3}


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_against_brute_force(spark):
    docs = sorted(texts(spark).items())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"), 7).collect()}
    assert len(got) == len(docs)
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        e = fingerprint.edited(text, after)
        r, sk = got[d], lambda t: fingerprint.sketch(fingerprint.Prefix(fingerprint.codes_of(t)))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (sk(text), sk(e))
        assert r["near_edited"] == fingerprint.likeness(sk(text), sk(e)) and r["near_next"] == fingerprint.likeness(sk(text), sk(after))


def test_common_extension():
    x, y = (fingerprint.Prefix(fingerprint.codes_of(t)) for t in ("abcdefgh", "zzcdefXh"))
    assert fingerprint.common_extension(x, 2, y, 2) == 4 and fingerprint.common_extension(x, 0, y, 0) == 0
    assert x.span(3, 2) == fingerprint.Prefix(fingerprint.codes_of("de")).span(0, 2)


def test_fingerprints_odd(spark, odd, none):
    assert fingerprint.fingerprints(odd).count() == len(ODD)
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_a_hot_id_is_cut_by_hashes(spark):
    rows = [(k if k % 2 else 5, f"text {k} " * (1 + k % 7)) for k in range(200)] + [(None, f"nil {k} " * 9) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.fingerprints(d, 9).collect()
    hashes = {r["text"]: r["h"] for r in d.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    want = [(d, hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (d, t) in enumerate(order)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    dealt = fingerprint.with_followers(d, 9)
    assert dealt.where("not guard").groupBy("pid").count().agg({"count": "max"}).first()[0] < 100


# ---------------------------------------------------------------- media


def test_media(spark, odd, none):
    docs = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    got = media.document_media(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = docs[r["doc_id"]].encode()
        p = media.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.store(p)).hexdigest() and len(p) % 192 == 0
    assert media.document_media(none).count() == 0


def test_sequences_keep_order_and_captions():
    items = media.sequence_of('<p>One</p><figure><img src="sha256:ab" alt="x"><figcaption>Two &amp; three</figcaption></figure>end<img src="u">')
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "One", None), (1, "media", None, "Two & three"), (2, "text", "end", None), (3, "media", None, None)]
    assert items[1]["digest"] == "ab" and media.sequence_of(None) == []
    told = lambda h: [(i["kind"], i["text"] or i["caption"]) for i in media.sequence_of(h)]
    assert told("<figure><figcaption>C</figcaption><img src=x></figure>") == [("media", "C")]
    assert told("<figure><img src=a><img src=b><figcaption>Both</figcaption></figure><table><tr><td>x<td>y</table>") == [("media", "Both"), ("media", "Both"), ("text", "x"), ("text", "y")]
    assert told("<figure><figcaption>Alone</figcaption></figure>a<br>b<figure><img src=c alt=d>") == [("text", "Alone"), ("text", "a b"), ("media", "d")]


def test_page_media(spark):
    pages = spark.createDataFrame([(1, "<p>One</p><img src='sha256:ab'>", "x"), (2, None, "y"), (2, "<img src='sha256:zz' alt=q>two", "z")], "page_id long, html string, media string")
    stored = media.store(media.padded(b"abc"))
    table = spark.createDataFrame([("ab", bytearray(stored)), ("ab", bytearray(stored))], "digest string, media binary")
    got = sorted((r["page_id"], r["position"], r["kind"], r["text"], r["digest"], r["payload_bytes"]) for r in media.page_media(pages, table).collect())
    assert got == [(1, 0, "text", "One", None, None), (1, 1, "media", None, "ab", 192), (2, 0, "media", None, "zz", None), (2, 1, "text", "two", None, None)]
    all_ = registry.QUERIES["op6_pages"](spark, SF)
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert all_.count() == sum(len(media.sequence_of(h)) for h in html.values())


def test_the_feature_by_its_definition():
    rng = np.random.default_rng(2)
    for h in (1, 3, 8, 30):
        x = rng.integers(0, 256, (h, 192)).astype(np.uint8)
        cells = [[x[i * h // 8 : max(i * h // 8 + 1, (i + 1) * h // 8), 192 * j // 9 : 192 * (j + 1) // 9].astype(float).sum(axis=1).mean() for j in range(9)] for i in range(8)]
        bits = "".join("1" if row[j] > row[j + 1] else "0" for row in cells for j in range(8))
        assert media.feature(x) == f"{int(bits, 2):016x}"


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [x for x in labels if got[x["doc_id"]]["held_out"]]
    assert sum(got[x["doc_id"]]["predicted"] == x["quality"] for x in held) >= 0.95 * len(held)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == len(ODD) and quality.score(none, model).count() == 0
    assert quality.keep_good(odd, labels).schema == odd.schema


def test_discriminant_by_its_definition():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.4).astype(float)
    x = rng.normal(size=(400, quality.FEATURES)) * (1 + y[:, None]) + y[:, None] * rng.normal(size=quality.FEATURES)
    d = quality.Discriminant(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    covariance = lambda rows: (rows - rows.mean(axis=0)).T @ (rows - rows.mean(axis=0)) / len(rows)
    pooled = sum(covariance(z[y == k]) * (y == k).mean() for k in (0, 1))
    density = []
    for k in (0, 1):
        s = 0.7 * covariance(z[y == k]) + 0.3 * pooled + 0.02 * np.eye(quality.FEATURES)
        off = z - z[y == k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off) - 0.5 * np.linalg.slogdet(s)[1])
    margin = np.clip(density[1] - density[0], -60, 60)
    assert np.allclose(d._margin(x), margin)
    q = d.score(x)  # calibrated: the held-back logistic fit has no slope left
    assert abs(((q - y) * margin).sum() + 1e-2 * d.a) < 1e-4 and abs((q - y).sum()) < 1e-4
    assert ((q >= 0.5) == (y == 1)).mean() > 0.9
    one = quality.Discriminant(x, np.ones(400))
    assert (one.score(x[:3]) == 1).all()


# ---------------------------------------------------------------- mixing


def test_mixing(spark, odd, none):
    got = registry.QUERIES["op8_mixing"](spark, SF).collect()
    src = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        size[src[r["doc_id"]]] += r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
        target[src[r["doc_id"]]] = r["target"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    share, full, left = {}, set(), float(sum(size.values()))
    while True:
        w = sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and left * weight[s] / w > 3 * size[s]}
        if not over:
            share |= {s: left * weight[s] / w for s in size if s not in full}
            break
        share |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        full |= over
    for s in size:
        assert target[s] == pytest.approx(share[s]) and taken[s] == pytest.approx(target[s], rel=0.03)
    again = registry.QUERIES["op8_mixing"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    r = mixing.mix(odd).collect()
    assert len(r) == len(ODD) and all(x["taken"] == 0 for x in r if x["size"] == 0)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_small_sources_reach_their_targets_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", (1 << 12, 1 << 16))  # blocks as large as big tables have
    sizes = {f"s{k:02}": n for k, n in enumerate((90_000, 700, 5, 4096, 5000, 40, 1300, 9000, 256, 20_000, 3, 1))}
    rows = [(1000 * k + j, "w " * (n // 4 + (j < n % 4)), "en", s, 0) for k, (s, n) in enumerate(sizes.items()) for j in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    got, source = mixing.mix(docs).collect(), {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    text = Counter()
    for r in mixing.mixed_documents(docs).collect():
        text[r["source"]] += len(r["text"].split())
    twins = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "e f g h", "en", "s", 7), (1, "e f g h", "en", "s", 7), (None, "i j", "en", None, 3), (3, None, "en", "s", 0)], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in mixing.mixed_documents(twins).collect())
    assert got == sorted((r["doc_id"] or 0, r["text"]) for r in mixing.mixed_documents(twins).collect())
    assert {t[:3] for _, t in got} >= {"a b", "e f", "i j"} and sum(len(t.split()) for _, t in got) == sum(r["taken"] for r in mixing.mix(twins).collect())
    for s, n in sizes.items():
        block = max(1, min(4096, n // 256))
        assert abs(taken[s] - target[s]) <= block and text[s] == taken[s], s


# ---------------------------------------------------------------- sharding


def test_sharding(spark, odd, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = sharding.assign(d, 20_000).collect()
    assert len(r) == d.count()
    by = defaultdict(int)
    for x in r:
        by[x["shard"]] += x["n_bytes"]
    assert all(by[x["shard"]] == x["shard_bytes"] and (x["shard_bytes"] <= 20_000 or x["oversized"]) for x in r)
    names = sorted(by)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:  # no split was needless: a shard and what shares its parent are too much for one
        if s:
            assert sum(n for k, n in by.items() if k.startswith(s[:-1])) > 20_000
    assert sharding.assign(odd, 1000).where("oversized").count() == 1
    assert sharding.assign(odd).count() == len(ODD) and sharding.assign(none).count() == 0


def test_shards_are_written(spark, odd, tmp_path):
    d = odd.withColumn("shard", F.lit("clash"))
    sharding.write(d, str(tmp_path / "x"), 1000)
    back = spark.read.schema("doc_id long, text string, source string, shard string").parquet(str(tmp_path / "x")).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["source"] or "")
    assert [key(r) for r in sorted(back, key=key)] == [key(r) for r in sorted(odd.collect(), key=key)]
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign(odd, 1000).collect()}
    assert {(r["doc_id"], r["shard"] or "") for r in back} == want or len({s for _, s in want}) > 1


# ---------------------------------------------------------------- simhash


def brute(docs):
    fps = {d: simhash.fingerprint(t) for d, t in docs.items()}
    ids, root = sorted(docs), {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def test_fingerprint_bits():
    import xxhash

    words = "a b C d a b c d e".lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint("a b C d\ta b c d  e") == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_components_against_brute_force(spark, odd, none):
    docs = texts(spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op10_simhash"](spark, SF).collect()}
    assert got == brute(docs)
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0
    kept = sorted(r["doc_id"] for r in simhash.keep_one(odd.where("doc_id is not null")).collect())
    assert kept == sorted(set(b for _, b in brute({r[0]: r[1] for r in ODD if r[0] is not None}).values()))


def test_rows_are_kept_or_dropped_each_by_itself(spark, odd):
    docs = odd.union(odd.where("doc_id = 7").selectExpr("2 AS doc_id", "'another text that nobody copies' AS text", "lang", "source", "n_chars", "fp", "size"))
    fps = lambda rows: sorted(simhash.fingerprint(r["text"]) for r in rows)
    rows = docs.collect()
    distinct = set(fps(rows))
    assert all((a ^ b).bit_count() > 4 for a in distinct for b in distinct if a != b)
    kept = simhash.keep_one(docs).collect()
    assert fps(kept) == sorted(distinct)  # one row of every class of texts: those without an id and those that share one included
    assert {r["doc_id"] for r in kept} == {1, 2, 5, 7, None} and [r["source"] for r in kept if r["doc_id"] == 1] == ["a"]

    both = docs.where("doc_id = 1").selectExpr("2 AS doc_id", *docs.columns[1:]).union(docs.where("doc_id = 2 and text is null")).union(docs.where("doc_id is null"))
    said = language.keep_identified(docs.union(both)).collect()
    assert sum(r["doc_id"] == 2 and r["text"] == ODD[0][1] for r in said) == 1 and not any(r["text"] is None for r in said)


def test_large_groups_are_dealt_out(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 40, 300)} | {1 << int(k) | 5 << 50 for k in range(40)} | {5 << 50}
    d = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    want = brute_fps(sorted(fps))
    for leaves in (100, 8):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(d, leaves)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def brute_fps(fps):
    f = simhash.Forest(len(fps))
    for i, a in enumerate(fps):
        for j in range(i + 1, len(fps)):
            if (a ^ fps[j]).bit_count() <= 4:
                f.link(i, j)
    return {a: fps[f.root(i)] for i, a in enumerate(fps)}


# ---------------------------------------------------------------- pipeline


def test_stages_keep_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(language.keep_identified(docs)) == ids(language.identify_documents(docs).where("accepted"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(quality.keep_good(docs, labels)) == ids(quality.score(docs, quality.fit(docs, labels)).where("predicted = 1"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        mixed[r["source"]] += len([w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    want = Counter()
    for d, n in taken.items():
        want[source[d]] += n
    assert all(mixed[x] == want[x] for x in want if want[x])


@pytest.mark.parametrize("stored", [False, True])
def test_very_long_texts(spark, tmp_path, stored):
    long = "word " * 400_000
    d = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "short text", "en", "a", 10)], DOCS)
    if stored:
        d.write.parquet(f"{tmp_path}/d")
        d = spark.read.parquet(f"{tmp_path}/d")
    n = {r["doc_id"]: r["n_chars"] for r in fingerprint.fingerprints(d).collect()}
    assert n == {1: len(long), 2: 10}
    parts = packing.pack_documents(d).where("doc_id = 1")
    assert parts.agg(F.sum("length")).first()[0] > 400_000 and parts.agg(F.max("length")).first()[0] == 1024
    assert {r["doc_id"]: r["size"] for r in mixing.mix(d).collect()} == {1: 400_000, 2: 2}
    assert {r["doc_id"]: r["fp"] for r in simhash.fingerprints(d).collect()}[1] & (1 << 64) - 1 == simhash.fingerprint("word word word word")
    assert media.document_media(d).where("doc_id = 1").first()["n_bytes"] == len(long)


def test_ranges_follow_counted_rows(spark):
    """Whatever the plan says of its size: two rows of the driver, and a join, whose size no plan knows."""
    two = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert fingerprint.ranges_of(two) == 2 and fingerprint.ranges_of(two.limit(0)) == 1
    both = two.join(two.select("doc_id"), "doc_id")
    assert fingerprint.ranges_of(both) == 2
    got = {r["doc_id"]: (r["n_chars"], r["near_next"]) for r in fingerprint.fingerprints(both).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 3, 2: 0}


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs = raw
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == raw.columns and 0 < docs.count()
        if name == "near_dedup":
            t = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
            assert all(d == root for d, (_, root) in brute(t).items())
    assert p.run(spark, SF).count() > 0


def test_interleaved_documents_resolve(spark):
    rows = [(1, "a & <b>\none\nfig one\n\n  \ntwo words\nx\ny\nfig one"), (2, "t\nu\nfig one"), (3, None), (4, ""), (5, "p\nq\n" + "".join(f"{k}\n-\nmedia {k}\n" for k in range(30)))]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, kind string")
    pages, stored = media.interleaved(d)
    items = media.resolve(media.sequences(pages, "doc_id"), media.measured(stored)).collect()
    figures = [r for r in items if r["kind"] == "media"]
    missing = lambda line: zlib.crc32(line.encode()) % 10 == 0
    for doc, text in rows:
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        own = sorted((r for r in items if r["doc_id"] == doc), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(lines)))
        for r, (i, x) in zip(own, lines):
            if i % 3 == 2:
                digest = hashlib.sha256(media.padded(x.encode())).hexdigest()
                assert (r["kind"], r["digest"], r["caption"], r["payload_sha256"]) == ("media", digest, f"line {i}", None if missing(x) else digest)
            else:
                assert (r["kind"], r["text"]) == ("text", x.strip())
    assert 2 * sum(r["payload_bytes"] is not None for r in figures) > len(figures) > len({r["digest"] for r in figures})


def test_a_label_that_many_rows_repeat_is_one_row_of_the_fit(spark):
    texts = [(k, f"word {k} " * (k % 7 + 1)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    once = quality.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    often = quality.fit(spark.createDataFrame(texts + [texts[1]] * 200, "doc_id long, text string"), labels)
    x = np.array([quality.statistics(t) for _, t in texts])
    assert np.allclose(once.score(x), often.score(x))


def test_shares_of_ranks_follow_the_commonest_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 2)
    parts = spark.createDataFrame([(k, 3 if k % 5 else 5) for k in range(400)], "doc_id long, length long")
    places = defaultdict(list)
    for r in packing.pack(parts, 16).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, places.values())) == 400
    for spans in places.values():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 16
