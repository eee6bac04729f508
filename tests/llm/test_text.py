"""Main text and personal data on hand-written cases and against plain versions."""

import random
import re

from pyspark.sql import functions as F

from voxarbor.llm import privacy
from voxarbor.llm.mainpart import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style></head><body class="home">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu</a><li><a href=/b>Other</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all.</div><div class=ad>Buy now</div>
<div id="content">%s</div><div class="sidebar"><p>Popular things elsewhere <a href=/c>here</a></p></div>
<section id="comments"><p>I liked this article very much, says a reader.</p></section>
<form><p>Your name please <input name=x></p></form><footer>&copy; nobody</footer><script>if (a<b) {x("</p>")}</script></body></html>"""
BODY = "<h2>Head &amp; line</h2>\n<p>First <b>bold</b>\n  words,<br>more &#233;&lt;p&gt;.<p>Second paragraph <a href=x>with a link</a> inside.</p><ul><li>one<li>two</ul>"
WANT = "Head & line\nFirst bold words, more é<p>.\nSecond paragraph with a link inside.\none\ntwo"


def test_furniture_goes_and_blocks_stay():
    assert main_text(PAGE % BODY) == WANT
    assert main_text(PAGE % f"<article>{BODY}</article>") == WANT
    assert main_text(PAGE.replace("</body></html>", "") % f"<article><p>tiny</article>") == "tiny"


def test_long_articles_and_bare_pages():
    paragraphs = [f"Paragraph {i} " + "word " * (i % 40) + "end." for i in range(400)]
    page = PAGE % "".join(f"<div><p>{p}</p></div>" for p in paragraphs)
    assert main_text(page) == "\n".join(paragraphs)
    assert main_text("plain text only") == "plain text only"
    assert [main_text(x) for x in (None, "", "<p>", "<div class=ad>x</div>", "<!-- x", "<script>x")] == [""] * 6
    assert main_text("a < b and <b>c</b> > d") == "a < b and c > d"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_only_an_article_around_the_densest_part_replaces_the_choice():
    post = [f"Paragraph {i} of the post with a good many words in it, " + "word " * (i % 7) + "end." for i in range(20)]
    body = "".join(f"<p>{p}</p>" for p in post)
    embed = "<article><p>A quoted text of another author, told in one sentence.</p></article>"
    inside = main_text(f"<html><body><div id=post>{body}{embed}</div></body></html>").split("\n")
    assert inside == post + ["A quoted text of another author, told in one sentence."]
    beside = main_text(f"<html><body><div id=post>{body}</div>{embed}</body></html>").split("\n")
    assert [x for x in beside if x in post] == post
    around = main_text(f"<html><body><p>Outside.</p><article>{body}<div>{embed}</div></article></body></html>").split("\n")
    assert around == inside
    two = "".join(f"<article>{body.replace('post', name)}</article>" for name in ("first", "other"))  # equally dense
    assert len(main_text(f"<html><body><div>{two}</div></body></html>").split("\n")) == 40


def test_names_that_only_contain_a_furniture_word_cut_nothing():
    text = [f"Paragraph {i} with a good many words in it, told at length, for the reader." for i in range(8)]
    body = "".join(f"<p>{p}</p>" for p in text)
    for start, end in (("<div class='layout has-sidebar'><article>", "</article></div>"), ("<form id=f><main>", "</main></form>"),
                       ("<div class=sidebar><article>", "</article></div>"), ("<div class=notice>", "</div>"), ("<form>", "</form>")):
        assert main_text(f"<html><body><nav>Menu</nav>{start}{body}{end}</body></html>").split("\n") == text, start
    parts = ("<h2 id='side-effects'>Side effects</h2>", "<h2 id=comments>On comments</h2>", "<p class='legal'>Legal basis</p>",
             "<section id='related-work'><p>Related work</p></section>", "<div class='share-price'>The price</div>")
    said = ["Side effects", "On comments", "Legal basis", "Related work", "The price"]
    assert main_text(f"<html><body><article>{''.join(parts)}{body}</article></body></html>").split("\n") == said + text
    gone = ("<div class=ad>Buy</div><aside>Aside</aside><nav>Go</nav><form>Send</form><div id=comments><article>Nice</article></div>"
            "<div class='post-comments'>Hm</div>")
    assert main_text(f"<html><body><article>{gone}{body}</article></body></html>").split("\n") == text
    assert main_text(f"<html><body><article>{body}</article><div class='left-sidebar'>{body}</div>{gone}</body></html>").split(
        "\n") == text


def test_article_text_is_not_lost():
    first, last = "First part of a text with many words in it. " * 4, "Last part of the same text, just as long. " * 4
    want = [first.strip(), last.strip()]

    def kept(between, start="<article>", end="</article>"):
        page = f"<html><body><nav>Menu</nav>{start}<p>{first}</p>{between}<p>{last}</p>{end}</body></html>"
        return [line for line in main_text(page).split("\n") if line != "x"]

    for between in ("<svg viewBox='0 0 1 1'/>", "<svg><title>t</title><path d='M0'/></svg>", "<svg><path d='M0'>", "<select><option>a",
                    "<script src='a.js'/>", "<script>if (a < b) { c() }</script>", "<style>p {}</style>", "<iframe src='u'></iframe>",
                    "<canvas>no</canvas>", "<object data='u'>no</object>", "<textarea>no</textarea>"):
        assert kept(between) == want, between
        assert kept(between, "<div>", "</div>") == want, between
    for between, said in (("<title-card>hey</title-card>", "hey"), ("<math-field>hey</math-field>", "hey"),
                          ("<p>so <math><mi>x</mi></math> holds</p>", "so x holds"), ("<p>see <label>Figure one</label> now</p>", "see Figure one now"),
                          ("<p class=comment>A remark.</p>", "A remark."), ("<object-view>hey</object-view>", "hey"),
                          ("<select-menu>hey</select-menu>", "hey"), ("<style-guide>hey</style-guide>", "hey")):
        assert kept(between) == [want[0], said, want[1]], between


def test_density_decides_without_article_tags():
    """Known parts of pages without article, main or telling names: the dense part is kept whole, link lists around it go."""
    rnd = random.Random(3)
    for n in range(20):
        text = [" ".join("word%d" % rnd.randrange(900) for _ in range(rnd.randrange(25, 60))) + "." for _ in range(rnd.randrange(6, 15))]
        links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(rnd.randrange(8, 20)))
        more = "".join(f"<div><a href='/r{i}'>Another story number {i}</a></div>" for i in range(rnd.randrange(4, 9)))
        body = "".join(f"<p>{t}</p>" for t in text)
        page = (f"<html><body><div class=c1><ul>{links}</ul></div><div class=c2><div class=c3>{body}</div></div>"
                f"<div class=c4>{more}</div></body></html>")
        assert main_text(page).split("\n") == text, n


def test_pages_table(spark):
    rows = [(1, "u", PAGE % BODY, "x"), (1, "u", PAGE % BODY, "x"), (2, None, None, None), (None, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract(df).collect(), key=str)
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == sorted(
        [(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=lambda r: f"Row(page_id={r[0]}")
    assert extract(df.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, value):
        d = re.sub("[^0-9]", "", value)
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return (kind == "email" or kind == "ip" and all(int(x) < 256 for x in value.split(".")) or kind == "card" and
                12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0 or kind == "phone" and 9 <= len(d) <= 15)
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN)
                  for m in re.finditer(PLAIN[kind], text or "") if good(kind, m[0]))


def test_base_spans_equal_the_patterns(docs):
    rnd = random.Random(6)
    signs = ["a@b.c", "_d@e.f", "x.y%", "@", ".", "1", "23", "4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "256.1.1.1",
             "01.002.3.0004", "+1 (555) 010-9999", "+", "-", " ", "  ", "(", "é", "\U0001f600", "\n", "0000"]
    texts = {i: "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 30))) for i in range(300)}
    texts[300] = " ".join(["10.0.0.1", "a@b.cd"] * 700)
    texts[301] = "1 " * 30_000 + "a" * 60_000 + "." * 30_000 + "+1" + "(" * 30_000
    got = privacy.find(docs(texts), privacy.Trees()).select("doc_id", "base", "added").collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in got} == {i: plain_spans(t) for i, t in texts.items()}
    assert all(r.added == [] for r in got)


def near_misses(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = "".join(rnd.choice("abcde") for _ in range(5)) + str(rnd.randrange(10, 99))
        mail = f"{user}(at)mail{i % 9}.example.com" if i % 25 == 0 else f"{user}@mail{i % 9}.example.com"
        rows.append((i, f"words here {mail} and more, version {i % 7}.{i % 5} of it"))
    return rows


def test_trees_add_what_looks_like_a_match(docs):
    df = docs(near_misses(800, 3))
    model = privacy.learn(df)
    got = privacy.find(df, model).select("doc_id", "text", "base", "added").collect()
    assert model.limits["email"] is not None and model.limits["card"] is None
    for r in got:
        assert len(r.base) + len(r.added) == 1 and (len(r.added) == 1) == (r.doc_id % 25 == 0)
        s = (r.base + r.added)[0]
        assert r.text[s.start:s.end].endswith(".example.com")
    plain = privacy.redact(df, model)
    assert plain.columns == df.columns
    assert all(r.text.startswith("words here [EMAIL] and more, version") for r in plain.collect())


def test_privacy_odd_rows(odd, none):
    model = privacy.learn(odd)
    assert set(model.limits.values()) == {None} and privacy.learn(none).trees == []
    got = privacy.find(odd, model)
    assert got.count() == 10 and got.where(F.size("base") + F.size("added") > 0).count() == 0
    assert privacy.find(none, model).count() == 0
    assert privacy.redact(odd, model).exceptAll(odd).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1, 400)),)], "v array<int>")
    for v, s in df.select("v", privacy.running(F.col("v"))).collect():
        assert s == [sum(v[:i]) for i in range(len(v))]
