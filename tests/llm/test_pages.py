"""Operators on pages and conversations: archives, extraction and preference pairs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from faultline.llm import preferences, warc, wrappers

PAGES = "page_id bigint, url string, html string, text string, host string, digest string, type string, blocks string"


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    trap = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(5, "http://www.B.example/p?q=1#f", "same"), (3, "https://b.example:443/p?q=1", "same"), (9, "http://a.example", "é日本"),
            (7, None, None), (8, "http://a.example/x\r\ny z", ""), (2, "http://user@a.example:8080/x", trap), (None, "http://c.example", "same"),
            (4, "http://a.example/", "long " * 50_000), (6, "http://a.example/", "é日本"), (6, "http://a.example/", "é日本")]
    return rows, spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], PAGES).repartition(3)


def test_archives_round_trip(spark, pages):
    rows, df = pages
    path = warc.archive(df)
    got = warc.read_archives(spark, path, payloads=True).collect()
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[html or ""] = min(firsts.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        first = firsts[html or ""]
        want.append((i, len((html or "").encode()), b32(html), "response" if i == first else "revisit", None if i == first else first,
                     (html or "") if i == first else ""))
    own = [(None if r.id is None else int(r.id), r.bytes, r.digest, r.type, None if r.refers_to is None else int(r.refers_to),
            bytes(r.payload).decode()) for r in got]
    assert sorted(own, key=str) == sorted(want, key=str)
    for r in got:                      # offsets and lengths name the record in the unpacked file
        raw = gzip.open(r.file.removeprefix("file:"), "rb").read()[r.offset:r.offset + r.length]
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode()) and raw.endswith(b"\r\n\r\n")


def test_small_payloads_are_all_responses(spark, pages):
    _, df = pages
    got = warc.assign(df, min_bytes=5).select("id", "type").collect()
    assert {r.id for r in got if r.type == "revisit"} == {9}


def test_histories_are_globally_ordered(spark, pages):
    rows, df = pages
    index = warc.read_archives(spark, warc.archive(df))
    parts = warc.capture_histories(index, range_rows=2).rdd.glom().collect()
    flat = [tuple(r) for part in parts for r in part]
    assert flat == sorted(flat, key=warc._order) and len(flat) == len(rows)
    assert {r[0] for r in flat if r[2] in ("3", "5")} == {"example,b)/p?q=1"}
    assert warc.surt("http://user@a.example:8080/x") == "example,a:8080)/x" and warc.surt("http://a.example") == "example,a)/"
    empty = warc.read_archives(spark, warc.archive(df.limit(0)))
    assert warc.capture_histories(empty).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(30), k=rng.randrange(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_damaged_archives_raise():
    good = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n")
    assert [p for *_, p in warc.parse_archive(good)] == [b""]
    for bad in (good[:-2], b"junk" + good, good.replace(b"19", b"17")):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


# --- 10 ----------------------------------------------------------------------

def article(rng, n):
    return ["".join(rng.choice("abcdefgh ") for _ in range(60)).strip() + f" {rng.random()}" for _ in range(n)]


def site(rng, k, marked, extra=""):
    paras = article(rng, 4)
    body = "".join(f"<p>{p} &amp; <b>bo</b>ld<br>x\n\n y" for p in paras)
    main = f"<article><h1>T{k} &eacute;</h1>{body}</article>" if marked else f"<div><h1>T{k} &eacute;</h1>{body}</div>"
    text = " ".join([f"T{k} é", *[f"{p} & bold x y" for p in paras]])
    page = (f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/'>Home {k}</a></ul></nav><div class='side-bar sidebar'>links {rng.random()}</div><!-- <p>no</p> -->"
            f"<div><span>All rights of this site</span></div>{main}<section id=comments><p>first! {k}</p></section>"
            f"<form><p>mail</p><input></form><p class=\"notice\">cookies {k}</p><footer>&copy; {k}</footer>{extra}</body></html>")
    return page, " ".join(text.split())


def test_extraction(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(24):
        page, text = site(rng, k, marked=k % 2 == 0)
        host = "marked" if k % 2 == 0 else "plain"
        rows.append((k, f"http://{host}.example/{k}", page))
        want[k] = text
    rows += [(100, "http://x.example/", None), (101, None, ""), (102, "no url", "<p>one<p>two &lt;b&gt; &#233; &nbsp; z"), (103, "http://y.example/", "<"),
             (104, "http://z.example", "plain text, no tags"), (105, "http://z.example/b", "<div " + "<div>" * 3000 + "deep"),
             (106, "http://w.example", "<p>a</p>" * 3000 + "<script>never closed <p>b"), (None, "http://v.example", "<p>null id"),
             (107, "http://t.example", "<article><header><h1>Title</h1><p>by me</p></header><p>Body</p><aside>ad</aside></article>")]
    want |= {100: "", 101: "", 102: "one two <b> é z", 103: "<", 104: "plain text, no tags", 105: "deep", 106: " ".join("a" * 3000), None: "null id",
             107: "Title Body"}
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], PAGES).repartition(3)
    got = wrappers.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
    assert wrappers.extract(df.limit(0)).count() == 0


def test_copies_do_not_make_an_article_a_template(spark):
    rng = random.Random(8)
    page, text = site(rng, 1, marked=True)
    rows = [(k, f"http://copy.example/{k}", page if k else site(rng, 99, marked=True)[0]) for k in range(12)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got if r.page_id} == {text}


def extracted(spark, rows):
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def test_constant_last_block_after_any_number_of_paragraphs(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(20):
        paras = article(rng, 5 if k % 3 else 3 + k % 7)
        want[k] = " ".join(" ".join(paras).split())
        rows.append((k, f"http://d.example/{k}", "<body><div>" + "".join(f"<p>{p}</p>" for p in paras) + "<p>All rights reserved.</p></div></body>"))
    assert extracted(spark, rows) == want
    assert len({len(html.split("<p>")) for *_, html in rows}) > 4


def test_another_text_in_a_template_slot_stays(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(20):
        own, last = article(rng, 1)[0], "All rights reserved." if k % 4 else f"A closing remark {k}"
        want[k] = " ".join(f"{own} {'' if k % 4 else last}".split())
        rows.append((k + 1, f"http://e.example/{k}", f"<body><div><p>{own}</p><p>{last}</p></div></body>"))
    rows.append((0, "http://e.example/first", "<body><div><p>the first one</p><p>All rights reserved.</p></div></body>"))
    assert extracted(spark, rows) == {0: "the first one"} | {k + 1: v for k, v in want.items()}


def test_short_articles_under_long_boilerplate(spark):
    rng = random.Random(13)
    rows, want = [], {}
    constant = "".join(f"<p>{'Terms of use apply to all that is shown here. ' * 3}{i}</p>" for i in range(3))
    for k in range(12):
        want[k] = " ".join(article(rng, 1)[0].split())
        rows.append((k, f"http://f.example/{k}", f"<body><div><p>{want[k]}</p></div><div>{constant}</div></body>"))
    assert extracted(spark, rows) == want


def test_a_second_layout_has_its_own_template(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for k in range(24):
        paras = article(rng, 2 + k % 3)
        want[k] = " ".join(" ".join(paras).split())
        if k % 2:
            page = "<section><h4>The second house</h4>" + "".join(f"<blockquote>{p}</blockquote>" for p in paras) + "<pre>Printed here.</pre></section>"
        else:
            page = "<div>" + "".join(f"<p>{p}</p>" for p in paras) + "<p>All rights reserved.</p></div>"
        rows.append((k, f"http://g.example/{k}", f"<body>{page}</body>"))
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("name", ["content has-sidebar", "with-header", "no-ads", "menu-open", "search-results", "x_no_comments"])
def test_only_whole_names_drop(name):
    page = wrappers.parse(f"<div class='menu'>links</div><div class='{name}'><h1>T</h1><p>Body</p></div><div id=site_footer>foot</div>")
    assert [n.text for n in wrappers.blocks(page)] == ["T", "Body"]


def test_names_do_not_drop_the_article():
    def text(page):
        return " ".join(n.text for n in wrappers.blocks(wrappers.parse(page)))

    assert text("<div class=search><div class=menu><article><p>Body</p><p class=ad>ad</p></article></div></div>") == "Body"
    assert text("<form><div id=widget><main>Body</main></div></form><p>x</p>") == "Body"
    assert text("<div class=alert><p>The long main text of this page</p><p class=ad>ad</p></div><p>x</p>") == "The long main text of this page x"
    assert text("<form><p>All of the page is in one form</p></form>") == "All of the page is in one form"
    assert text("<article>Body</article><aside><article>Much longer teaser of another page</article></aside>") == "Body"
    assert text("<p>Short</p><div id=comments><article>Much longer comment</article></div><nav>And a very long menu of it all</nav>") == "Short"
    assert text("<div " + "class=menu><div " * 2000 + "><article>deep</article>") == "deep"


def test_simple_tree_matching():
    a = wrappers.parse("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>")
    b = wrappers.parse("<div><h1>n</h1><p>1</p><ul><li>x</li></ul><table></table><p>3</p></div>")
    pairs = {(x.text, y.text) for x, y in wrappers.match(a, b) if x.tag == "#"}
    assert pairs == {("1", "1"), ("x", "x"), ("2", "3")}


def _exhaustive(x, y) -> int:
    """The weight of the best order-keeping matching, by trying every alignment of the children."""
    if x.tag != y.tag:
        return 0

    def best(i, j):
        if i == len(x.children) or j == len(y.children):
            return 0
        return max(best(i + 1, j), best(i, j + 1), _exhaustive(x.children[i], y.children[j]) + best(i + 1, j + 1))

    return wrappers.NODE + (x.tag == "#" and x.text == y.text) + best(0, 0)


def _weight(pairs) -> int:
    return sum(wrappers.NODE + (x.tag == "#" and x.text == y.text) for x, y in pairs)


@pytest.mark.parametrize("cells", [1_000_000, 3])
def test_matching_equals_exhaustive_search(monkeypatch, cells):
    """Small trees, in one table and divided until three child pairs are left."""
    monkeypatch.setattr(wrappers, "MOST_CELLS", cells)
    rng = random.Random(cells)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return f"<p>{rng.choice('abc')}</p>"
        return f"<{(t := rng.choice(['div', 'ul']))}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{t}>"

    for _ in range(40):
        x, y = (wrappers.parse("<div>" + tree(2) + tree(1) + tree(2) + "</div>") for _ in range(2))
        pairs = wrappers.match(x, y)
        assert _weight(pairs) == _exhaustive(x, y)


def test_matching_of_thousands_of_children():
    rng = random.Random(2)
    kept = sorted(rng.sample(range(2500), 2000))
    x = wrappers.parse("<ul>" + "".join(f"<li>item {i}</li>" for i in range(2500)) + "</ul>")
    y = wrappers.parse("<ul>" + "".join(f"<li>item {i}</li>" for i in kept) + "</ul>")
    same = [(a.text, b.text) for a, b in wrappers.match(x, y) if a.tag == "#"]
    assert len(same) == 2000 and all(a == b for a, b in same)


# --- 9 -----------------------------------------------------------------------

CONV = "conv_id bigint, turn int, role string, text string, chosen string, k string"


def test_preference_pairs(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0é"), (0, 2, "user", "thanks"), (1, 1, "assistant", "a1"), (1, 0, "system", None),
            (1, 1, "assistant", "a1"), (2, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "no reply"), (5, 0, "assistant", "x"),
            (6, None, "user", "first"), (6, 0, None, "r"), (6, 0, "assistant", "z"), (7, 0, "assistant", ""), (None, 0, "assistant", "lost")]
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONV)
    from pyspark.sql import functions as F
    partner = F.col("conv_id") + F.when(F.pmod("conv_id", F.lit(2)) == 0, 1).otherwise(-1)
    made = preferences.format_pairs(preferences.replaced_replies(preferences.conversations(turns), partner))
    got = {r.conv_id: (r.n_prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion,
                       [tuple(s) for s in r.chosen_spans], r.rejected_spans and [tuple(s) for s in r.rejected_spans]) for r in made.collect()}
    u, a = "<|user|>\n", "<|assistant|>\n"
    assert got == {
        0: (1, u + "q0\n", a + "a0é\n" + u + "thanks\n", a + "a1\n", [(14, 18)], [(14, 17)]),
        1: (1, "<|system|>\n\n", a + "a1\n", a + "a0é\n", [(14, 17)], [(14, 18)]),
        2: (1, a + "same\n", "", "", [], []), 3: (1, a + "same\n", "", "", [], []),
        4: (1, u + "no reply\n", "", None, [], None), 5: (1, a + "x\n", "", None, [], None),
        6: (2, u + "first\n" + "<||>\nr\n", a + "z\n", a + "\n", [(14, 16)], [(14, 15)]),
        7: (0, "", a + "\n", a + "z\n", [(14, 15)], [(14, 16)]),
    }
    pairs = preferences.replaced_replies(preferences.conversations(turns))
    replies = {r.conv_id: r.rejected and r.rejected[-1].text for r in pairs.collect()}
    # the next conversation with a reply, the last takes the first
    assert replies == {0: "a1", 1: "same", 2: "same", 3: "x", 4: None, 5: "z", 6: "", 7: "a0é"}
    assert preferences.replaced_replies(preferences.conversations(turns.limit(0))).count() == 0
    text = (got[0][1] + got[0][2])[len(got[0][1]):]
    assert [text[s:e] for s, e in got[0][4]] == ["a0é\n"]
    assert preferences.conversations(turns.limit(0)).count() == 0
