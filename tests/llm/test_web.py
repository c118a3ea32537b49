import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tripsense.llm import html_content as H
from tripsense.llm import warc
from tripsense.llm.common import table

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav><a href=x>Home</a> <a href=y>News</a></nav>
<main><article><header><h1>Real title</h1></header><p>First para &lt;b&gt; with a long  sentence, and&nbsp;more.
<div class="advert">Buy now!</div><p>Second<br>line &amp two.</p><ul><li>item one<li>item <b>two</b></ul>
<form><label>Mail</label> Send us</form><script>var a="</p>";</script></article><aside>Related</aside>
<section class="comments"><h2>Comments</h2><p>A great long comment, thanks to all of you.</p></section></main>
<div class="sidebar"><p>side text</p></div><footer>&copy; x</footer></body></html>"""
ZERO = [0.0] * (H.N_FEATURES + 1)


def test_main_text_of_a_full_page():
    assert H.extract(PAGE, ZERO) == "Real title\n\nFirst para <b> with a long sentence, and more.\n\nSecond line & two.\n\nitem one\n\nitem two"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div", ""), ("a < b &amp; c", "a < b & c"),
    ("<article><p><b>x<br><p>y</article><footer>f", "x\n\ny"), ("<script>x", ""), ("<p title='a>b'>t</p>", "t"),
    ("</p></div>stray<b>", "stray"), ("<nav>" + "<a>l</a>" * 5 + "</nav><article>" + "<p>w" * 2000 + "</article>", "\n\n".join(["w"] * 2000)),
])
def test_broken_and_plain_pages(page, text):
    assert H.extract(page, ZERO) == text


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "elementor-widget-container", "has-sidebar", "no-sidebar", "tags-politics",
                                  "legal-news", "sidebar", "widget comments"])
@pytest.mark.parametrize("tag", ["article", "main", 'div role="main"'])
def test_landmark_outweighs_words_of_an_outer_wrapper(name, tag):
    page = (f'<nav><a href=x>Home</a></nav><div class="{name}"><div id=w><{tag}><h1>Title</h1><p>First text.<div class="ad">Buy!</div>'
            f'<p>Second.</{tag.split()[0]}></div><div class="sidebar">Side</div></div><footer>f</footer>')
    assert H.extract(page, ZERO) == "Title\n\nFirst text.\n\nSecond."


def test_text_outweighs_vague_words_but_not_hiding():
    likely = [0.0] * H.N_FEATURES + [2.0]                 # every text looks like content
    for name in ("content-sidebar-wrap", "elementor-widget-container", "legal-news", "no-sidebar"):
        page = f'<nav>n</nav><div class="{name}"><p>One.<p>Two.</div><footer>f</footer>'
        assert H.extract(page, likely) == "One.\n\nTwo."
        inner = f'<article><div class="{name}"><p>One.<p>Two.</div></article><footer>f</footer>'
        assert H.extract(inner, ZERO) == "One.\n\nTwo."
    most = [0.0] * H.N_FEATURES + [3.0]                   # text and both neighbours overrule a word
    assert H.extract('<article><p>One.<p>Two.<div class="promo">Three.</div><p>Four.<p>Five.</article>', most).count("\n\n") == 4
    for outer in ("<div hidden>", "<aside>", "<footer>", '<div style="display:none">'):
        assert H.extract(f"{outer}<article><p>One.</article>", most) == ""
    assert H.extract('<article><p>One.<section class="post-comments"><p>C1.<p>C2.</section></article>', likely) == "One."


LIKELY = [0.0] * H.N_FEATURES + [2.0]                     # every text looks like content
STORY = "<h1>Title</h1><p>The first paragraph of the story is long enough to be the main text.<p>And so is the second one."
STORY_TEXT = "Title\n\nThe first paragraph of the story is long enough to be the main text.\n\nAnd so is the second one."


@pytest.mark.parametrize("weights", [ZERO, LIKELY])
@pytest.mark.parametrize("outside", [False, True])
@pytest.mark.parametrize("wrapper", ["<section id=comments>", "<section class='comments'>", "<div class='related-posts'>", "<div class='sidebar'>",
                                     "<div class='post-comments' id=x><ol>", "<ul class='latest-promo'>", "<aside>", "<div role=complementary>"])
def test_nested_articles_are_comments_or_teasers(weights, wrapper, outside):
    other = wrapper + "<article><h2>Anna</h2><p>A reader says, at some length, what it is all about.</article>" * 3 + "</" + re.match(r"<(\w+)", wrapper)[1] + ">"
    page = f"<nav>n</nav><article>{STORY}" + ("</article>" + other if outside else other + "</article>") + "<footer>f</footer>"
    assert H.extract(page, weights) == STORY_TEXT
    page = f"<main><article>{STORY}" + ("</article>" + other if outside else other + "</article>") + "</main>"
    assert H.extract(page, weights) == STORY_TEXT


@pytest.mark.parametrize("weights", [ZERO, LIKELY])
def test_a_smaller_landmark_ends_no_words(weights):
    page = f"<main>{STORY}</main><div class='elementor-widget-wrap'><article>Read next: a teaser.</article></div>"
    assert H.extract(page, weights) == STORY_TEXT
    page = f"<div class='elementor-widget-wrap'><main>{STORY}</main></div><article class='comment'>I agree.</article>"
    assert H.extract(page, weights) == STORY_TEXT
    page = f"<article>{STORY}</article><article>The page has another part.</article>"
    assert H.extract(page, weights) == STORY_TEXT + "\n\nThe page has another part."
    comments = "<div class=comments>" + "<article><p>Much longer than the rest, this reader's comment is.</article>" * 9 + "</div>"
    assert "reader" not in H.extract(f"<div>{STORY}</div>{comments}", weights)


def test_formulas_and_labels_are_text():
    page = ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> hold."
            "<p><label>Figure 1</label> shows it.<form><label>Mail</label></form></article>")
    assert H.extract(page, ZERO) == "Let x=1 hold.\n\nFigure 1 shows it."


def hand_labelled(rng):
    """A page put together from labelled pieces, and its main text."""
    sentence = lambda k: " ".join(rng.choice("river stone winter market letter garden signal harbour".split()) for _ in range(k)).capitalize() + "."
    body, text = [], []
    for k in range(rng.randint(2, 6)):
        tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"])
        s = sentence(3 if tag == "h2" else rng.randint(8, 30))
        body.append(f"<{tag}>{s}</{tag}>")
        text.append(s)
        if rng.random() < 0.3:
            body.append(rng.choice([f"<div class='ad'>{sentence(5)}</div>", f"<aside>{sentence(6)}</aside>", f"<script>{sentence(4)}</script>",
                                    f"<form>{sentence(3)}</form>", f"<div class='share-buttons social'><a href=x>{sentence(2)}</a></div>"]))
    reader = lambda: f"<article><h3>{sentence(1)}</h3><p>{sentence(rng.randint(3, 12))}</p></article>"
    comments = f"<{rng.choice(['section', 'div'])} {rng.choice(['id', 'class'])}='{rng.choice(['comments', 'comment-list', 'disqus'])}'>" + reader() * rng.randint(1, 4)
    related = f"<div class='{rng.choice(['related-posts', 'recommended', 'sidebar'])}'>" + reader() * rng.randint(1, 3) + "</div>"
    tag = rng.choice(["article", "main"])
    inside = rng.random() < 0.5
    core = f"<{tag}>{''.join(body)}{comments + '</section></div>' if inside else ''}</{tag}>{'' if inside else comments + '</section></div>'}"
    wrap = rng.choice(["{}", "<div class='content-sidebar-wrap'>{}</div>", "<div class='elementor-widget-container'>{}</div>", "<div id=page>{}</div>"])
    page = f"<header>{sentence(2)}</header><nav><a href=a>{sentence(1)}</a></nav>{wrap.format(core)}{related}<footer>{sentence(4)}</footer>"
    return page, "\n\n".join(text)


def test_pages_of_labelled_pieces():
    rng = random.Random(8)
    for _ in range(300):
        page, text = hand_labelled(rng)
        assert H.extract(page, ZERO) == text, page
        assert H.extract(page, [0.0] * H.N_FEATURES + [1.0]) == text, page


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        gain = [rng.choice([-3, -1, -0.5, 0.25, 1, 2.5]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.3, 1.0, 2.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: (sum(g for g, k in zip(gain, keep) if g > 0 and not k) - sum(g for g, k in zip(gain, keep) if g < 0 and k)
                             + sum(w for a, b, w in edges if keep[a] != keep[b]))
        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(H.min_cut(gain, edges)) - best) < 1e-9


def test_pages_table(spark):
    import html

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.op7(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, "u", None, "x", 5), (None, None, "<p>t", "y", 6), (1, "u", None, "x", 5)],
                                "page_id bigint, url string, html string, text string, n_chars int")
    assert sorted((str(r["page_id"]), r["text"]) for r in H.op7(odd).collect()) == [("1", ""), ("1", ""), ("None", "t")]
    assert H.main_text(odd).columns == ["page_id", "url", "text", "n_chars"]
    assert H.op7(pages.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------- WARC
def records(n=6):
    return [warc.record_bytes(str(k), f"http://x/{k}", f"<p>page {k}\r\n\r\nWARC/1.1 not a record".encode()) for k in range(n)]


def found(data):
    out = list(warc.salvage(data))
    return [x[3]["warc-record-id"] for x in out if x[0] == "record"], [(x[1], x[2]) for x in out if x[0] == "gap"]


def test_salvage_searches_an_archive_once(monkeypatch):
    """However many members are damaged, the bytes searched for version lines and members stay those of the archive."""
    searched = []

    class Watch(warc._Forward):
        def __init__(self, find):
            super().__init__(lambda k: (out := find(k), searched.append((end if out is None else out) - k))[0])

    monkeypatch.setattr(warc, "_Forward", Watch)
    for n in (50, 200):
        parts = [bytearray(warc.member(r)) for r in records(n)]
        for p in parts[5:-5]:
            p[len(p) // 2] ^= 0x55
        data = b"".join(parts)
        end = len(data)
        searched.clear()
        ids, gaps = found(data)
        assert ids == [f"<urn:page:{k}>" for k in (*range(5), *range(n - 5, n))] and sum(searched) <= 2 * end + n
        assert gaps == [(sum(map(len, parts[:5])), sum(map(len, parts[5:-5])))]


def test_forward_equals_a_search_from_each_place():
    rng = random.Random(1)
    data = "".join(rng.choice("ab") for _ in range(300))
    look = warc._Forward(lambda k: None if (m := data.find("abba", k)) < 0 else m)
    places = sorted(rng.choices(range(300), k=80)) + rng.choices(range(300), k=40)
    assert [look(k) for k in places] == [None if data.find("abba", k) < 0 else data.find("abba", k) for k in places]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in records()]
    ids = [f"<urn:page:{k}>" for k in range(6)]
    start = [sum(map(len, parts[:k])) for k in range(7)]
    assert found(b"".join(parts)) == (ids, [])
    for at in (1, len(parts[2]) // 2, len(parts[2]) - 3):                      # one byte of record 2 changes
        bad = bytearray(parts[2])
        bad[at] ^= 0x55
        got, gaps = found(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
        assert [i for i in ids if i != ids[2]] == got and gaps == [(start[2], len(bad))], at
    got, gaps = found(b"".join(parts[:3]) + b"\x00junk\xff" * 9 + b"".join(parts[3:]))
    assert got == ids and gaps == [(start[3], 54)]
    got, gaps = found(b"".join(parts)[:-7])                                    # cut off at the end
    assert got == ids[:5] and gaps == [(start[5], len(parts[5]) - 7)]
    got, gaps = found(b"".join(parts)[9:])                                     # cut off at the start
    assert got == ids[1:] and gaps == [(0, len(parts[0]) - 9)]
    assert found(b"") == ([], []) and found(b"no archive at all") == ([], [(0, 17)])


def test_salvage_of_members_of_many_records():
    parts = records(200)
    ids = [f"<urn:page:{k}>" for k in range(200)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0x55
    first, last = warc.member(b"".join(parts[:3])), warc.member(records(201)[200])
    one = warc.member(b"".join([*parts[:2], bytes(bad), *parts[3:]]))         # a bad record inside an intact member
    got, gaps = found(first + one + last)
    assert got == ids[:3] + ids[:2] + ids[3:] + ["<urn:page:200>"] and gaps == [(len(first), len(one))]
    whole = warc.member(b"".join(parts))
    wrong_crc = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
    got, gaps = found(first + wrong_crc + last)
    assert got == ids[:3] + ids + ["<urn:page:200>"] and gaps == [(len(first), len(whole))]
    cut = whole[:-len(whole) // 4]                                            # a cut tail loses the records in the tail only
    for after in (b"", last):
        got, gaps = found(first + cut + after)
        n = len(got) - 3 - bool(after)
        assert 100 < n < 200 and got[:3 + n] == ids[:3] + ids[:n] and gaps == [(len(first), len(cut))]
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)                           # stored: version lines in the archive's own bytes
    stored = packer.compress(b"".join(parts[:9])) + packer.flush()
    assert found(stored[:-5])[0] == ids[:9]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("clash"))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a b/\n", "same"), (2, None, "same"), (3, "u", "é" * 5000), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = pages_of(spark, rows)
    warc.write_warc(pages, str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert all(r["kind"] == "record" for r in back.values())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in back.items()} == {
        "1": ("revisit", "2"), "2": ("response", None), "3": ("response", None), "4": ("revisit", "5"), "5": ("response", None),
        "": ("revisit", "2"), "6": ("response", None)}
    assert back["3"]["payload"].decode() == "é" * 5000 and back["6"]["payload"] == b"\r\n\r\nWARC/1.1\r\n"
    got = {r["page_id"]: r for r in warc.op6(pages).collect()}
    for i, _, text in rows:
        data = (text or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), warc.digest32(data))
    large = {r["page_id"]: r["record_type"] for r in warc.op6(pages, min_revisit_bytes=5).collect()}
    assert set(large.values()) == {"response"}
    assert warc.op6(pages.limit(0)).count() == 0


def test_warc_reader_logs_gaps(spark, tmp_path):
    parts = [warc.member(r) for r in records()]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    gap = [r for r in rows if r["kind"] == "gap"]
    assert [r["record_id"] for r in rows if r["kind"] == "record"] == ["0", "2"]
    assert [(r["byte_offset"], r["byte_length"]) for r in gap] == [(len(parts[0]), len(parts[1]) - 9)] and gap[0]["reason"]


def test_archives_are_cut_by_their_bytes(spark, tmp_path):
    """Large pages that lie together do not share an archive."""
    import os

    noise = lambda n: "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(k, "u", noise(20_000 + k) if 30 <= k < 40 else f"<p>{k}") for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), archive_bytes=30_000)
    sizes = [os.path.getsize(tmp_path / "w" / f) for f in os.listdir(tmp_path / "w") if f.startswith("part")]
    assert len(sizes) >= 5 and max(sizes) < 30_000 + 16_000 and sorted(sizes)[1] > 25_000
    got = {x["record_id"]: x["payload"].decode() for x in warc.read_warc(spark, str(tmp_path / "w")).filter("kind = 'record'").collect()}
    assert got == {str(k): h for k, _, h in rows}


def test_repeated_rows_with_the_largest_id(spark):
    rows = [(1, "u", "same"), (9, "u", "same"), (9, "u", "same"), (4, "v", "same"), (None, "w", "same"), (2, "x", "other"), (2, "x", "other")]
    got = warc.op6(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted([
        ("1", "revisit", 9), ("9", "response", None), ("9", "response", None), ("4", "revisit", 9), ("None", "revisit", 9),
        ("2", "response", None), ("2", "response", None)])
