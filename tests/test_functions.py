"""Golden rows for the scalar functions."""

import datetime
import hashlib
import random
import tracemalloc
import urllib.parse

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.functions import dates, dom, text, urls
from tidings.functions.decode import decode_cp949, decode_utf8
from tidings.functions.dom import _parse_slices, parse_html, shown_text
from tidings.plans import boards

HOST = "https://a.example"


def test_external_id(apply):
    rows = {
        f"{HOST}/board/notice.do?mode=view&articleNo=1001": "1001",
        f"{HOST}/b.asp?idx=77&id=": "77",
        f"{HOST}/b?no=5&articleNo=9": "9",
        f"{HOST}/b?ID=5": "b",
        f"{HOST}/en/685": "685",
        f"{HOST}/en/853/": "853",
        f"{HOST}/공지1": "공지1",
        f"{HOST}/en/474.html?utm_source=x": "e5c6a3dd0b9e311ad08a49027ea75c2c",
        f"{HOST}/en/474.html": "e5c6a3dd0b9e311ad08a49027ea75c2c",
        f"{HOST}/": "befde498a45b6c82084a07709548fe6f",
        "": "e3b0c44298fc1c149afbf4c8996fb924",
        f"{HOST}/b?no=a%20b+c": "a b c",
        f"{HOST}/x;p=1?y=2": "x",
    }
    assert apply(urls.external_id, list(rows)) == list(rows.values())


def test_notice_key(apply):
    rows = [("12", f"{HOST}/b?no=5"), ("", f"{HOST}/b?no=5"), (None, f"{HOST}/b?no=5")]
    assert apply(urls.notice_key, rows, "n string, u string") == ["12", "5", "5"]


def test_url_normalized(apply):
    rows = {
        "http://x.example/fr/825?page=2&ref=x": "http://x.example/fr/825?page=2",
        "https://x.example/a?b=2&a=1&a=3&UTM_Source=z#top": "https://x.example/a?a=1&b=2",
        "https://x.example/a?refresh=1&side=2&q=%EA%B0%80+x&e=": "https://x.example/a?q=가 x",
        "HTTP://x.example/a;p?#f": "http://x.example/a;p",
    }
    assert apply(urls.url_normalized, list(rows)) == list(rows.values())


def test_url_path_only(apply):
    rows = {
        f"{HOST}/a/b?x=1#y": f"{HOST}/a/b",
        f"{HOST}/a;v=1/b;w=2?x": f"{HOST}/a;v=1/b",
        f"{HOST}": HOST,
    }
    assert apply(urls.url_path_only, list(rows)) == list(rows.values())


HREFS = [
    "", "?a=1", "#top", "x", "./x", "../x", "../../../x", "/x/../y", "/", "//cdn.example/p",
    "https://other.example/z/../q", "mailto:a@b.example", "javascript:void(0)", "a/b/../c/./d/",
    "..", ".", "x?y=../z", "/a//b", "a//b", "공지/1", "view.do?mode=view&articleNo=3#c",
]
BASES = [
    f"{HOST}/board/list.do?mode=list&p=1#f", f"{HOST}", f"{HOST}/", f"{HOST}/a/b/c/",
]


def test_resolve_url_like_the_standard_library(apply):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = apply(urls.resolve_url, pairs, "b string, h string")
    assert dict(zip(pairs, got)) == {p: urllib.parse.urljoin(*p) for p in pairs}


def test_quote_path_and_file_name(apply):
    paths = ["/a b/가*~+-_.png", "/x%20y/(1).jpg", "/", "", "/a;v=1"]
    want = []
    for p in paths:
        parsed = urllib.parse.urlparse(f"{HOST}{p}?q=1 2")
        want.append(
            urllib.parse.urlunparse(parsed._replace(path=urllib.parse.quote(parsed.path)))
        )
    assert apply(urls.quote_path, [f"{HOST}{p}?q=1 2" for p in paths]) == want
    names = {f"{HOST}/a/b.png?x=/c.d": "b.png", f"{HOST}/a/b": "image.jpg", "": "image.jpg"}
    assert apply(lambda u: urls.file_name(u, F.lit("image.jpg")), list(names)) == list(
        names.values()
    )


def test_content_hash(apply):
    rows = [
        ("A", "<p> B </p>"),
        ("A", None),
        ("T", "<div><p>hello</p>\n<p> world</p></div>"),
    ]
    assert apply(text.content_hash, rows, "t string, h string") == [
        "23519a43c66b4c342f25b32e09797ec5f3fc0be388cd8243fb3449afbdce4013",
        "06f961b802bc46ee168555f066d28f4f0e9afdf3f88174c1ee6f9de004fc30a0",
        "7a80e8b3337a381001ee0089c5d4daa1d434f071c4cb285a46c4cc7c7093fb0c",
    ]


def test_content_hash_keeps_title_as_given(apply):
    assert apply(text.content_hash, [(" A ", "x")], "t string, h string") == [
        hashlib.sha256(b" A \nx").hexdigest()
    ]


PAGES = {
    '<p title="a > b">x<!-- <p>no</p> -->y</p>': "x\ny",
    "<script>var t='</p>';</script>shown<style>p{}</style>": "shown",
    "a &lt;b&gt; &amp;amp; &#44032;&#xAC00;&eacute; &unknown; R&D &nbsp; ": "a <b> &amp; 가가é &unknown R&D",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<P>A<BR>B</P><noscript>n</noscript>": "A\nB\nn",
    "": "",
    "<p> 　\xa0 </p>x": "x",
    f'<img src="data:image/png;base64,{"A" * 50000}">after': "after",
}


def test_visible_text(apply):
    assert apply(text.visible_text, list(PAGES)) == list(PAGES.values())


def test_visible_text_agrees_with_the_tree(apply):
    through_tree = apply(lambda h: shown_text(parse_html(h), "\n"), list(PAGES))
    assert through_tree == list(PAGES.values())


WORDS = st.sampled_from(
    ["<p>", "</p>", "<b class='x'>", "</b>", "<br>", "a", " ", "\n", "가", "&amp;", "&lt;", "<!--c-->", "<li>"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=12).map("".join), min_size=8, max_size=8))
def test_both_forms_of_visible_text_agree(apply, pages):
    assert apply(text.visible_text, pages) == apply(
        lambda h: shown_text(parse_html(h), "\n"), pages
    )


def test_strip_digits_padding(apply):
    assert apply(text.strip, ["　 a\xa0b \x1c\n", None, ""]) == ["a\xa0b", None, ""]
    assert apply(text.is_digits, ["12", "", "1a", "١٢", " 1"]) == [True, False, False, True, False]
    assert apply(text.zero_pad, ["1", "12", "123", ""]) == ["01", "12", "123", "00"]


def test_clean_html(apply):
    rows = {
        "<p>a<img src='x>y'>b</p><script>c</script><iframe>d</iframe>": "<p>ab</p>",
        "<table><tr></tr></table>": '<table border="1"><tr></tr></table>',
        '<table class="a"></table>': '<table class="a" border="1"></table>',
        '<table border="0"></table>': '<table border="0"></table>',
    }
    assert apply(text.clean_html, list(rows)) == list(rows.values())


def test_preview_error_and_names(apply):
    assert apply(text.preview, ["x" * 60, None]) == ["x" * 50, ""]
    assert [len(x) for x in apply(text.error_text, ["e" * 3000])] == [2000]
    got = apply(text.name_structs, [["a", "b"], None, []], "v array<string>")
    assert [[r["name"] for r in x] for x in got] == [["a", "b"], [], []]


def test_published_at(apply):
    def day(y, m, d):
        return datetime.datetime(y, m, d)

    rows = {
        "2026.02.19": day(2026, 2, 19),
        "2026-2-9": day(2026, 2, 9),
        "2026/02/19": None,
        "2026. 02. 19": None,
        "날짜 없음": None,
        "2026-13-01": None,
        "12026.2.191": day(2026, 2, 19),
        "0000.1.1": None,
        "": None,
    }
    got = apply(lambda c: F.to_timestamp_ntz(dates.published_at(c).cast("string")), list(rows))
    assert got == list(rows.values())
    assert apply(dates.published_at, [None]) == [None]


@pytest.mark.parametrize(
    "function,rows",
    [
        (dates.date_year_first, {"2026년 2월 9일": "2026.02.09", "no date": "no date", "2026-12-31": "2026.12.31"}),
        (dates.date_from_parts, {"26-02-09": "2026.02.09", "2026. 2. 9": "2026.02.09", "a.b": "a.b", "2026.123.4": "2026.123.04"}),
        (dates.date_from_digit_runs, {"2026-2-9 14:30": "2026.02.09", "26.1.2": "2026.01.02", "1 2": "1 2"}),
        (dates.date_month_name, {"Feb 9, 2026 Views: 3": "2026.02.09", "Foo 9, 2026": "2026.01.09", "december 31, 2025": "2025.12.31", "2026년 2월 9일": "2026.02.09", "x": "x"}),
    ],
)
def test_date_normalisers(apply, function, rows):
    assert apply(function, list(rows)) == list(rows.values())
    assert apply(function, [None]) == [None]


def test_iso_text(spark):
    frame = spark.sql(
        "SELECT timestamp'2026-02-09 01:02:03' AS a, timestamp'2026-02-09 01:02:03.000450' AS b,"
        " cast(null AS timestamp) AS c"
    )
    row = frame.select(*[dates.iso_text(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("2026-02-09T01:02:03+00:00", "2026-02-09T01:02:03.000450+00:00", None)


def test_decoding(apply):
    raw = ["공지".encode("cp949"), b"\xff\xfe\x41", None]
    assert apply(decode_cp949, raw, "v binary")[0] == "공지"
    assert apply(decode_cp949, raw, "v binary")[1] == b"\xff\xfe\x41".decode("cp949", "replace")
    assert apply(decode_utf8, ["공지".encode(), b"A\xff", None], "v binary") == ["공지", "A�", None]


def test_dates_with_unicode_spaces_and_digits(apply):
    from tidings.functions.dates import date_month_name, date_year_first

    assert apply(date_year_first, ["2026년\xa02월\xa09일", "2026-2-9"]) == ["2026.02.09", "2026.02.09"]
    assert apply(date_month_name, ["Feb\xa09,\xa02026", "Mar 10, 2026"]) == ["2026.02.09", "2026.03.10"]


def test_published_date_in_other_digits(apply):
    found = apply(dates.published_at, ["２０２６.０２.09", "٢٠٢٦-٢-٩"])
    assert [f.strftime("%Y-%m-%d") for f in found] == ["2026-02-09"] * 2


OPEN_NAMES = {
    "<title>a&amp;&amp</title>": "a&&amp",
    "<p>&copy 1 &lt;b&gt &eacute;": "&copy 1 <b&gt é",
    "x\n<i title='\n'>&amp;</i>\n&amp": "x\n&\n&amp",
    "&am<b>&#65 &unknown;</b>": "&am\nA &unknown",
}


def test_names_without_semicolon_stay_text(apply):
    assert apply(text.visible_text, list(OPEN_NAMES)) == list(OPEN_NAMES.values())


def test_names_without_semicolon_stay_text_in_trees(apply):
    got = apply(lambda c: shown_text(parse_html(c), "\n"), list(OPEN_NAMES))
    assert got == list(OPEN_NAMES.values())


def test_worker_holds_trees_of_a_slice_only(monkeypatch):
    monkeypatch.setattr(dom, "SLICE_CHARS", 1 << 15)
    pages = [f"<p>{k}</p>" + "<b>x</b>" * 500 for k in range(30)] + [None, "<p>last</p>"]

    def peak(n):
        tracemalloc.start()
        rows = [len(trees) for trees in _parse_slices(iter([pa.array(pages * n)]))]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, top

    (few, small), (many, large) = peak(1), peak(4)
    assert sum(few) == len(pages) and sum(many) == 4 * len(pages)
    assert len(many) > 3 * len(few) and large < 1.2 * small


def test_slices_give_the_rows_of_their_pages(apply, monkeypatch):
    pages = [None if k % 7 == 3 else f"<p>{k}" * (k % 5) for k in range(40)]
    whole = apply(parse_html, pages)
    monkeypatch.setattr(dom, "SLICE_CHARS", 10)
    assert apply(parse_html, pages) == whole
    assert [page is None for page in pages] == [tree is None for tree in whole]


PIECES = (
    "<p>", "</p>", '<div class=" a  b ">', '<DIV ID="x">', "</DIV >", "<br>", "<br/>", "</br>", '<img src="a" />',
    '<table border="1">', "<tbody>", "</table>", "<tr><td>", "</td></tr>", "text", "  ", "\n", "\xa0", "é漢", "\r",
    "&amp;", "&foo;", "&amp", "&#65;", "&#1;", "&#65", "& ", "&a-b;", "<!-- c -->", "<!---->", "<!-- a--b -->", "<!--->",
    "<script>var a = 1;</script>", "<script>if (a < b) x();</script>", '<SCRIPT type="x">a &amp; b</script>',
    "<style></style>", '<script src="x"/>', "<scripty>", '<style a="b"> </STYLE>', "<script>a</style></script>", "</script>",
    "<textarea>  ", "</textarea>", "<pre>", "</pre>", "<noscript>", "</noscript>", "<iframe>", "<template>", "</template>",
    '<a href="u&amp;v">', '<a href="u&quot;&#300;">', '<a href="&amp">', "<a href='u'>", "<a href=u>", "<a href>",
    '<a href="x"title="y">', '<a href="x" HREF="y" class="b  c">', '<a href="<b>">', '<a b = "c">', "</a>", "<a / >",
    "<!DOCTYPE html>", "<!doctype x", "<?php x ?>", "<![CDATA[x]]>", "</>", "</ p>", "</p x>", "<", "<3", "<p", "</p",
    "<o:p>", "<x\x00>", "<p\x0b>", "<li>", "<option>",
)


def _columns(build, html):
    """Entries of a page behind those of another one."""
    entries = dom._Entries()
    dom._TreeBuilder(entries).build('<p id="x">x')
    taken = build(entries, html)
    return taken, {name: list(column) for name, column in vars(entries).items()}


def test_plain_pages_give_the_entries_of_the_tokenizer():
    draw, plain = random.Random(1), 0
    for k in range(6000):
        html = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 3 + k % 2 * 9)))
        taken, got = _columns(dom._add_plain, html)
        _, want = _columns(lambda entries, page: dom._TreeBuilder(entries).build(page), html)
        plain += taken
        assert got == (want if taken else _columns(lambda *_: None, "")[1]), html
    assert 2000 < plain < 5000


def test_board_pages_need_no_tokenizer(spark, monkeypatch):
    documents = spark.createDataFrame(
        [(k, f"A < {k} & \"b\"\n\n it's more\nof 漢 &nbsp; it") for k in range(7)], "doc_id long, text string"
    )
    pages = [r.html for p in (boards.list_pages, boards.detail_pages, boards.post_pages) for r in p(documents).collect()]
    monkeypatch.setattr(dom, "_TreeBuilder", None)
    assert len(pages) > 30 and not any(tree is None for tree in dom._parse(pages))
