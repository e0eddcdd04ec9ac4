"""Site rules on small pages written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from tidings.functions.dom import escape, parse_html
from tidings.operators.details import extract_details
from tidings.operators.links import extract_links
from tidings.plans.sites import SITES
from tidings.sources.pages import decoded, split_by_size, split_readable, trees

BASE = "https://site.example/board/list.do?mode=list"


@pytest.fixture(scope="module")
def extracted(spark):
    """Run all pages of this module in one job each for links and details."""
    pages = [(code, i, BASE, html) for i, (code, html) in enumerate(PAGES.values())]
    frame = spark.createDataFrame(pages, "source_code string, page_id long, url string, html string")
    tree = frame.withColumn("dom", parse_html(F.col("html")))
    names = list(PAGES)
    links, details = {n: [] for n in names}, {}
    for r in sorted(extract_links(tree, SITES).collect(), key=lambda r: (r.list_page_id, r.pos)):
        links[names[r.list_page_id]].append((r.no, r.url.replace("https://site.example", ""), r.title))
    for r in extract_details(tree, SITES).collect():
        details[names[r.page_id]] = r
    return links, details


PAGES = {
    "eng_list": (
        "engineering",
        "<table><tr><td>9</td><td><a href='/head'>no tbody</a></td></tr><tbody>"
        "<tr><td>공지</td><td><a href='?a=1'>x</a></td></tr>"
        "<tr><td> 12 </td><td><a href='?a=2'>x</a><a href='?a=3'>y</a></td></tr>"
        "<tr><td></td><td><a href='?a=4'>x</a></td></tr>"
        "<tr><td>13</td><td>no link</td></tr><tr><td>14</td><td><a>no href</a></td></tr>"
        "<tr><th>15</th></tr></tbody></table>",
    ),
    "sci_list": (
        "science",
        "<div class='nxb-list-table'><table><tbody>"
        "<tr><td class='nxb-list-table__num'><i class='nxb-list-table__notice-icon'></i>7</td>"
        "<td class='nxb-list-table__title'><a href='/p'>pinned</a></td></tr>"
        "<tr><td class='nxb-list-table__num'>8</td>"
        "<td class='nxb-list-table__title'><a href='/q'> A <b>B</b></a></td></tr>"
        "<tr><td>9</td><td class='nxb-list-table__title'><a href='/r'>x</a></td></tr>"
        "</tbody></table></div>"
        "<table><tbody><tr><td class='nxb-list-table__num'>1</td>"
        "<td class='nxb-list-table__title'><a href='/s'>other table</a></td></tr></tbody></table>",
    ),
    "med_list": (
        "medicine",
        "<div class='bbs-item x'><a href='?mode=view&amp;articleNo=5'>a</a></div>"
        "<div class='bbs-item'><a href='?mode=view&amp;articleNo=5'>same</a></div>"
        "<div class='bbs-item'><a href='?mode=view&amp;k=6'>no key</a></div>"
        "<div class='bbs-item'><a href='?page=2'>other</a></div><div class='bbs-item'>none</div>",
    ),
    "med_fallback": (
        "medicine",
        "<ul class='bbs-list'><li><a href='?articleNo=1'>a</a></li></ul>"
        "<table><tbody><tr><td><a href='?articleNo=2'>b</a></td></tr></tbody></table>",
    ),
    "med_rows": (
        "medicine",
        "<table><tbody><tr><td><a href='?articleNo=2'>b</a></td></tr></tbody></table>",
    ),
    "ai_list": (
        "ai",
        "<table><tbody><tr><td>3</td><td><a href='http://x.example/v?id=1'>second cell</a></td></tr>"
        "<tr><td>4</td><td><a href='/no'>n</a></td><td class='td_subject'><a href='/yes'>y</a></td></tr>"
        "<tr><td>5</td></tr></tbody></table>",
    ),
    "glc_list": (
        "glc",
        "<table><tr><td class='kboard-list-uid'>21</td><td class='kboard-list-title'><a href='/u'>"
        "<div class='kboard-default-cut-strings'> T </div> new</a></td></tr>"
        "<tr><td class='kboard-list-uid'>22</td><td class='kboard-list-title'><a href='/v'>plain</a></td></tr>"
        "<tr><td class='kboard-list-uid'>공지</td><td class='kboard-list-title'><a href='/w'>n</a></td></tr></table>",
    ),
    "uic_list": (
        "underwood",
        "<div class='divbox_half_news'><span class='Text_26bk'>Aca</span><div class='newsbox'>"
        + "".join(f"<a href='/n{i}'>t{i}</a>" for i in range(3))
        + "<a href='/m'>More</a><a href='/e'> </a>"
        + "".join(f"<a href='/n{i}'>t{i}</a>" for i in range(3, 7))
        + "</div></div><div class='divbox_half_news'><div class='newsbox'>"
        "<a href='/x'>x</a><a>no href</a><a href='/y'>y</a></div></div>"
        "<div class='divbox_half_news'><div class='newsbox'></div></div>"
        "<div class='divbox_half_news'><span class='Text_26bk'>Z</span></div>",
    ),
    "biz_list": (
        "business",
        "<table><tr><td>31</td><td class='Subject'><a href='/a?idx=1'> A </a></td></tr>"
        "<tr><td>Link</td><td class='Subject'><a href='/a?idx=2'>B</a></td></tr>"
        "<tr><td>33</td><td class='Subject'><a href='/a?idx=1'>again</a></td></tr>"
        "<tr><td class='Subject'><a href='/a?idx=4'>no number cell</a></td></tr></table>",
    ),
    "biz_lower": ("business", "<table><tr><td>1</td><td class='subject'><a href='/z'>z</a></td></tr></table>"),
    "eng_detail": (
        "engineering",
        "<table><tr><th>제목</th><td> Hello <b>World</b></td></tr></table><p>2026-02-19 2025.01.01</p>"
        "<dl><dt>첨부</dt><dd><a href='/f'>f.pdf</a><a href='#x'>no</a>"
        "<a href='javascript:x()'>no</a><a href='/f'>f.pdf</a></dd></dl>"
        "<dl><dt>게시글 내용</dt><dd><div> A <p> </p><p>B<br>C</p></div><span>in</span>line"
        "<!-- hidden --><script>s()</script><div><div class='btn-wrap'>q</div></div>"
        "<table><tr><td>x &lt; y<script>z</script><table><tr><td>n</td></tr></table></td></tr></table>"
        "<img src='/a/pic.png?x=1'><img src='/icon/a.png'><img src='data:image/jpeg;base64,AAA'>"
        "<img src='/a/pic.png?x=1'><img src='rel.png'><img data-file_name='n.gif' src='http://h.example/i'>"
        "<p>tail</p>답변글 버튼<p>cut</p></dd></dl>",
    ),
    "eng_no_label": ("engineering", "<h3> Only <br>heading </h3><p>no date</p>"),
    "eng_blank_body": ("engineering", "<dl><dt>게시글 내용</dt><dd> <p> </p></dd></dl>"),
    "ai_detail": (
        "ai",
        "<h2 class='bo_v_title'>T <i>x</i></h2><section id='bo_v_info'>조회 3 26 - 2 - 9</section>"
        "<div><!-- 본문 내용 시작 { --> <p>one</p>text<!-- note --><p>two</p>"
        "<img src='/a.png'><img src='data:image/png;base64,A'><img src='b/c'>"
        "<!-- } 본문 내용 끝 --><p>after</p></div>"
        "<!-- 첨부파일 시작 --><ul><li><a href='./download.php?n=0'> a.hwp </a></li>"
        "<li><a href='/view'>no</a></li></ul><!-- 첨부파일 끝 -->",
    ),
    "sci_detail": (
        "science",
        "<h3 class='nxb-view__header-title'>S</h3><div class='nxb-view__info-dt'>조회</div>"
        "<div class='nxb-view__info-dd'>5</div><div class='nxb-view__info-dt'>작성일</div>"
        "<div class='nxb-view__info-dd'>2026.2.9 10:00</div>"
        "<div><!-- 게시물 내용 --><div>a &amp; b<br/></div><table class='t' border=''><tr><td>1"
        "</table><img src='../up/사진 1.png'><img src='../up/사진 1.png'>"
        "<div class='nxb-view__files'>f</div>stays<p>goes</p><!-- // 게시물 내용 --></div>"
        "<div class='file-name-area'> a.pdf <span>1 KB</span></div>",
    ),
    "med_detail": (
        "medicine",
        "<div class='article-header'>Only text 2026. 2. 9</div><div class='fr-view'><p>a</p>"
        "<script>x</script><img src='i.png'><table border='2'></table><div><!-- 키워드/태그 --><p>cut</p></div>"
        "<p>kept</p></div><div class='attach-files'><a href='?mode=download&n=1'>m.pdf</a><a href='/x'>n</a></div>",
    ),
    "glc_detail": (
        "glc",
        "<div class='kboard-title'><h1>G</h1></div><div class='detail-date'>"
        "<div class='detail-name'>x</div><div class='detail-value'>2026-2-9 01:02</div></div>"
        "<div class='content-view'> <p b='2' a=\"it's\">q &lt; r</p><img data-orig-src='/o.png' src='/s.png'>"
        "<img src='data:image/gif;base64,btn'><img src='/folder/'></div>"
        "<button class='x kboard-button-download-2'>g.pdf</button>",
    ),
    "uic_detail": (
        "underwood",
        "<div id='BoardViewTitle'>U</div><div id='BoardViewAdd'>Posted</div>"
        "<div id='BoardViewAdd'>Feb 9, 2026 <b>Views: 3</b></div>"
        "<div id='BoardViewAdd'><a href='/f'><img src='/ext_pdf.gif'> \"u file.pdf (1,234 Bytes)</a><a href='/g'>no image</a></div>"
        "<div id='BoardContent'><p>body</p><img src='/ext_doc.gif'></div>",
    ),
    "biz_detail": (
        "business",
        "<h2>Heading</h2><div id='BoardViewAdd'>등록일 : 26-02-09</div>"
        "<div id='BoardContent'><p>b</p><div id='boardicon'><p>x</p></div><iframe>y</iframe>"
        "<img src='up/p.png'></div><a href='/downloadfile.asp?n=1'>z.pdf</a>",
    ),
    "biz_empty": ("business", "<p>nothing</p>"),
}


def test_numbered_rows(extracted):
    links, _ = extracted
    assert links["eng_list"] == [("12", "/board/list.do?a=2", None)]
    assert links["sci_list"] == [("8", "/q", "AB")]
    assert links["ai_list"] == [("3", "http://x.example/v?id=1", None), ("4", "/yes", None)]
    assert links["glc_list"] == [("21", "/u", "T"), ("22", "/v", "plain")]


def test_item_boxes_and_fallbacks(extracted):
    links, _ = extracted
    assert links["med_list"] == [
        ("5", "/board/list.do?mode=view&articleNo=5", None),
        ("Post", "/board/list.do?mode=view&k=6", None),
    ]
    assert [x[0] for x in links["med_fallback"]] == ["1"]
    assert [x[0] for x in links["med_rows"]] == ["2"]


def test_category_boxes(extracted):
    links, _ = extracted
    assert links["uic_list"] == [
        ("1", "/n0", "[Aca] t0"),
        ("2", "/n1", "[Aca] t1"),
        ("3", "/n2", "[Aca] t2"),
        ("4", "/n3", "[Aca] t3"),
        ("5", "/n4", "[Aca] t4"),
        ("6", "/x", "[Notice] x"),
        ("7", "/y", "[Notice] y"),
    ]


def test_title_cells(extracted):
    links, _ = extracted
    assert links["biz_list"] == [
        ("31", "/a?idx=1", "A"),
        ("", "/a?idx=2", "B"),
        ("", "/a?idx=4", "no number cell"),
    ]
    assert links["biz_lower"] == [("1", "/z", "z")]


def images(row):
    return [(i["type"], i["data"].replace("https://site.example", ""), i["ext"], i["name"]) for i in row.images]


def test_engineering_detail(extracted):
    d = extracted[1]["eng_detail"]
    assert (d.title, d.date_str) == ("Hello World", "2026-02-19")
    assert d.html == (
        "A \nB\nC\ninline<table border=\"1\"><tr><td>x &lt; y<table><tr><td>n</td></tr></table>"
        "</td></tr></table>\ntail"
    )
    assert images(d) == [
        ("url", "/a/pic.png?x=1", "png", "pic.png"),
        ("base64", "AAA", "jpg", "image_3.jpg"),
        ("url", "http://h.example/i", "gif", "n.gif"),
    ]
    assert d.attachment_names == ["f.pdf"]


def test_engineering_defaults(extracted):
    d = extracted[1]["eng_no_label"]
    assert (d.title, d.date_str) == ("Only \nheading", "날짜 없음")
    assert d.html == "(본문 영역인 <dd> 태그를 찾지 못했습니다.)"
    assert extracted[1]["eng_blank_body"].html == "(본문 영역인 <dd> 태그를 찾지 못했습니다.)"


def test_ai_detail(extracted):
    d = extracted[1]["ai_detail"]
    assert (d.title, d.date_str) == ("Tx", "2026.02.09")
    assert d.html == "one\ntext note \ntwo"
    assert images(d) == [("url", "/a.png", None, "a.png"), ("url", "b/c", None, "image.jpg")]
    assert d.attachment_names == ["a.hwp"]


def test_science_detail(extracted):
    d = extracted[1]["sci_detail"]
    assert (d.title, d.date_str) == ("S", "2026.02.09")
    assert d.html == '<div>a &amp; b<br/></div><table border="1" class="t"><tr><td>1</td></tr></table>stays'
    assert images(d) == [("url", "/up/%EC%82%AC%EC%A7%84%201.png", None, "사진 1.png")]
    assert d.attachment_names == ["a.pdf"]


def test_medicine_detail(extracted):
    d = extracted[1]["med_detail"]
    assert (d.title, d.date_str) == ("Only text 2026. 2. 9", "2026.02.09")
    assert d.html == '<p>a</p><table border="2"></table><div></div><p>kept</p>'
    assert images(d) == [("url", "/board/i.png", None, "i.png")]
    assert d.attachment_names == ["m.pdf"]


def test_glc_detail(extracted):
    d = extracted[1]["glc_detail"]
    assert (d.title, d.date_str) == ("G", "2026.02.09")
    assert d.html == '<p a="it\'s" b="2">q &lt; r</p>'
    assert images(d) == [
        ("url", "/o.png", None, "o.png"),
        ("url", "/folder/", None, "image_3.jpg"),
    ]
    assert d.attachment_names == ["g.pdf"]


def test_underwood_detail(extracted):
    d = extracted[1]["uic_detail"]
    assert (d.title, d.date_str, d.html) == ("U", "2026.02.09", "<p>body</p>")
    assert d.images == []
    assert d.attachment_names == ["u file.pdf"]


def test_business_detail(extracted):
    d = extracted[1]["biz_detail"]
    assert (d.title, d.date_str, d.html) == ("Heading", "2026.02.09", "<p>b</p>")
    assert images(d) == [("url", "/board/up/p.png", None, "p.png")]
    assert d.attachment_names == ["z.pdf"]
    empty = extracted[1]["biz_empty"]
    assert (empty.title, empty.date_str) == ("제목 없음", "날짜 없음")
    assert empty.html == "(본문 BoardContent를 찾을 수 없습니다)"


def test_tree_of_broken_markup(spark):
    frame = spark.createDataFrame(
        [("<div><p>a<p>b</div>c</p><br></br><input/>&amp;&#65;",)], "html string"
    ).select(F.explode(parse_html(F.col("html"))).alias("e"))
    rows = frame.select("e.kind", "e.tag", "e.text", "e.pos", "e.peer", "e.parent").collect()
    shown = [(r.kind, r.tag or r.text) for r in rows]
    assert shown == [
        ("<", "div"), ("<", "p"), ("t", "a"), ("<", "p"), ("t", "b"), (">", "p"), (">", "p"),
        (">", "div"), ("t", "c"), ("<", "br"), (">", "br"), ("<", "input"), (">", "input"),
        ("t", "&A"),
    ]
    for r in rows:
        if r.peer is not None:
            assert rows[r.peer].peer == r.pos


def test_null_pages_and_size_guard(spark):
    pages = spark.createDataFrame(
        [("glc", 1, "u1", None), ("glc", 2, "u2", "x" * 11), ("glc", 3, "u3", "가" * 4)],
        "source_code string, page_id long, url string, html string",
    )
    kept, rejected = split_by_size(pages, max_bytes=10)
    assert [r.page_id for r in kept.collect()] == [1]
    assert sorted((r.url, r.reason, r.detail) for r in rejected.collect()) == [
        ("u2", "page_too_large", "11"), ("u3", "page_too_large", "12"),
    ]
    assert trees(pages, max_bytes=12).filter("dom is not null").count() == 2


def test_charset_of_each_source(spark):
    raw = spark.createDataFrame(
        [("business", "공지".encode("cp949")), ("glc", "공지".encode()), ("glc", b"\xffA")],
        "source_code string, content binary",
    )
    assert [r.html for r in decoded(raw, SITES).collect()] == ["공지", "공지", "�A"]


def test_tree_builder_is_linear_in_void_tags():
    import time

    from tidings.functions import dom

    def seconds(n):
        start = time.process_time()
        entries = dom._Entries()
        dom._TreeBuilder(entries).build("<p>x<br>y</p>" * n)
        return time.process_time() - start

    seconds(1000)
    small = seconds(20_000)
    assert seconds(80_000) < 8 * small


@pytest.mark.parametrize(
    "unit",
    [
        "<table><tbody><tr><td>1</td></tr></tbody></table>",
        "<p> <br></p><div><p></p></div>",
        "<p>x<br>y</p>",
    ],
    ids=["tables", "blank blocks", "breaks"],
)
def test_page_work_is_linear(spark, unit):
    """A page four times as long takes at most about four times as long."""

    def seconds(size):
        page = f"<!-- 본문 내용 시작 --><div>{unit * (size // len(unit))}</div><!-- 본문 내용 끝 -->"
        rows = spark.createDataFrame(
            [("ai", 1, BASE, page)], "source_code string, page_id long, url string, html string"
        )
        start = time.perf_counter()
        extract_details(trees(rows), SITES).select(F.length("html")).collect()
        extract_links(trees(rows), SITES).select("no").collect()
        return time.perf_counter() - start

    seconds(1000)
    small, large = (min(seconds(n) for _ in range(2)) for n in (50_000, 200_000))
    assert large < 6 * small + 1


def test_unreadable_pages_are_found_in_one_reading(spark):
    html = [None, "", "short", "long enough to go"]
    pages = spark.createDataFrame([("glc", f"u{k}", h, k) for k, h in enumerate(html)], "source_code string, url string, html string, page_id int")
    kept, rejected = split_readable(pages, 10, ["page_id"])
    assert sorted(r.url for r in kept.collect()) == ["u1", "u2"]
    assert sorted(map(tuple, rejected.collect())) == [("glc", "u0", "no_content", None, 0), ("glc", "u3", "page_too_large", "17", 3)]
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_escaped_texts(apply):
    rows = {"plain": "plain", "": "", "a & b": "a &amp; b", "<&lt;>": "&lt;&amp;lt;&gt;", "漢 > é": "漢 &gt; é"}
    assert apply(escape, list(rows)) == list(rows.values())
