"""Rules of the sources: how links and notice fields are found on their pages.

A ``Site`` is a bundle of column builders over the element tree, so a new source is a new
``Site`` value; a source with unusual pages passes its own builders of the same types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions import dates
from tidings.functions.dom import BLOCK_TAGS, find, has_class, has_id, inside, labelled_value, matches
from tidings.functions.text import let
from tidings.functions.urls import key_from_query
from tidings.operators import details as d
from tidings.operators import links as k
from tidings.operators.details import BodyRule, ImageRule
from tidings.operators.payload import MAX_HTML_BYTES

# Texts that stand for a missing title, date or body.
NO_TITLE = "제목 없음"
NO_DATE = "날짜 없음"
NO_BODY = "(본문 영역을 찾을 수 없습니다)"
NO_BODY_ENGINEERING = "(본문 영역인 <dd> 태그를 찾지 못했습니다.)"
NO_BODY_AI = "(본문을 찾을 수 없습니다)"
NO_BODY_BUSINESS = "(본문 BoardContent를 찾을 수 없습니다)"
NO_BODY_MEDICINE = "(본문 영역 .fr-view를 찾을 수 없습니다)"

# Patterns and word lists of the site rules.
ISO_DATE = r"(?U)\d{4}[.-]\d{2}[.-]\d{2}"
SPACED_DATE = r"(?U)\d{2,4}\s*[.-]\s*\d{1,2}\s*[.-]\s*\d{1,2}"
HEADER_DATE = r"(?U)\d{4}[.-]\s*\d{1,2}[.-]\s*\d{1,2}"
REGISTERED_DATE = r"(?U)등록일\s*:\s*([\d.-]+)"
ENGLISH_DATE = r"(?U)[A-Za-z]+\s+\d{1,2},\s+\d{4}"
SIZE_SUFFIX = r"(?iU)\([\d.,]+\s*(KB|MB|GB|Bytes?)\)"
ENGINEERING_BLOCKS = (*BLOCK_TAGS, "option")
ENGINEERING_GARBAGE = (".btn_area", ".btn-wrap", "#bo_v_share", "ul.btn_bo_user", "div.btn_confirm")
ENGINEERING_STOP_WORDS = ("관리자 if문", "답변글 버튼", "목록 List 버튼", "등록 버튼")
ENGINEERING_ICONS = ("icon", "btn", "button", "search", "blank")
ICONS = ("icon", "btn", "blank")
UNDERWOOD_ICONS = ("icon", "btn", "blank", "ext_")
CLEANED_TAGS = ("script", "style", "noscript", "iframe", "img")
MEDICINE_KEYS = ("articleNo", "article_no", "no", "id")
MEDICINE_NO_KEY = "Post"
UNDERWOOD_PER_BOX = 5


@dataclass(frozen=True)
class Site:
    code: str
    name: str
    links: Callable[[Column], Column]
    title: Callable[[Column], Column]
    date: Callable[[Column], Column]
    body: Callable[[Column], Column]
    html: BodyRule
    images: ImageRule
    attachments: Callable[[Column], Column]
    link_no: Callable[[Column], Column] | None = None
    unique_links: bool = False
    charset: str = "utf-8"
    max_page_bytes: int | None = None
    no_title: str = NO_TITLE
    no_date: str = NO_DATE
    no_body: str = NO_BODY


def _by_id(dom: Column, name: str, *tags: str) -> Column:
    return find(
        dom, lambda e: (e["tag"].isin(*tags) & has_id(e, name)) if tags else has_id(e, name)
    )


def _by_class(dom: Column, name: str, *tags: str) -> Column:
    return find(
        dom, lambda e: (e["tag"].isin(*tags) & has_class(e, name)) if tags else has_class(e, name)
    )


def _engineering_garbage(e: Column) -> Column:
    return reduce(or_, [matches(e, selector) for selector in ENGINEERING_GARBAGE])


ENGINEERING = Site(
    code="engineering",
    name="공과대학",
    links=lambda dom: k.numbered_row_links(dom, k.rows_of(dom)),
    title=lambda dom: d.labelled_title(dom, "제목", NO_TITLE, ENGINEERING_BLOCKS),
    date=lambda dom: d.date_in(dom, None, ISO_DATE),
    body=lambda dom: d.container_body(
        dom, labelled_value(dom, "게시글 내용"), _engineering_garbage
    ),
    html=BodyRule(
        as_text=True,
        block_tags=ENGINEERING_BLOCKS,
        stop_words=ENGINEERING_STOP_WORDS,
        empty_is_missing=True,
    ),
    images=ImageRule(ENGINEERING_ICONS, "host", "given", with_extension=True),
    attachments=lambda dom: d.attachments_at_labels(
        dom, "첨부", ("tr", "li", "div", "dl", "dt", "dd"), "javascript"
    ),
    no_body=NO_BODY_ENGINEERING,
)

SCIENCE = Site(
    code="science",
    name="이과대학",
    links=lambda dom: k.numbered_row_links(
        dom,
        k.rows_of(dom, "nxb-list-table"),
        number_class="nxb-list-table__num",
        pinned_icon_class="nxb-list-table__notice-icon",
        title_class="nxb-list-table__title",
        with_title=True,
    ),
    title=lambda dom: d.text_title(dom, _by_class(dom, "nxb-view__header-title", "h3")),
    date=lambda dom: d.date_beside(
        dom, "nxb-view__info-dt", "작성일", "nxb-view__info-dd", dates.date_year_first
    ),
    body=lambda dom: d.comment_region_body(
        dom, "게시물 내용", "// 게시물 내용", "nxb-view__files"
    ),
    html=BodyRule(),
    images=ImageRule(ICONS, "quoted", "path", skip_inline_too=True),
    attachments=lambda dom: d.attachments_of_boxes(dom, "file-name-area"),
)

MEDICINE = Site(
    code="medicine",
    name="의과대학",
    links=lambda dom: k.item_links(dom, "bbs-item", "bbs-list", ("articleNo", "mode=view")),
    link_no=lambda url: F.coalesce(key_from_query(url, MEDICINE_KEYS), F.lit(MEDICINE_NO_KEY)),
    unique_links=True,
    title=lambda dom: d.heading_title(
        dom, _by_class(dom, "article-header"), "h1", "h2", "h3", "h4"
    ),
    date=lambda dom: d.date_in(
        dom, _by_class(dom, "article-header"), HEADER_DATE, dates.date_from_parts
    ),
    body=lambda dom: d.body_until_comment(dom, _by_class(dom, "fr-view", "div"), "키워드/태그"),
    html=BodyRule(dropped_tags=CLEANED_TAGS),
    images=ImageRule(
        ICONS, "resolved", "default", inline_name="img.{ext}", jpeg_marks=("jpeg",)
    ),
    attachments=lambda dom: d.attachments_in(
        dom, _by_class(dom, "attach-files", "div"), "download", else_page=False
    ),
    no_body=NO_BODY_MEDICINE,
)

AI = Site(
    code="ai",
    name="인공지능융합대학",
    links=lambda dom: k.numbered_row_links(
        dom, k.rows_of(dom), title_class="td_subject", title_in_second_cell=True
    ),
    title=lambda dom: d.text_title(
        dom, F.coalesce(_by_id(dom, "bo_v_title"), _by_class(dom, "bo_v_title"))
    ),
    date=lambda dom: d.date_in(
        dom, _by_id(dom, "bo_v_info"), SPACED_DATE, dates.date_from_parts
    ),
    body=lambda dom: d.between_comments_body(dom, "본문 내용 시작", "본문 내용 끝"),
    html=BodyRule(as_text=True, block_tags=BLOCK_TAGS),
    images=ImageRule(ICONS, "root", "default", inline_name=""),
    attachments=lambda dom: d.attachments_between_comments(
        dom, "첨부파일 시작", "첨부파일 끝", "download.php"
    ),
    no_body=NO_BODY_AI,
)

GLC = Site(
    code="glc",
    max_page_bytes=MAX_HTML_BYTES,  # of a download; only this source has such a limit
    name="글로벌인재대학",
    links=lambda dom: k.numbered_row_links(
        dom,
        k.rows_of(dom, body_only=False),
        number_class="kboard-list-uid",
        title_class="kboard-list-title",
        with_title=True,
        title_text_class="kboard-default-cut-strings",
    ),
    title=lambda dom: let(
        _by_class(dom, "kboard-title", "div"),
        lambda box: d.text_title(dom, find(inside(dom, box), lambda e: e["tag"] == "h1")),
    ),
    date=lambda dom: let(
        _by_class(dom, "detail-date", "div"),
        lambda box: let(
            d.text_title(dom, _by_class(inside(dom, box), "detail-value", "div")),
            dates.date_year_first,
        ),
    ),
    body=lambda dom: d.container_body(dom, _by_class(dom, "content-view", "div")),
    html=BodyRule(),
    images=ImageRule(ICONS, "quoted", "path", skip_inline_too=True, lazy_source=True),
    attachments=lambda dom: d.attachments_of_buttons(dom, "kboard-button-download"),
)

UNDERWOOD = Site(
    code="underwood",
    name="언더우드국제대학",
    links=lambda dom: k.box_links(
        dom,
        "divbox_half_news",
        "Text_26bk",
        "newsbox",
        "Notice",
        "more",
        UNDERWOOD_PER_BOX,
    ),
    title=lambda dom: d.text_title(dom, _by_id(dom, "BoardViewTitle", "div")),
    date=lambda dom: d.date_in_boxes(
        dom, "BoardViewAdd", "Views:", ENGLISH_DATE, dates.date_month_name
    ),
    body=lambda dom: d.container_body(dom, _by_id(dom, "BoardContent", "div")),
    html=BodyRule(),
    images=ImageRule(UNDERWOOD_ICONS, "quoted", "path", skip_inline_too=True),
    attachments=lambda dom: d.attachments_with_icon(dom, "BoardViewAdd", SIZE_SUFFIX),
)

BUSINESS = Site(
    code="business",
    name="경영대학",
    charset="cp949",
    links=lambda dom: k.title_cell_links(dom, "Subject", "subject"),
    unique_links=True,
    title=lambda dom: let(
        _by_id(dom, "BoardViewTitle"),
        lambda box: F.coalesce(
            d.text_title(dom, box),
            d.text_title(dom, find(dom, lambda e: e["tag"].isin("h2", "h3"))),
        ),
    ),
    date=lambda dom: d.labelled_date(
        dom,
        _by_id(dom, "BoardViewAdd"),
        ((REGISTERED_DATE, 1), (ISO_DATE, 0)),
        dates.date_from_digit_runs,
    ),
    body=lambda dom: d.container_body(dom, _by_id(dom, "BoardContent", "div")),
    html=BodyRule(dropped_tags=CLEANED_TAGS, dropped_id="boardicon"),
    images=ImageRule(ICONS, "resolved", "default", inline_name="img.png"),
    attachments=lambda dom: d.attachments_in(
        dom, _by_id(dom, "BoardViewFile"), "downloadfile.asp", else_page=True
    ),
    no_body=NO_BODY_BUSINESS,
)


SITES = (ENGINEERING, SCIENCE, MEDICINE, AI, GLC, UNDERWOOD, BUSINESS)
