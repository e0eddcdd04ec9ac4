"""Detail extraction: title, date, body, images and attachment names of a notice page.

The functions here are building blocks over the element tree; ``plans.sites`` combines
them into the rules of each source.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dom import (
    CLOSE,
    COMMENT,
    DOM_TYPE,
    OPEN,
    TEXT,
    attr,
    enclosing,
    find,
    find_all,
    find_text,
    has_class,
    has_id,
    inside,
    is_element,
    is_void,
    labelled_value,
    next_sibling,
    outside_all,
    raw_text,
    shown_text,
    structural_text,
    text_of,
    to_html,
)
from tidings.functions.text import collapse_blank_lines, let, strip
from tidings.functions.urls import base_name, file_name, on_origin, quote_path, resolve_url
from tidings.operators.sources import per_source

IMAGE_TYPE = "array<struct<type:string,data:string,ext:string,name:string>>"
BODY_TYPE = f"struct<entries:{DOM_TYPE},dropped:{DOM_TYPE}>"


# --- titles -------------------------------------------------------------------------------


def structured_title(dom: Column, element: Column, block_tags: Column) -> Column:
    """Structural text of an element, stripped; null without element."""
    return let(
        element,
        lambda e: F.when(
            e.isNotNull(), strip(structural_text(inside(dom, e), F.slice(dom, 1, 0), block_tags))
        ),
    )


def text_title(dom: Column, element: Column) -> Column:
    """Shown text of an element; null without element."""
    return let(element, lambda e: text_of(dom, e))


def labelled_title(dom: Column, label: str, default: str, block_tags) -> Column:
    """Value beside a label; the first ``h3`` when there is none or it says ``default``."""
    blocks = F.split(F.lit(" ".join(block_tags)), " ")
    value = structured_title(dom, labelled_value(dom, label), blocks)
    heading = structured_title(dom, find(dom, lambda e: e["tag"] == "h3"), blocks)
    return let(
        value,
        lambda v: F.when(v.isNotNull() & (v != default), v).otherwise(heading),
    )


def heading_title(dom: Column, container: Column, *heading_tags: str) -> Column:
    """First heading in a container, else the text of the whole container."""
    return let(
        container,
        lambda c: F.coalesce(
            text_title(dom, find(inside(dom, c), lambda e: e["tag"].isin(*heading_tags))),
            text_of(dom, c),
        ),
    )


# --- dates --------------------------------------------------------------------------------


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def element_raw_text(dom: Column, element: Column) -> Column:
    return F.when(element.isNotNull(), raw_text(inside(dom, element)))


def date_in(dom: Column, element: Column | None, pattern: str, normalise=None) -> Column:
    """Date pattern in the text of ``element``, or of the whole page when it is missing."""

    def dated(text: Column) -> Column:
        found = matched(text, pattern)
        return normalise(found) if normalise else found

    if element is None:
        return let(raw_text(dom), dated)
    text = let(element, lambda e: F.coalesce(element_raw_text(dom, e), raw_text(dom)))
    return let(text, dated)


def labelled_date(dom: Column, element: Column, patterns, normalise) -> Column:
    """First of several ``(pattern, group)`` that matches in the text of ``element``."""
    return let(
        let(element, lambda e: element_raw_text(dom, e)),
        lambda text: normalise(F.coalesce(*[matched(text, p, g) for p, g in patterns])),
    )


def date_beside(dom: Column, label_class: str, label: str, value_class: str, normalise) -> Column:
    """Text of the value box that follows the first label box with ``label`` that has one."""
    labels = find_all(
        dom,
        lambda e: (e["tag"] == "div")
        & has_class(e, label_class)
        & raw_text(inside(dom, e)).contains(label),
    )

    def value_of(label_box: Column) -> Column:
        after = F.slice(dom, label_box["peer"] + 2, F.size(dom))
        sibling = find(
            after,
            lambda e: (e["tag"] == "div")
            & has_class(e, value_class)
            & (e["parent"] == label_box["parent"]),
        )
        return let(sibling, lambda s: text_of(dom, s))

    values = F.filter(F.transform(labels, value_of), lambda v: v.isNotNull())
    return let(F.get(values, 0), normalise)


def date_in_boxes(dom: Column, box_id: str, marker: str, pattern: str, normalise) -> Column:
    """Date from the last box with ``box_id`` that shows the marker or the pattern."""
    boxes = find_all(dom, lambda e: (e["tag"] == "div") & has_id(e, box_id))
    texts = F.transform(boxes, lambda b: shown_text(inside(dom, b)))
    dated = F.filter(texts, lambda t: t.contains(marker) | t.rlike(pattern))
    return let(F.get(F.reverse(dated), 0), normalise)


# --- body regions: struct<entries, dropped> -----------------------------------------------


def body(entries: Column, dropped: Column) -> Column:
    return F.struct(entries.alias("entries"), dropped.alias("dropped"))


def _nothing(dom: Column) -> Column:
    return F.slice(dom, 1, 0)


def container_body(dom: Column, container: Column, dropped_test=None) -> Column:
    """Content of an element without the elements that pass ``dropped_test``."""

    def cut(entries: Column) -> Column:
        if dropped_test is None:
            return body(entries, _nothing(dom))
        return let(
            find_all(entries, dropped_test), lambda d: body(outside_all(entries, d), d)
        )

    return let(
        container,
        lambda c: F.when(c.isNotNull(), let(inside(dom, c), cut)),
    )


def _shown_comments(entries: Column, parent: Column) -> Column:
    """Comments that are siblings of the region's start count as text."""
    return F.transform(
        entries,
        lambda e: F.when(
            (e["kind"] == COMMENT) & (e["parent"] == parent), e.withField("kind", F.lit(TEXT))
        ).otherwise(e),
    )


def _siblings_until(dom: Column, start: Column, stop: Column) -> Column:
    """Entries after ``start`` on its level, up to ``stop`` or the end of the parent."""
    parent_end = F.when(start["parent"] >= 0, F.get(dom, start["parent"])["peer"]).otherwise(
        F.size(dom)
    )
    stop_pos = F.when(
        (stop["parent"] == start["parent"]) & (stop["pos"] > start["pos"]), stop["pos"]
    )
    end = F.coalesce(stop_pos, parent_end)
    return _shown_comments(
        F.slice(dom, start["pos"] + 2, end - start["pos"] - 1), start["parent"]
    )


def comment_with(dom: Column, part: str, without: str | None = None) -> Column:
    """First comment that contains ``part`` and, if given, not ``without``."""

    def test(e: Column) -> Column:
        has = (e["kind"] == COMMENT) & e["text"].contains(part)
        return has if without is None else has & ~e["text"].contains(without)

    return F.get(F.filter(dom, test), 0)


def between_comments(dom: Column, start: str, end: str) -> Column:
    """Siblings between two comments, blank texts between them left out; null if empty."""

    def region(first: Column) -> Column:
        def is_stop(e: Column) -> Column:
            return (
                (e["kind"] == COMMENT)
                & (e["parent"] == first["parent"])
                & e["text"].contains(end)
            )

        stop = F.get(F.filter(F.slice(dom, first["pos"] + 2, F.size(dom)), is_stop), 0)
        kept = F.filter(
            let(stop, lambda s: _siblings_until(dom, first, s)),
            lambda e: ~(
                (e["kind"] == TEXT) & (e["parent"] == first["parent"]) & (strip(e["text"]) == "")
            ),
        )
        return let(kept, lambda k: F.when(F.size(k) > 0, k))

    return let(comment_with(dom, start), lambda c: F.when(c.isNotNull(), region(c)))


def between_comments_body(dom: Column, start: str, end: str) -> Column:
    return let(
        between_comments(dom, start, end),
        lambda k: F.when(k.isNotNull(), body(k, _nothing(dom))),
    )


def comment_region_body(dom: Column, start: str, end: str, files_class: str) -> Column:
    """Siblings from a start comment to an end comment, cut at the block of attached files.

    From that block on every element goes; only texts that stand beside it or its parents
    remain.
    """

    def without_files(entries: Column) -> Column:
        def cut(files: Column) -> Column:
            def stays(e: Column) -> Column:
                behind = e["pos"] > files["peer"]
                outer_text = (e["parent"] < files["pos"]) & ~e["kind"].isin(OPEN, CLOSE)
                outer_close = (e["kind"] == CLOSE) & (e["peer"] < files["pos"])
                return (e["pos"] < files["pos"]) | (behind & (outer_text | outer_close))

            return F.when(files.isNull(), entries).otherwise(F.filter(entries, stays))

        return let(
            find(entries, lambda e: (e["tag"] == "div") & has_class(e, files_class)), cut
        )

    def region(first: Column, stop: Column) -> Column:
        return let(let(_siblings_until(dom, first, stop), without_files), lambda k: body(k, _nothing(dom)))

    return let(
        comment_with(dom, start, without="//"),
        lambda first: F.when(
            first.isNotNull(), let(comment_with(dom, end), lambda stop: region(first, stop))
        ),
    )


def body_until_comment(dom: Column, container: Column, part: str) -> Column:
    """Content of an element; a comment with ``part`` and its later siblings are cut."""

    def cut(entries: Column) -> Column:
        def kept(mark: Column) -> Column:
            end = F.get(dom, mark["parent"])["peer"]
            return F.when(mark.isNull(), entries).otherwise(
                F.filter(entries, lambda e: (e["pos"] < mark["pos"]) | (e["pos"] >= end))
            )

        return let(let(comment_with(entries, part), kept), lambda k: body(k, _nothing(dom)))

    return let(container, lambda c: F.when(c.isNotNull(), let(inside(dom, c), cut)))


# --- rules that are plain data ------------------------------------------------------------


@dataclass(frozen=True)
class BodyRule:
    """How a body region is written: as structural text or as cleaned HTML."""

    as_text: bool = False
    block_tags: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    dropped_tags: tuple[str, ...] = ("img",)
    dropped_id: str = ""
    empty_is_missing: bool = False


@dataclass(frozen=True)
class ImageRule:
    """Which images of a region count, and how address and name are made.

    ``address``: ``host`` (root-relative or absolute only), ``root`` (root-relative gets the
    host, others unchanged), ``resolved`` against the page, ``quoted`` (resolved, path
    percent-encoded). ``naming``: ``given`` (attribute, else base name, else numbered),
    ``default`` (base name, else ``image.jpg``), ``path`` (base name of the path, else
    numbered). Inline images are dropped when ``inline_name`` is empty.
    """

    icons: tuple[str, ...]
    address: str
    naming: str
    inline_name: str = "image_{n}.{ext}"
    jpeg_marks: tuple[str, ...] = ("jpeg", "jpg")
    skip_inline_too: bool = False
    with_extension: bool = False
    lazy_source: bool = False


RULE_TYPE = (
    "struct<no_title:string,no_date:string,no_body:string,"
    "body:struct<as_text:boolean,block_tags:array<string>,stop_words:array<string>,"
    "dropped_tags:array<string>,dropped_id:string,empty_is_missing:boolean>,"
    "images:struct<icons:array<string>,address:string,naming:string,inline_name:string,"
    "jpeg_marks:array<string>,skip_inline_too:boolean,with_extension:boolean,"
    "lazy_source:boolean>>"
)


def rule_of(code: Column, sites) -> Column:
    """The data part of a source's rules, from one constant that is folded while planning."""
    rules = {
        s.code: {
            "no_title": s.no_title,
            "no_date": s.no_date,
            "no_body": s.no_body,
            "body": asdict(s.html),
            "images": asdict(s.images),
        }
        for s in sites
    }
    constant = F.from_json(
        F.lit(json.dumps(rules, ensure_ascii=False)), f"map<string,{RULE_TYPE}>"
    )
    return F.try_element_at(constant, code)


# --- body content -------------------------------------------------------------------------


def write_body(region: Column, rule: Column) -> Column:
    """Body text or HTML of a region by its rule."""

    def as_text(r: Column) -> Column:
        text = structural_text(r["entries"], r["dropped"], rule["block_tags"])
        cut = F.aggregate(
            rule["stop_words"], text, lambda t, word: F.split_part(t, word, F.lit(1))
        )
        return collapse_blank_lines(cut)

    def dropped(name: Column) -> Column:
        return F.coalesce(F.array_contains(rule["dropped_tags"], name), F.lit(False))

    def as_html(r: Column) -> Column:
        # Entries of a dropped tag go by their own tag, and content that is never shown goes
        # by its zone: one pass. Only other elements with content are cut as intervals.
        left = F.filter(r["entries"], lambda e: ~dropped(e["tag"]) & ~dropped(e["zone"]))
        by_tag = find_all(
            r["entries"],
            lambda e: (dropped(e["tag"]) & ~is_void(e) & ~e["zone"].eqNullSafe(e["tag"]))
            | ((rule["dropped_id"] != "") & F.coalesce(attr(e, "id") == rule["dropped_id"], F.lit(False))),
        )
        return to_html(outside_all(left, by_tag))

    return let(
        region,
        lambda r: F.when(r.isNull(), F.lit(None).cast("string"))
        .when(rule["as_text"], as_text(r))
        .otherwise(as_html(r)),
    )


# --- images -------------------------------------------------------------------------------


def _image(kind: str, data: Column, ext: Column, name: Column, rule: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        data.alias("data"),
        F.when(rule["with_extension"], ext).alias("ext"),
        name.alias("name"),
    )


def first_by_data(images: Column) -> Column:
    """Keep the first URL image per address and all inline images, in order.

    Sort by (address, position), compare neighbours, sort back: n log n inside the row.
    """

    def kept(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: (x["img"]["type"] != "url")
            | (i == 0)
            | (x["data"] != F.get(ordered, i - 1)["data"])
            | (F.get(ordered, i - 1)["img"]["type"] != "url"),
        )

    keyed = F.transform(
        images,
        lambda x, i: F.struct(
            x["data"].alias("data"), x["type"].alias("type"), i.alias("i"), x.alias("img")
        ),
    )
    back = F.transform(
        let(F.array_sort(keyed), kept), lambda x: F.struct(x["i"].alias("i"), x["img"].alias("img"))
    )
    return F.transform(F.array_sort(back), lambda x: x["img"])


def _path_name(url: Column) -> Column:
    """Base name of the path of a URL, parameters left out."""
    path = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    return F.element_at(F.split(F.regexp_replace(path, r"(?s);[^/]*$", ""), "/"), -1)


def find_images(entries: Column, page_url: Column, rule: Column) -> Column:
    """Images of a region as ``array<struct<type,data,ext,name>>``, each address once."""

    def inline(src: Column, number: Column) -> Column:
        header = F.substring_index(src, ",", 1)
        ext = F.when(
            F.exists(rule["jpeg_marks"], lambda m: header.contains(m)), F.lit("jpg")
        ).otherwise(F.lit("png"))
        name = F.replace(rule["inline_name"], F.lit("{n}"), number)
        name = F.replace(name, F.lit("{ext}"), ext)
        data = F.regexp_extract(src, r"(?s)^[^,]*,(.*)$", 1)
        return F.when(
            src.contains(",") & (rule["inline_name"] != ""),
            _image("base64", data, ext, name, rule),
        )

    def address(src: Column, resolved: Column) -> Column:
        root = src.startswith("/")
        return (
            F.when(rule["address"] == "resolved", resolved)
            .when(rule["address"] == "quoted", quote_path(resolved))
            .when(root, on_origin(page_url, src))
            .when((rule["address"] == "root") | src.startswith("http"), src)
        )

    def name(e: Column, src: Column, resolved: Column, url: Column, number: Column) -> Column:
        numbered = F.concat(F.lit("image_"), number, F.lit(".jpg"))
        given = F.coalesce(F.nullif(attr(e, "data-file_name"), F.lit("")), base_name(src))
        return (
            F.when(
                rule["naming"] == "given",
                F.when(given.contains("."), given).otherwise(numbered),
            )
            .when(rule["naming"] == "default", file_name(url, F.lit("image.jpg")))
            .otherwise(F.coalesce(F.nullif(_path_name(resolved), F.lit("")), numbered))
        )

    def linked(e: Column, src: Column, number: Column) -> Column:
        def with_name(resolved: Column, url: Column) -> Column:
            return let(
                name(e, src, resolved, url, number),
                lambda n: F.when(
                    url.isNotNull(),
                    _image("url", url, F.element_at(F.split(n, r"\."), -1), n, rule),
                ),
            )

        return let(
            resolve_url(page_url, src),
            lambda resolved: let(
                address(src, resolved), lambda url: with_name(resolved, url)
            ),
        )

    def one(e: Column, i: Column) -> Column:
        lazy = F.when(rule["lazy_source"], F.nullif(attr(e, "data-orig-src"), F.lit("")))

        def from_source(src: Column) -> Column:
            is_inline = src.startswith("data:image")
            icon = F.exists(rule["icons"], lambda part: src.contains(part))
            unwanted = icon & (rule["skip_inline_too"] | ~is_inline)
            number = (i + 1).cast("string")
            return F.when(
                src.isNotNull() & ~unwanted,
                F.when(is_inline, inline(src, number)).otherwise(linked(e, src, number)),
            )

        return let(F.coalesce(lazy, F.nullif(attr(e, "src"), F.lit(""))), from_source)

    found = F.transform(F.filter(entries, lambda e: is_element(e, "img")), one)
    return first_by_data(F.filter(found, lambda x: x.isNotNull())).cast(IMAGE_TYPE)


# --- attachments --------------------------------------------------------------------------


def _names(texts: Column) -> Column:
    """Non-empty names, each once, in order of first appearance."""
    return F.array_distinct(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""))


def anchor_names(dom: Column, entries: Column, href_test) -> Column:
    """Texts of the links whose target passes ``href_test``."""
    anchors = find_all(
        entries, lambda e: (e["tag"] == "a") & href_test(F.coalesce(attr(e, "href"), F.lit("")))
    )
    return F.transform(anchors, lambda a: text_of(dom, a))


def attachments_at_labels(dom: Column, label: str, row_tags, script_mark: str) -> Column:
    """Links in the row around every text with ``label``; a ``dt`` hands over to its ``dd``."""

    def names_at(text: Column) -> Column:
        def of_row(row: Column) -> Column:
            return F.when(
                row.isNotNull(),
                anchor_names(
                    dom,
                    inside(dom, row),
                    lambda href: (href != "")
                    & ~href.startswith("#")
                    & ~href.contains(script_mark),
                ),
            )

        def value_of(row: Column) -> Column:
            return F.when(
                row["tag"] == "dt", F.coalesce(next_sibling(dom, row, "dd"), row)
            ).otherwise(row)

        return let(let(enclosing(dom, text, *row_tags), value_of), of_row)

    labels = F.filter(
        dom, lambda e: ~e["kind"].isin(OPEN, CLOSE) & e["text"].contains(label)
    )
    lists = F.filter(F.transform(labels, names_at), lambda x: x.isNotNull())
    return _names(F.flatten(lists))


def attachments_between_comments(dom: Column, start: str, end: str, href_part: str) -> Column:
    return _names(
        let(
            between_comments(dom, start, end),
            lambda k: anchor_names(dom, k, lambda href: href.contains(href_part)),
        )
    )


def attachments_in(dom: Column, area: Column, href_part: str, else_page: bool) -> Column:
    """Download links of an area; with ``else_page`` of the whole page when it is missing."""

    def scope(a: Column) -> Column:
        inner = inside(dom, a)
        return F.coalesce(inner, dom) if else_page else inner

    return _names(
        let(
            let(area, scope),
            lambda entries: anchor_names(dom, entries, lambda href: href.contains(href_part)),
        )
    )


def attachments_of_buttons(dom: Column, class_part: str) -> Column:
    buttons = find_all(
        dom,
        lambda e: (e["tag"] == "button")
        & F.coalesce(attr(e, "class").contains(class_part), F.lit(False)),
    )
    return _names(F.transform(buttons, lambda b: text_of(dom, b)))


def attachments_of_boxes(dom: Column, box_class: str) -> Column:
    """Own texts of the boxes, texts of inner elements left out."""

    def own_text(box: Column) -> Column:
        own = F.filter(
            inside(dom, box),
            lambda e: (e["parent"] == box["pos"]) & ~e["kind"].isin(OPEN, CLOSE),
        )
        return strip(F.array_join(F.transform(own, lambda e: e["text"]), ""))

    boxes = find_all(dom, lambda e: (e["tag"] == "div") & has_class(e, box_class))
    return _names(F.transform(boxes, own_text))


def attachments_with_icon(dom: Column, box_id: str, size_pattern: str) -> Column:
    """Links that hold an image, in the boxes with ``box_id``; size suffixes are removed."""

    def name(a: Column) -> Column:
        text = strip(F.btrim(shown_text(inside(dom, a), " "), F.lit('"')))
        return strip(F.regexp_replace(text, size_pattern, ""))

    def of_box(box: Column) -> Column:
        anchors = find_all(
            inside(dom, box),
            lambda e: (e["tag"] == "a")
            & F.exists(inside(dom, e), lambda x: is_element(x, "img")),
        )
        return F.transform(anchors, name)

    boxes = find_all(dom, lambda e: (e["tag"] == "div") & has_id(e, box_id))
    return _names(F.flatten(F.transform(boxes, of_box)))


# --- the job ------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _detail_columns(sites, application: str):
    """The rules of ``sites`` as expressions: helper columns, then result columns.

    Putting them together takes seconds of driver time, so they are kept for the
    application; a ``Column`` belongs to no DataFrame.
    """
    code, dom, url = F.col("source_code"), F.col("dom"), F.col("url")

    def choose(expression) -> Column:
        return per_source(code, {s.code: expression(s) for s in sites})

    region, rule = F.col("body"), F.col("rule")
    html = let(
        write_body(region, rule["body"]),
        lambda h: F.when(
            h.isNull() | (rule["body"]["empty_is_missing"] & (h == "")), rule["no_body"]
        ).otherwise(h),
    )
    images = find_images(region["entries"], url, rule["images"])
    helpers = {
        "body": choose(lambda s: s.body(dom).cast(BODY_TYPE)),
        "rule": rule_of(code, sites),
    }
    results = {
        "title": F.when(
            dom.isNotNull(), F.coalesce(choose(lambda s: s.title(dom)), rule["no_title"])
        ),
        "date_str": F.coalesce(choose(lambda s: s.date(dom)), rule["no_date"]),
        "html": html,
        "images": F.coalesce(images, F.array().cast(IMAGE_TYPE)),
        "attachment_names": F.coalesce(
            choose(lambda s: s.attachments(dom)), F.array().cast("array<string>")
        ),
    }
    return helpers, [column.alias(name) for name, column in results.items()]


def extract_details(trees: DataFrame, sites, carried=()) -> DataFrame:
    """One row per page: ``source_code, page_id, url, title, date_str, html, images,
    attachment_names`` and ``carried`` columns.

    ``trees`` has ``source_code, page_id, url, dom``. No shuffle; each rule is evaluated on
    the rows of its own source only. A page the tokenizer refused has no title (null), which
    is what it is rejected for later; any other page has one, be it empty.
    """
    application = trees.sparkSession.sparkContext.applicationId
    helpers, results = _detail_columns(tuple(sites), application)
    return trees.withColumns(helpers).select("source_code", "page_id", "url", *results, *carried)
