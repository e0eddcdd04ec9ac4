"""Link extraction: list pages to one row per post link, by the rules of each source."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dom import (
    attr,
    find,
    find_all,
    has_class,
    inside,
    is_element,
    shown_text,
    text_of,
)
from tidings.functions.text import is_digits, let
from tidings.functions.urls import resolve_url
from tidings.operators.sources import per_source

LINK_TYPE = "array<struct<no:string,href:string,title:string>>"


def link(no: Column, href: Column, title: Column | None = None) -> Column:
    title = F.lit(None).cast("string") if title is None else title
    return F.struct(no.alias("no"), href.alias("href"), title.alias("title"))


def _present(links: Column) -> Column:
    """Only links that have a target; null entries stand for rows that gave none."""
    return F.filter(links, lambda x: F.coalesce(x["href"], F.lit("")) != "")


def _or_else(first: Column, second: Column) -> Column:
    """``first`` unless it is empty."""
    return let(first, lambda x: F.when(F.size(x) > 0, x).otherwise(second))


def _anchor(entries: Column) -> Column:
    return find(entries, lambda e: e["tag"] == "a")


def rows_of(dom: Column, container_class: str | None = None, body_only: bool = True) -> Column:
    """Table rows; with ``body_only`` those in a ``tbody``, optionally in one container."""

    def rows(test) -> Column:
        return find_all(dom, lambda e: (e["tag"] == "tr") & test(e))

    def in_body_of(containers: Column) -> Column:
        return rows(
            lambda e: F.exists(
                containers,
                lambda c: (c["pos"] < e["pos"])
                & (e["pos"] < c["peer"])
                & (e["bodies"] > c["bodies"]),
            )
        )

    if not body_only:
        return rows(lambda e: F.lit(True))
    if container_class is None:
        return rows(lambda e: e["bodies"] > 0)
    return let(find_all(dom, lambda e: has_class(e, container_class)), in_body_of)


def numbered_row_links(
    dom: Column,
    rows: Column,
    number_class: str | None = None,
    pinned_icon_class: str | None = None,
    title_class: str | None = None,
    title_in_second_cell: bool = False,
    with_title: bool = False,
    title_text_class: str | None = None,
) -> Column:
    """Links of the rows whose number cell holds digits only, which leaves out pinned rows.

    The number cell is the first one, or the first with ``number_class``; the link is the
    first one in the row, or in the cell with ``title_class``.
    """

    def titled(entries: Column) -> Column:
        own = shown_text(entries)
        if title_text_class is None:
            return own
        part = find(entries, lambda e: (e["tag"] == "div") & has_class(e, title_text_class))
        return let(part, lambda p: F.when(p.isNull(), own).otherwise(text_of(entries_dom, p)))

    entries_dom = dom

    def from_anchor(number: Column, anchor: Column) -> Column:
        title = titled(inside(dom, anchor)) if with_title else None
        return F.when(anchor.isNotNull(), link(number, attr(anchor, "href"), title))

    def from_cells(row: Column, cells: Column) -> Column:
        if number_class is None:
            number_cell = F.get(cells, 0)
        else:
            number_cell = find(cells, lambda e: has_class(e, number_class))
        if title_class is None:
            scope = row
        else:
            scope = find(cells, lambda e: has_class(e, title_class))
            if title_in_second_cell:
                scope = F.coalesce(scope, F.get(cells, 1))

        def from_number(content: Column) -> Column:
            usable = F.lit(True)
            if pinned_icon_class is not None:
                usable = ~F.exists(
                    content, lambda e: is_element(e, "i") & has_class(e, pinned_icon_class)
                )
            return let(
                shown_text(content),
                lambda number: F.when(
                    usable & is_digits(number),
                    let(
                        let(scope, lambda s: _anchor(inside(dom, s))),
                        lambda a: from_anchor(number, a),
                    ),
                ),
            )

        return let(number_cell, lambda n: let(inside(dom, n), from_number))

    def from_row(row: Column) -> Column:
        return let(
            find_all(inside(dom, row), lambda e: e["tag"] == "td"),
            lambda cells: from_cells(row, cells),
        )

    return _present(F.transform(rows, from_row))


def title_cell_links(dom: Column, *cell_classes: str) -> Column:
    """Links of title cells; the number is in the cell before, empty unless all digits.

    The first of ``cell_classes`` that occurs on the page is used.
    """

    def from_cell(cell: Column) -> Column:
        before = F.slice(dom, cell["parent"] + 2, cell["pos"] - cell["parent"] - 1)
        siblings = find_all(
            before, lambda e: (e["tag"] == "td") & (e["parent"] == cell["parent"])
        )
        number = let(
            F.get(F.reverse(siblings), 0), lambda s: F.coalesce(text_of(dom, s), F.lit(""))
        )
        return let(
            _anchor(inside(dom, cell)),
            lambda a: F.when(
                a.isNotNull(),
                link(
                    let(number, lambda n: F.when(is_digits(n), n).otherwise(F.lit(""))),
                    attr(a, "href"),
                    text_of(dom, a),
                ),
            ),
        )

    def cells_of(name: str) -> Column:
        return find_all(dom, lambda e: (e["tag"] == "td") & has_class(e, name))

    cells = cells_of(cell_classes[-1])
    for name in reversed(cell_classes[:-1]):
        cells = _or_else(cells_of(name), cells)
    return _present(F.transform(cells, from_cell))


def item_links(dom: Column, item_class: str, list_class: str, href_parts) -> Column:
    """First link of each item box whose target contains one of ``href_parts``.

    Without item boxes the items of a list with ``list_class`` are used, and without those
    the table rows. The number comes from the URL later.
    """

    def from_item(item: Column) -> Column:
        return let(
            _anchor(inside(dom, item)),
            lambda a: F.when(a.isNotNull(), link(F.lit(None).cast("string"), attr(a, "href"))),
        )

    def listed(lists: Column) -> Column:
        return find_all(
            dom,
            lambda e: (e["tag"] == "li")
            & F.exists(lists, lambda o: (o["pos"] < e["pos"]) & (e["pos"] < o["peer"])),
        )

    items = _or_else(
        find_all(dom, lambda e: (e["tag"] == "div") & has_class(e, item_class)),
        _or_else(let(find_all(dom, lambda e: has_class(e, list_class)), listed), rows_of(dom)),
    )

    def wanted(x: Column) -> Column:
        test = F.lit(False)
        for part in href_parts:
            test = test | x["href"].contains(part)
        return test

    return F.filter(_present(F.transform(items, from_item)), wanted)


def box_links(
    dom: Column,
    box_class: str,
    category_class: str,
    content_class: str,
    default_category: str,
    skipped_title: str,
    per_box: int,
) -> Column:
    """The first ``per_box`` titled links of every category box, numbered over the page."""

    def from_box(box: Column) -> Column:
        content = inside(dom, box)
        category = let(
            find(content, lambda e: (e["tag"] == "span") & has_class(e, category_class)),
            lambda s: F.coalesce(text_of(dom, s), F.lit(default_category)),
        )
        anchors = let(
            find(content, lambda e: (e["tag"] == "div") & has_class(e, content_class)),
            lambda c: F.coalesce(
                find_all(inside(dom, c), lambda e: e["tag"] == "a"), F.slice(dom, 1, 0)
            ),
        )
        none = F.lit(None).cast("string")
        found = _present(F.transform(anchors, lambda a: link(none, attr(a, "href"), text_of(dom, a))))
        titled = F.filter(
            found, lambda x: (x["title"] != "") & (F.lower(x["title"]) != skipped_title)
        )
        return let(
            category,
            lambda c: F.transform(
                F.slice(titled, 1, per_box),
                lambda x: x.withField(
                    "title", F.concat(F.lit("["), c, F.lit("] "), x["title"])
                ),
            ),
        )

    boxes = find_all(dom, lambda e: (e["tag"] == "div") & has_class(e, box_class))
    return F.transform(
        F.flatten(F.transform(boxes, from_box)),
        lambda x, i: x.withField("no", (i + 1).cast("string")),
    )


def anchor_links(dom: Column, container_tag: str) -> Column:
    """All links inside the first ``container_tag``; the key comes from the URL."""

    def from_container(box: Column) -> Column:
        anchors = find_all(inside(dom, box), lambda e: e["tag"] == "a")
        return _present(
            F.transform(anchors, lambda a: link(F.lit(""), attr(a, "href"), text_of(dom, a)))
        )

    return let(find(dom, lambda e: e["tag"] == container_tag), from_container)


def first_by_url(links: Column) -> Column:
    """Keep the first link of every URL, in page order.

    Sorting by (url, position) makes equal URLs neighbours, so this is n log n per page and
    needs no shuffle: a page is one row.
    """

    def kept(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda x, i: (i == 0) | (x["url"] != F.get(ordered, i - 1)["url"])
        )

    keyed = F.array_sort(
        F.transform(links, lambda x: F.struct(x["url"].alias("url"), x["pos"].alias("pos"), x.alias("link")))
    )
    by_pos = F.transform(
        let(keyed, kept), lambda x: F.struct(x["pos"].alias("pos"), x["link"].alias("link"))
    )
    return F.transform(F.array_sort(by_pos), lambda x: x["link"])


@lru_cache(maxsize=64)
def _links_column(sites, application: str) -> Column:
    """The link rules of ``sites`` as one expression over a page row.

    Putting it together takes seconds of driver time, so it is kept for the application;
    a ``Column`` belongs to no DataFrame.
    """
    code = F.col("source_code")
    found = per_source(code, {s.code: s.links(F.col("dom")).cast(LINK_TYPE) for s in sites})
    numbered = {s.code: s.link_no for s in sites if s.link_no is not None}

    def resolved(x: Column, i: Column) -> Column:
        return let(
            resolve_url(F.col("url"), x["href"]),
            lambda u: F.struct(
                i.alias("pos"),
                per_source(code, {c: no(u) for c, no in numbered.items()}, x["no"]).alias("no"),
                u.alias("url"),
                x["title"].alias("title"),
            ),
        )

    links = F.transform(found, resolved)
    unique = [s.code for s in sites if s.unique_links]
    if not unique:
        return links
    return let(
        links,
        lambda found_links: F.when(code.isin(*unique), first_by_url(found_links)).otherwise(
            found_links
        ),
    )


def extract_links(trees: DataFrame, sites, with_refused: bool = False) -> DataFrame:
    """One row per link: ``source_code, list_page_id, pos, no, url, title``.

    ``trees`` has ``source_code, page_id, url, dom``. The whole extraction of a page is one
    expression over its row; only the narrow link rows leave it. ``with_refused`` adds a row of
    position -1 with the page's own address for each page the tokenizer refused.
    """
    links = _links_column(tuple(sites), trees.sparkSession.sparkContext.applicationId)
    if with_refused:
        none = F.lit(None).cast("string")
        page = F.struct(
            F.lit(-1).alias("pos"), none.alias("no"), F.col("url").alias("url"), none.alias("title")
        )
        links = F.when(F.col("dom").isNull(), F.array(page)).otherwise(links)
    return trees.select(
        "source_code", F.col("page_id").alias("list_page_id"), F.explode(links).alias("link")
    ).select("source_code", "list_page_id", "link.pos", "link.no", "link.url", "link.title")
