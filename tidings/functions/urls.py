"""URL functions: noise removal, natural key, resolution of relative links, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import let

# Query keys starting with one of these carry no identity.
NOISE_PREFIXES = ("utm_", "fbclid", "gclid", "session", "sid", "from", "ref")

# Query keys that carry the number of a post, in order of preference.
KEY_PARAMETERS = ("articleNo", "article_no", "no", "id", "idx")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _lower_scheme(url: Column) -> Column:
    """Schemes are case-insensitive; write them in lower case."""
    scheme = F.regexp_extract(url, _SCHEME, 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*", "")
    return F.when(
        url.rlike(r"^[A-Za-z0-9+.-]*[A-Z][A-Za-z0-9+.-]*:"), F.concat(F.lower(scheme), rest)
    ).otherwise(url)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def _path(url: Column) -> Column:
    """Path of a URL, without authority and without parameters of the last segment."""
    return F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _decode(part: Column) -> Column:
    return F.when(
        part.rlike("[%+]"),
        F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" "))),
    ).otherwise(part)


def query_pairs(url: Column) -> Column:
    """Query parameters as ``array<struct<k,v>>``, decoded, in order, blank values left out."""
    pairs = F.transform(
        F.split(_query(url), "&"),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: p["v"] != "")


def first_value(pairs: Column, key: str) -> Column:
    """First value of ``key`` in the result of ``query_pairs``, else null."""
    return F.get(F.filter(pairs, lambda p: p["k"] == key), 0)["v"]


def key_from_query(url: Column, keys=KEY_PARAMETERS) -> Column:
    """Value of the first of ``keys`` that has one, else null."""
    return let(query_pairs(url), lambda q: F.coalesce(*[first_value(q, k) for k in keys]))


def url_normalized(url: Column) -> Column:
    """URL without noise parameters, blank values, repeated keys and fragment; keys sorted.

    Values stay decoded. Noise is a prefix test on the lower-case key.
    """

    def kept(pair: Column) -> Column:
        key = F.lower(pair["k"])
        noisy = F.lit(False)
        for prefix in NOISE_PREFIXES:
            noisy = noisy | key.startswith(prefix)
        return ~noisy

    def rebuilt(pairs: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
        return F.array_join(
            F.transform(
                keys,
                lambda k: F.concat(
                    k, F.lit("="), F.get(F.filter(pairs, lambda p: p["k"] == k), 0)["v"]
                ),
            ),
            "&",
        )

    base = _lower_scheme(F.regexp_replace(url, r"(?s)[?#].*$", ""))
    query = let(F.filter(query_pairs(url), kept), rebuilt)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def url_path_only(url: Column) -> Column:
    """URL without query, fragment and parameters of the last path segment."""
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    return _lower_scheme(F.regexp_replace(bare, r"(?s);[^/]*$", ""))


def external_id(url: Column) -> Column:
    """Natural key of a post from its URL.

    A key parameter if there is one, else the last path segment when it is alphanumeric,
    else the first 32 hex digits of the SHA-256 of the URL without query.
    """
    url = F.coalesce(url, F.lit(""))
    path = F.regexp_replace(_path(url), r"(?s);[^/]*$", "")
    segment = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    hashed = F.substring(F.sha2(url_path_only(url), 256), 1, 32)
    from_path = F.when(segment.rlike(r"^[\p{L}\p{N}]+$"), segment).otherwise(hashed)
    from_query = F.when(url.contains("?"), key_from_query(url))
    return F.coalesce(from_query, from_path)


def notice_key(number: Column, url: Column) -> Column:
    """List number when present, else the key from the URL."""
    return F.coalesce(F.nullif(number, F.lit("")), external_id(url))


def _without_dot_segments(path: Column, merge_slashes: bool) -> Column:
    """Resolve ``.`` and ``..`` of an absolute path, optionally dropping empty inner segments."""

    def resolved(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        inner = F.filter(
            segments,
            lambda s, i: F.lit(not merge_slashes)
            | (s != "")
            | (i == 0)
            | (i == F.size(segments) - 1),
        )
        walked = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == ".", done)
            .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, s)),
        )
        ended = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
        joined = F.array_join(ended, "/")
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    needs_work = path.rlike(r"(^|/)\.{1,2}(/|$)|//")
    return F.when(needs_work, let(F.split(path, "/"), resolved)).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` found on the page ``base``."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)", 1)
    base_path = _path(base)
    folder = F.regexp_replace(base_path, r"(?s)[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href_path = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(
            href.startswith("/"),
            F.concat(origin, _without_dot_segments(href_path, False), href_rest),
        )
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href))
        .otherwise(
            F.concat(origin, _without_dot_segments(F.concat(folder, href_path), True), href_rest)
        )
    )


def on_origin(page_url: Column, path: Column) -> Column:
    """Root-relative ``path`` put on the scheme and host of ``page_url``, otherwise unchanged."""
    return F.concat(F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), path)


def base_name(url: Column) -> Column:
    """Text after the last slash, query left out."""
    return F.element_at(F.split(F.substring_index(url, "?", 1), "/"), -1)


def file_name(url: Column, default: Column) -> Column:
    """Base name of a URL, or ``default`` when it has no dot."""
    name = base_name(url)
    return F.when(name.contains("."), name).otherwise(default)


def quote_path(url: Column) -> Column:
    """Percent-encode the path of a URL, leaving ``/`` and unreserved characters."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?|//[^/?#]*)", 1)
    full = F.regexp_extract(url, r"(?s)^[^?#]*", 0)
    path = F.substring(full, F.length(head) + 1, F.length(full))
    params = F.regexp_extract(path, r"(?s)(;[^/]*)$", 1)
    bare = F.substring(path, F.lit(1), F.length(path) - F.length(params))
    rest = F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    quoted = F.url_encode(bare)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(form), F.lit(plain))
    return F.concat(head, quoted, params, rest)
