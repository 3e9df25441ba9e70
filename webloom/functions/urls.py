"""URL columns: parsing, canonical form, resolution, domains and keys.

Parsing is by pattern instead of parse_url, because link targets found in pages often hold characters that a strict
URI parser refuses (blanks, bars, braces). Malformed input gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.arrays import let

# Fixed values.
HTTP_SCHEMES = ("http", "https")
TRACKING_PREFIX = "utm_"
SESSION_MARK = "session"
DEFAULT_PORT = "80"

# Groups: scheme, host, port, path, query. User-info and fragment are matched but not captured.
URL = (
    r"(?s)^(\w+)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)


def url_parts(url: Column) -> Column:
    """struct(scheme, host, port, path, query); scheme and host lower-cased, scheme '' when malformed."""
    url = F.trim(url)
    return F.struct(
        F.lower(F.regexp_extract(url, URL, 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, URL, 2)).alias("host"),
        F.regexp_extract(url, URL, 3).alias("port"),
        F.regexp_extract(url, URL, 4).alias("path"),
        F.regexp_extract(url, URL, 5).alias("query"),
    )


def with_default_scheme(url: Column) -> Column:
    # Fixed value: what counts as a scheme.
    return F.when(url.rlike(r"^\w+://.+"), url).otherwise(F.concat(F.lit("http://"), url))


def percent_encode(value: Column) -> Column:
    """RFC 3986 escapes: blank as %20, asterisk escaped, tilde kept."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """Sorted, re-encoded query string without tracking and session keys; NULL for a bad percent escape."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decoded = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )

    def last_per_key(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i + 1)["k"] != x["k"], F.lit(True))
            & ~F.startswith(x["k"], F.lit(TRACKING_PREFIX))
            & ~F.contains(x["k"], F.lit(SESSION_MARK)),
        )

    def encoded(kept: Column) -> Column:
        return F.array_join(
            F.transform(kept, lambda x: F.concat(percent_encode(x["k"]), F.lit("="), percent_encode(x["v"]))), "&"
        )

    return let(
        decoded,
        lambda d: F.when(
            ~F.exists(d, lambda x: x["k"].isNull() | x["v"].isNull()),
            encoded(let(F.array_sort(d), last_per_key)),
        ),
    )


def canonical_from_parts(p: Column) -> Column:
    query = F.when(p["query"] == "", F.lit("")).otherwise(
        let(
            canonical_query(p["query"]),
            lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
        )
    )
    port = F.when(p["port"].isin("", DEFAULT_PORT), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    host = F.regexp_replace(p["host"], r"^www\.", "")
    return F.when(
        p["scheme"].isin(*HTTP_SCHEMES) & (host != ""),
        F.concat(p["scheme"], F.lit("://"), host, port, F.regexp_replace(p["path"], "/$", ""), query),
    )


def canonical_url(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL, NULL if malformed, host-less or of another scheme."""
    return let(url_parts(url), canonical_from_parts)


def host_of(url: Column) -> Column:
    """Host of an absolute URL, NULL when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, URL, 2)), F.lit(""))


def domain_of_host(host: Column) -> Column:
    """Last two labels of a host; NULL for a host without a dot between two of them."""
    last = F.substring_index(host, ".", -2)
    return F.when(last.rlike(r"^[^.]+\.[^.]+$"), last)


def domain_of(url: Column) -> Column:
    return domain_of_host(host_of(url))


def site_key(link: Column) -> Column:
    """A link without its protocol: the key of a source page."""
    return F.regexp_replace(link, "^https?://", "")


def anchor_key(link: Column) -> Column:
    """A link target without protocol and leading www."""
    return F.regexp_replace(site_key(link), r"^www\.", "")


def site_id(link: Column) -> Column:
    return F.sha2(site_key(link), 256)


def url_key(link: Column) -> Column:
    """Key in the visited set: md5 of the canonical URL, as hex."""
    return F.md5(link)


def _without_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of a path; '..' above the root is dropped."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.concat(done, F.array(segment)))
        )

    def fold(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        root = F.array(F.lit(""))
        return F.array_join(F.concat(F.aggregate(F.slice(segments, 2, F.size(segments)), root, step), tail), "/")

    return F.when(path.rlike(r"/\.\.?(/|$)"), let(F.split(path, "/"), fold)).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute URL of `href` found on the page `base` (a canonical link).

    A target with a scheme of its own is returned unchanged, so callers can refuse schemes other than http(s).
    """
    absolute = r"(?s)^(\w+://[^/?#]*)([^?#]*)(.*)$"

    def normalised(url: Column) -> Column:
        path = F.regexp_extract(url, absolute, 2)
        clean = F.concat(F.regexp_extract(url, absolute, 1), _without_dots(path), F.regexp_extract(url, absolute, 3))
        return F.when(F.contains(url, F.lit("/.")) & is_http(url), clean).otherwise(url)

    def joined(h: Column) -> Column:
        origin = F.regexp_extract(base, absolute, 1)
        path = F.regexp_extract(base, absolute, 2)
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), h))
            .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
            .when(F.startswith(h, F.lit("?")), F.concat(origin, path, h))
            .when((h == "") | F.startswith(h, F.lit("#")), base)
            .otherwise(F.concat(origin, F.regexp_replace(path, "/?[^/]*$", ""), F.lit("/"), h))
        )

    return let(let(F.trim(href), joined), normalised)


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")
