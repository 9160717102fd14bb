"""URL functions as column expressions: validity, split, canonical forms, path patterns, hash.

``normalized(url)`` gives a struct; for a null or invalid URL its fields are null and
``bucket_keys`` is an empty array. All of it runs inside the JVM.

A URL is valid here if it has an http, https, ftp or ftps scheme, a host of dotted labels
(letters of any script, digits, hyphens, underscores) with an alphabetic last label, an IPv4
address or ``localhost``, an optional port, and no white space. Paths may hold any other sign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import conf

VALID = (
    r"(?i)^(?:https?|ftps?)://(?:[^\s/?#@]+@)?(?:(?:[\p{L}\p{N}](?:[\p{L}\p{N}_-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,63}"
    r"|\d{1,3}(?:\.\d{1,3}){3}|localhost)(?::\d{1,5})?(?:[/?#]\S*)?$"
)
#: The generic syntax of RFC 3986, appendix B.
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Fixed values that must match: forms of dates and of directory sorts, length of a large segment.
DATE = (
    r"\d{4}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])[-/.]\d{2,4}"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.]\d{2,4}|\d{8}"
)
YEAR_MONTH = r"\d{4}[-/.](?:0?[1-9]|1[0-2])"
LARGE = 128
DIRECTORY_SORT = r"^[A-Za-z](?:;[CO]=[A-Za-z])*$"


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID), F.lit(False))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Host with ``www.``: cut at the first colon, in lower case, without trailing slashes."""
    return F.regexp_replace(F.lower(F.substring_index(part(url, 2), ":", 1)), "/+$", "")


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def dedup_path(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))


def _decoded(x: Column) -> Column:
    """Escapes are decoded one by one; a percent sign that begins none stands for itself."""
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking(key: Column, keys: Sequence[str] | None = None) -> Column:
    """Whether a query key is dropped: exact matches of ``keys``, by default those of the settings."""
    return key.isin(list(conf.TRACKING_KEYS if keys is None else keys))


def clean_query(query: Column, tracking: Sequence[str] | None = None) -> Column:
    """Decoded pairs without blank values and tracking keys, sorted, encoded again; a directory
    sort is emptied."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.")),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")
        ),
    )
    kept = F.filter(pairs, lambda p: ~is_tracking(p["k"], tracking))
    sort = F.forall(kept, lambda p: p["k"].isin("C", "O") & p["v"].rlike(DIRECTORY_SORT))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(query == "", "").when(sort, "").otherwise(text)


def path_pattern(path: Column) -> Column:
    """The shape of a path: variable segments give way to their class.

    Per segment, in order: numerals {NUMBER}, a date {DATE}, a year and month {YEAR_MONTH}, 128
    characters or more {LARGE}, ``a:b:c`` its name spaces and {PAGE}, a last segment with a dot
    {FILE}, else the segment in lower case. Trailing slashes go, so the root is the empty pattern.
    """
    items = F.split(path, "/", -1)
    leaf = F.array_max(F.transform(items, lambda x, i: F.when(x != "", i).otherwise(-1)))
    pieces = F.transform(
        items,
        lambda x, i: F.when(x == "", "/")
        .when(x.rlike(r"^\p{N}+$"), "{NUMBER}/")
        .when(x.rlike(f"^(?:{DATE})$"), "{DATE}/")
        .when(x.rlike(f"^{YEAR_MONTH}$"), "{YEAR_MONTH}/")
        .when(F.length(x) >= LARGE, "{LARGE}/")
        .when(x.contains(":"), F.concat(F.lower(F.replace(F.regexp_replace(x, ":[^:]*$", ""), F.lit(":"), F.lit("/"))), F.lit("/{PAGE}/")))
        .when((i == leaf) & x.contains("."), "{FILE}/")
        .otherwise(F.concat(F.lower(x), F.lit("/"))),
    )
    return F.regexp_replace(F.array_join(pieces, ""), "/+$", "")


def normalized(url: Column, tracking: Sequence[str] | None = None) -> Column:
    """struct<fetch_url, dedup_key, bucket_keys, scheme, netloc, path, query>."""
    parts = F.struct(
        is_valid(url).alias("ok"), scheme(url).alias("scheme"), host(url).alias("host"), part(url, 3).alias("path"), clean_query(part(url, 4), tracking).alias("query")
    )

    def build(p: Column) -> Column:
        ok, name = p["ok"], p["host"]
        tail = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
        return F.struct(
            F.when(ok, F.concat(p["scheme"], F.lit("://"), name, p["path"], tail)).alias("fetch_url"),
            F.when(ok, F.concat(F.lit("http://"), without_www(name), dedup_path(p["path"]), tail)).alias("dedup_key"),
            F.when(ok, F.array(path_pattern(p["path"]))).otherwise(F.array().cast("array<string>")).alias("bucket_keys"),
            F.when(ok, p["scheme"]).alias("scheme"),
            F.when(ok, without_www(name)).alias("netloc"),
            F.when(ok, p["path"]).alias("path"),
            F.when(ok, p["query"]).alias("query"),
        )

    # The parts are bound by a lambda, so each is computed once however often it is used.
    return F.get(F.transform(F.array(parts), build), F.lit(0))


def path_without_params(url: Column) -> Column:
    """Path as a parser sees it that splits ``;parameters`` off the last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def url_hash(url: Column) -> Column:
    """SHA-256 of everything but the scheme, by which the frontier knows a URL."""
    params = F.regexp_extract(part(url, 3), ";([^/]*)$", 1)
    return F.sha2(F.concat_ws("/", part(url, 2), path_without_params(url), params, part(url, 4), part(url, 5)), 256)
