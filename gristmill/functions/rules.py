"""Predicates on hosts, responses and links, as column expressions. Null inputs are stated per rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill import conf


def host_in_scope(host: Column, scope: conf.Scope = conf.Scope()) -> Column:
    """False for null and empty hosts."""
    labels = F.split(host, r"\.")
    ends = F.array_join(F.slice(labels, -2, 2), ".")
    hit = (F.size(labels) >= 3) & (ends == scope.domain) & F.element_at(labels, -3).isin(*scope.units)
    return F.coalesce(F.when(F.size(labels) >= 3, hit), F.lit(False))


def status_ok(status: Column) -> Column:
    """Robots, download errors, oversize and 400 to 599 fail; a null status passes, as all others."""
    return ~F.coalesce(status.isin(601, 608, 700) | status.between(400, 599), F.lit(False))


def is_redirect(status: Column) -> Column:
    return F.coalesce(status.isin(*conf.REDIRECTS), F.lit(False))


def size_ok(content: Column) -> Column:
    """Null content passes."""
    return F.coalesce(F.octet_length(content) <= conf.MAX_BYTES, F.lit(True))


def header(headers: Column, name: str) -> Column:
    """A header by its name in any case; null if missing. Of several, the first."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(hits, F.lit(0))["value"]


def headers_ok(headers: Column) -> Column:
    """An HTML content type, and no integer content length beyond the limit; null headers fail."""
    kind = F.lower(header(headers, "content-type"))
    html = kind.contains("text/html") | kind.contains("application/xhtml+xml")
    length = F.trim(header(headers, "content-length")).try_cast("bigint")
    return F.coalesce(html, F.lit(False)) & F.coalesce(length <= conf.MAX_BYTES, F.lit(True))


def scheme_ok(scheme: Column) -> Column:
    return F.coalesce(scheme.isin("http", "https"), F.lit(False))


def extension_ok(path: Column) -> Column:
    return ~F.coalesce(F.lower(path).rlike(rf"\.(?:{'|'.join(conf.BAD_EXTENSIONS)})$"), F.lit(False))


def looks_like_html(text: Column) -> Column:
    """On decoded content; null and empty fail."""
    return F.coalesce(F.lower(F.substring(text, 1, 8192)).rlike("<html|<body|<!doctype"), F.lit(False))
