"""The site of a URL: its host in lower case, without port and one leading ``www.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme and host of an absolute http(s) URL; user info and port are not part of the host.
_HOST = r"(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)"


def site(url: Column) -> Column:
    """Null for a null URL or one without an http(s) host."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


SITE_SQL = (
    "nullif(regexp_replace(lower(regexp_extract({0}, '^[hH][tT][tT][pP][sS]?://(?:[^/?#@\\s]*@)?([^/?#:@\\s]+)', 1)),"
    " '^www\\.', ''), '')"
)
