"""URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query parameters that don't change what a URL names. Fixed values.
TRACKING = r"^(?:utm_[^=]*|ref|gclid|fbclid|sessionid)(?:=.*)?$"


def _bare(url: Column) -> Column:
    """Without fragment and scheme."""
    return F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")


def host(url: Column) -> Column:
    """Lower-case host without user, default port and final dots; null URL: null."""
    authority = F.regexp_extract(_bare(url), r"^(?:[^/?]*@)?([^/?]*)", 1)
    return F.regexp_replace(F.lower(authority), r"(?::(?:80|443))?\.*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(_bare(url), r"(?s)^[^/?]*([^?]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without final slashes, and sorted query parameters without tracking ones."""
    query = F.regexp_extract(_bare(url), r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("(?s)" + TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
