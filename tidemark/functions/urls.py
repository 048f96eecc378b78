"""URL normal forms and the timestamps that URLs carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""))


def _path(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def normalize_url(url: Column) -> Column:
    """scheme://host:port/path?query in lower case up to the host, without www., fragment and closing slashes."""
    url = F.coalesce(url, F.lit(""))
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    return F.when(F.trim(url) == "", "").otherwise(
        F.concat(scheme, F.lit("://"), F.regexp_replace(_host(url), r"^www\.", ""), _path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    )


def url_key(url: Column) -> Column:
    """host and path alone."""
    url = F.coalesce(url, F.lit(""))
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(F.regexp_replace(_host(url), r"^www\.", ""), path)


def timestamp_of(url: Column) -> Column:
    """From an archive's 14 digits, /year/month/day/, year-month-day or eight digits, the first that is there."""
    url = F.coalesce(url, F.lit(""))
    month, day = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
    archive = F.regexp_extract(url, r"/web/(\d{14})/", 1)
    dates = []
    for pattern in (rf"/(20\d{{2}})/{month}/{day}/", rf"(20\d{{2}})-{month}-{day}", rf"(20\d{{2}}){month}{day}"):
        y, m, d = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
        dates.append(F.when(y != "", F.concat_ws("-", y, m, d)))
    return F.when(archive != "", F.try_to_timestamp(archive, F.lit("yyyyMMddHHmmss"))).otherwise(F.try_to_timestamp(F.coalesce(*dates), F.lit("yyyy-MM-dd")))
