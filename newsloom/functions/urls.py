"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visits, besides all that begin with utm_.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "zarsrc"]


def normalize_url(url: Column) -> Column:
    """One form for equal pages: lower-case scheme and host (https if none), no trailing slash, no fragment, no tracking or blank parameters, the rest in order."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(trimmed, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    tail = F.regexp_replace(rest, r"^//[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), "/+$", "")
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(tail, r"\?(.*)$", 1), "&"), lambda p: p.rlike("=.")),
        lambda p: F.struct(F.url_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("name"), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).startswith("utm_") & ~F.lower(p["name"]).isin(TRACKING)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    whole = F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
    return F.when(trimmed == "", F.lit("")).otherwise(whole)


def category_path(url: Column) -> Column:
    """The first part of the path, without an ending such as .html."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z]+:)?//[^/]+/([^/?#]+)", 1), r"\.[A-Za-z]+$", "")
