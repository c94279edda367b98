"""Normal forms of addresses: https links, page ids, git remotes, joined paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivana.functions.text import replaced

# Names that make a key sensitive.
SENSITIVE = "token|secret|authorization|cookie|password"


def host(name: Column) -> Column:
    """Lower case, without one leading 'www.'."""
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def https(uri: Column) -> Column:
    """struct(host, uri) of an https address without user, password and port; else null."""
    part = lambda p: F.try_parse_url(uri, F.lit(p))
    name, path = host(part("HOST")), F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    rest = F.concat(path, F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit("")), F.coalesce(F.concat(F.lit("#"), part("REF")), F.lit("")))
    fine = (F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & (F.coalesce(part("AUTHORITY"), F.lit("")) == part("HOST"))
    return F.when(fine, F.struct(name.alias("host"), F.concat(F.lit("https://"), name, rest).alias("uri")))


def page_id(uri: Column, scheme: str = "confluence") -> Column:
    """struct(host, id, uri) of a wiki page: digits, scheme://digits, or an https path that ends in pages/digits."""
    bare = F.nullif(F.regexp_extract(uri, rf"^(?:{scheme}://)?(\d+)/?$", 1), F.lit(""))
    link = https(uri)
    path = F.regexp_extract(link["uri"], r"^https://[^/]+([^?#]*)", 1)
    inside = F.nullif(F.regexp_extract(path, r"(?:^|/)(?:pages|wiki/spaces/[^/]+/pages)/(\d+)(?:/|$)", 1), F.lit(""))
    named = F.coalesce(bare, inside)
    return F.when(named.isNotNull(), F.struct(F.when(bare.isNull(), link["host"]).alias("host"), named.alias("id"), F.concat(F.lit(f"{scheme}://"), named).alias("uri")))


def git_remote(uri: Column) -> Column:
    """host/path of a git remote in lower case, whatever its scheme and user; null if it has no path."""
    short = replaced(F.trim(uri), (r"(?i)\.git/?$", ""), (r"(?i)^[a-z][a-z\d+.-]*://", ""), (r"^[^@/]+@", ""), (r"^([^/:]+):", "$1/"), (r"^/+|/+$", ""))
    low = F.lower(short)
    return F.when(low.rlike(r"^[^/]+/.+"), low)


def without_secrets(uri: Column) -> Column:
    """An address without the query parameters whose names are sensitive; other text with its assignments masked."""
    before, query, place = (F.regexp_extract(uri, r"^([^?#]*)(?:\?([^#]*))?(#.*)?$", k) for k in (1, 2, 3))
    kept = F.filter(F.split(query, "&"), lambda p: ~F.regexp_extract(p, "^([^=]*)", 1).rlike(f"(?i){SENSITIVE}"))
    asked = F.array_join(kept, "&")
    cut = F.concat(before, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)), place)
    return F.when(uri.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), cut).otherwise(mask_assignments(uri))


def mask_assignments(text: Column) -> Column:
    """'key: value' of sensitive keys with the value masked."""
    return F.regexp_replace(text, rf"(?i)({SENSITIVE})\s*[:=]\s*[^\s,;&]+", "$1=[REDACTED]")


def joined_path(base: Column, href: Column) -> Column:
    """href below base, without fragment, '.' and '..' worked out."""
    target = F.regexp_extract(href, r"^([^#]*)", 1)
    whole = F.when((F.coalesce(base, F.lit("")) == "") | target.startswith("/"), target).otherwise(F.concat_ws("/", base, target))
    step = lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).when((x == "..") & whole.startswith("/"), a).otherwise(F.concat(a, F.array(x)))
    parts = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(whole.startswith("/"), F.concat(F.lit("/"), parts)).when(parts == "", ".").otherwise(parts)
