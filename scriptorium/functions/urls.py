"""Addresses: tests, parts, identifiers of embedded players."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_web(url: Column, credentials: bool = True) -> Column:
    """An http(s) address with a host; credentials: whether a user before the host is let through."""
    ok = url.rlike(r"(?i)^https?://[^\s/?#]+")
    has_user = url.rlike(r"(?i)^https?://[^/?#]*@")
    return F.coalesce(ok if credentials else ok & ~has_user, F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def in_sitemap(url: Column) -> Column:
    """Pages only: no search page, no data files."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    return ~bare.rlike(r"/search$") & ~F.lower(bare).rlike(r"\.(json|md|txt|xml)$")


def player_id(url: Column) -> Column:
    """The video id of a player address by the rules of ingestion: thumbnails, short links, v=, embed, live and shorts paths."""
    site = F.regexp_replace(host(url), "^www\\.", "")
    ident = "([A-Za-z0-9_-]{6,})"
    found = F.when(site.rlike(r"(^|\.)ytimg\.com$"), F.regexp_extract(path(url), f"^/vi(?:_webp)?/{ident}", 1)).when(site == "youtu.be", F.regexp_extract(path(url), f"^/{ident}", 1))
    own = F.coalesce(F.nullif(F.regexp_extract(url, rf"[?&]v={ident}", 1), F.lit("")), F.regexp_extract(path(url), f"^/(?:embed|live|shorts)/{ident}", 1))
    return F.nullif(found.when(site.isin("youtube.com", "youtube-nocookie.com", "m.youtube.com"), own), F.lit(""))
