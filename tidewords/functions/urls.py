"""What a media URL leads to. Hosts are parsed and compared whole, never searched for in the string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewords.functions.text import slug

# Path heads before a video id, before a channel's name, tabs that list videos, and suffixes of media.
VIDEO_HEADS = ("embed", "shorts", "live")
CHANNEL_HEADS = ("channel", "c", "user")
TABS = ("videos", "streams", "shorts")
ID = "^[A-Za-z0-9_-]{11}$"
MEDIA = (".mp3", ".m4a", ".wav", ".flac", ".ogg", ".opus", ".mp4", ".mkv", ".mov", ".webm", ".aac")


def _host(url: Column) -> Column:
    web = url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(web, F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", ""))


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")


def video_id(url: Column, hosts: list[str], short_hosts: list[str]) -> Column:
    """The video's id of a watch, embed, shorts or live URL on ``hosts``, or a bare one on ``short_hosts``; else null."""
    host, seg = _host(url), _segments(url)
    watch = F.when((F.size(seg) == 1) & (seg[0] == "watch"), F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    headed = F.when((F.size(seg) == 2) & F.get(seg, F.lit(0)).isin(*VIDEO_HEADS), F.get(seg, F.lit(1)))
    short = F.when(host.isin(*short_hosts) & (F.size(seg) == 1), F.get(seg, F.lit(0)))
    found = F.coalesce(short, F.when(host.isin(*hosts), F.coalesce(watch, headed)))
    return F.when(found.rlike(ID), found)


def channel(url: Column, hosts: list[str]) -> Column:
    """Handle or id of a channel page on ``hosts``, with or without a tab that lists videos; else null."""
    seg = _segments(url)
    first, second = F.get(seg, F.lit(0)), F.get(seg, F.lit(1))
    handle = first.startswith("@") & (F.length(first) > 1)
    key = F.when(handle, first).when(first.isin(*CHANNEL_HEADS), second)
    rest = F.size(seg) - F.when(handle, 1).otherwise(2)
    tab = F.get(seg, F.when(handle, 1).otherwise(2))
    good = (rest == 0) | ((rest == 1) & tab.isin(*TABS))
    return F.when(_host(url).isin(*hosts) & good & F.regexp_replace(key, "^@+", "").rlike("^[A-Za-z0-9_.-]+$"), key)


def batch(url: Column, hosts: list[str]) -> Column:
    """Id of a playlist, ``/playlist?list=``, or else the channel; null for single videos."""
    listed = F.when(F.rtrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/")) == "/playlist", F.try_parse_url(url, F.lit("QUERY"), F.lit("list")))
    return F.coalesce(F.when(listed.rlike("^[A-Za-z0-9_-]+$"), listed), channel(url, hosts))


def stem(url: Column) -> Column:
    """A file's stem for a media URL: its last path segment, else its host, else ``media``, as a slug."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))
    return slug(F.coalesce(F.nullif(F.regexp_extract(path, "([^/]*)/*$", 1), F.lit("")), F.nullif(host, F.lit("")), F.lit("media")))


def suffix(path: Column) -> Column:
    """The suffix of a path or URL in lower case, with its point; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"[^/.](\.[A-Za-z0-9]+)$", 1))


def is_media(path: Column) -> Column:
    """Whether a path names audio or video by its suffix."""
    return suffix(path).isin(*MEDIA)
