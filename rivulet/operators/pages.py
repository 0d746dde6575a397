"""Field extraction from stored web pages and event records.

The original collectors parsed each fetched page in Python; here the pages
are a table and every rule is a built-in expression over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.scalars import (LEVEL_MARKERS, epoch_seconds, extract_or_default, first_match_class,
                                       format_epoch, json_field, strip_prefix, strip_tags)

# Fixed patterns of the page rules.
TITLE_RE = r"<title>(.*?)</title>"
LANG_RE = r'<html lang="(.*?)"'
NUMBER_RE = r"/([0-9]+)"
HOST_RE = r"https?://[^/]+"
SECTIONS = ["/en/", "/fr/", "/de/", "/es/"]


def page_fields(pages: DataFrame, marker: str = "<title>", sections: list[str] | None = None) -> DataFrame:
    """(page_id, title, lang, section, path, number, level) for pages that
    contain ``marker`` (others are skipped, P12).  Missing fields get the
    default text; ``section`` is the index of the first url marker that
    matches (else -1); ``level`` the first of lv0..lv6 found in the page."""
    sections = sections or SECTIONS
    p = pages.where(F.col("html").contains(marker))
    return p.select(
        "page_id",
        strip_tags(extract_or_default("html", TITLE_RE)).alias("title"),
        extract_or_default("html", LANG_RE).alias("lang"),
        first_match_class("url", sections).alias("section"),
        strip_prefix("url", HOST_RE).alias("path"),
        extract_or_default("url", NUMBER_RE).alias("number"),
        first_match_class("html", LEVEL_MARKERS).alias("level"))


def event_fields(events: DataFrame, path: str = "$.k", default: str = "0") -> DataFrame:
    """(event_id, k, epoch, ts_text): a JSON field with a default
    and the event time as epoch seconds and as 'YYYY-MM-DD HH:MM:SS' (F7)."""
    ep = epoch_seconds("ts")
    return events.select("event_id", F.coalesce(json_field("props", path), F.lit(default)).alias("k"),
                         ep.alias("epoch"), format_epoch(ep).alias("ts_text"))
