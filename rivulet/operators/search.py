"""Stored search-result pages to item rows (C18): a nested list of records with defaults.

A page is a JSON answer {"data": {"result": [record, ...]}}.  A page counts as
a whole: if the request failed, the text is no such JSON, there is no list, or a
record lacks a field that has no default, none of its rows are taken and the
page is returned by ``search_rejects`` with the reason.  All of it is built-in
expressions: one parse of each text, an explode, and a look at the record's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.scalars import format_epoch, strip_tags

# The fields of a record that a row needs, and those that are 0 where they are missing.
REQUIRED = ["title", "author", "bvid", "pubdate", "duration", "play", "favorites", "typename", "tag", "description"]
ZERO_IF_MISSING = ["video_review", "like"]
OK_STATUS = 200
_SCHEMA = "data struct<result: array<map<string, string>>>, broken string"


def parsed_pages(pages: DataFrame, body_col: str = "body", status_col: str | None = "status", required: list[str] | None = None) -> DataFrame:
    """``pages`` with ``records`` (array of maps from field to text) and ``reason`` (null if the page counts).

    Reasons: 'status' (not 200, or null), 'malformed' (no JSON object, or a
    list or record of another shape), 'no result' (the list is missing or
    null), 'record' (a record is null or lacks a field).  A field whose value
    is null is there."""
    needed = F.array(*[F.lit(c) for c in required or REQUIRED])
    answer = F.from_json(F.col(body_col), _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    out = pages.withColumn("answer", answer).withColumn("records", F.col("answer.data.result"))
    lacking = F.exists("records", lambda r: r.isNull() | (F.size(F.array_except(needed, F.map_keys(r))) > 0))
    failed = F.lit(False) if status_col is None else F.coalesce(F.col(status_col) != OK_STATUS, F.lit(True))
    reason = (F.when(failed, "status").when(F.coalesce(F.trim(body_col), F.lit("")).eqNullSafe("") | F.col("answer.broken").isNotNull(), "malformed")
              .when(F.col("records").isNull(), "no result").when(lacking, "record"))
    return out.withColumn("reason", reason).drop("answer")


def _number(c: Column) -> Column:
    return c.try_cast("long")


def search_items(pages: DataFrame, page_col: str = "page_id", body_col: str = "body", status_col: str | None = "status") -> DataFrame:
    """One row a record of the pages that count: page, pos (from 1), title without tags, author, bvid, uploaded
    ('YYYY-MM-DD HH:MM:SS'), duration, danmaku and likes (0 if missing), plays, favourites, category, tags, description.

    Numbers that are no whole numbers are null.  Pages with an empty list, null
    bodies and empty tables give no rows; a repeated page gives its rows again."""
    good = parsed_pages(pages.select(page_col, body_col, *([status_col] if status_col else [])), body_col, status_col).where("reason IS NULL")
    rows = good.select(page_col, F.posexplode("records").alias("pos", "r"))

    def zero_if_missing(name: str) -> Column:
        return F.when(F.map_contains_key("r", name), _number(F.col("r")[name])).otherwise(F.lit(0).cast("long"))

    r = F.col("r")
    return rows.select(
        page_col, (F.col("pos") + 1).cast("int").alias("pos"), strip_tags(r["title"]).alias("title"), r["author"].alias("author"), r["bvid"].alias("bvid"),
        format_epoch(_number(r["pubdate"])).alias("uploaded"), r["duration"].alias("duration"), zero_if_missing("video_review").alias("danmaku"),
        zero_if_missing("like").alias("likes"), _number(r["play"]).alias("plays"), _number(r["favorites"]).alias("favourites"),
        r["typename"].alias("category"), r["tag"].alias("tags"), r["description"].alias("description"))


def search_rejects(pages: DataFrame, page_col: str = "page_id", body_col: str = "body", status_col: str | None = "status") -> DataFrame:
    """(page, reason) of every page that does not count."""
    cols = [page_col, body_col, *([status_col] if status_col else [])]
    return parsed_pages(pages.select(*cols), body_col, status_col).where("reason IS NOT NULL").select(page_col, "reason")
