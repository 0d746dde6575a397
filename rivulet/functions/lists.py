"""Codecs between delimited id lists ("1; 5; 9") and long rows.

Long rows ``(key, pos, value)`` are the canonical in-memory form; the wide
string only exists at the edges (input files, reports).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace stripped by Python's str.strip() for ASCII input; written as an
# explicit class so Spark (Java regex) and DuckDB (RE2) agree.
WS = r"[ \t\n\r\f\x0B]"


def strip_ws(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def split_list(c: Column | str, sep: str = ";") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.split(c, re.escape(sep))


def wide_to_long(df: DataFrame, key: str, list_col: str, sep: str = ";",
                 drop_blank: bool = True, out_col: str | None = None,
                 pos_col: str | None = None) -> DataFrame:
    """Split ``list_col`` on ``sep``, one row per token, whitespace stripped.

    ``drop_blank=True`` removes empty tokens (the user-CF reader); ``False``
    keeps them as '' (the popularity and factor-model readers).  A null list
    yields no rows.  ``pos_col`` keeps the 0-based token position.
    """
    out_col = out_col or list_col
    tokens = split_list(list_col, sep)
    if pos_col:
        exploded = df.select(key, F.posexplode(tokens).alias(pos_col, "_tok"))
    else:
        exploded = df.select(key, F.explode(tokens).alias("_tok"))
    exploded = exploded.withColumn(out_col, strip_ws("_tok")).drop("_tok")
    if drop_blank:
        exploded = exploded.where(F.col(out_col) != "")
    cols = [key] + ([pos_col] if pos_col else []) + [out_col]
    return exploded.select(*cols)


def ordered_join(order_cols: list[str], value_col: str, sep: str) -> Column:
    """Aggregate expression: values joined by ``sep`` in the order of ``order_cols``.

    ``collect_list`` order is not defined, so the order travels inside a struct
    and the array is sorted before the values are joined.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order_cols, F.col(value_col).cast("string").alias("_v"))))
    return F.concat_ws(sep, F.transform(packed, lambda x: x["_v"]))


def long_to_wide(df: DataFrame, key: str, value_col: str, order_cols: list[str] | None = None,
                 sep: str = "; ", out_col: str | None = None, max_items: int | None = None) -> DataFrame:
    """One row per ``key`` with its values joined in the given order.

    ``max_items`` bounds the size of one output row: a key with more values
    gets several rows (``part`` 0, 1, ...) of at most ``max_items`` values
    each, in order, so no single group is ever gathered whole.  Keys within
    the bound get exactly one row, ``part`` 0."""
    order_cols = order_cols or [value_col]
    out_col = out_col or value_col
    if max_items is None:
        return df.groupBy(key).agg(ordered_join(order_cols, value_col, sep).alias(out_col))
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(*order_cols)
    parts = df.withColumn("part", F.floor((F.row_number().over(w) - 1) / F.lit(max_items)).cast("int"))
    return parts.groupBy(key, "part").agg(ordered_join(order_cols, value_col, sep).alias(out_col))


def numeric_tokens(c: Column | str, sep: str = ";") -> Column:
    """Array of the tokens that are all digits after stripping, cast to bigint,
    order and duplicates kept (positions count only the kept tokens)."""
    stripped = F.transform(split_list(c, sep), lambda t: strip_ws(t))
    kept = F.filter(stripped, lambda t: t.rlike("^[0-9]+$"))
    return F.transform(kept, lambda t: t.try_cast("bigint"))


def count_splits(c: Column | str, sep: str = ";") -> Column:
    """Number of non-blank tokens; a null list counts 0."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.size(F.filter(split_list(c, sep), lambda t: strip_ws(t) != ""))
    return F.when(c.isNull(), F.lit(0)).otherwise(n)
