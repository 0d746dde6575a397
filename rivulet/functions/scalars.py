"""Scalar rules as built-in Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original rules.
GENDER_CODES = {"男": "M", "女": "F"}          # male, female
GENDER_FEATURE = {"M": 0, "F": 1}
UNKNOWN_TEXT = "未知"                           # "unknown", default for missing fields
LEVEL_MARKERS = ["lv0", "lv1", "lv2", "lv3", "lv4", "lv5", "lv6"]
HTML_TAG = r"<[^>]+>"
COLD_WATCH = 500


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_duration(c: Column | str) -> Column:
    """'m:s' or 'h:m:s' -> seconds (int); any other shape or a bad part -> null.
    Parts parse like Python int(): surrounding blanks and a sign are allowed,
    bounds are not checked ('3:75' -> 255); a total beyond int is a bad part."""
    parts = F.split(_c(c).cast("string"), ":")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i + 1)).try_cast("int").cast("bigint")

    two = part(0) * 60 + part(1)
    three = part(0) * 3600 + part(1) * 60 + part(2)
    return F.when(n == 2, two).when(n == 3, three).try_cast("int")


def normalize_gender(c: Column | str, key: Column | str, seed: int = 42) -> Column:
    """男 -> M, 女 -> F, anything else (保密, 未知, null) -> M or F chosen by a
    hash of ``seed:key`` (deterministic replacement for a random choice)."""
    c = _c(c)
    coin = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 1) < F.lit("8")
    fallback = F.when(coin, F.lit("M")).otherwise(F.lit("F"))
    out = fallback
    for src, dst in reversed(list(GENDER_CODES.items())):
        out = F.when(c == F.lit(src), F.lit(dst)).otherwise(out)
    return out


def gender_code(c: Column | str) -> Column:
    """M -> 0, F -> 1, anything else -> null."""
    c = _c(c)
    out = F.lit(None).cast("int")
    for src, dst in GENDER_FEATURE.items():
        out = F.when(c == F.lit(src), F.lit(dst)).otherwise(out)
    return out


def clamp_int(c: Column | str, lo: int, hi: int) -> Column:
    """Clamp to [lo, hi] then truncate toward zero; null stays null."""
    x = _c(c).cast("double")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))).cast("int")


def round_half_even(c: Column | str) -> Column:
    """Python round(x) on a float: half to even."""
    return F.bround(_c(c).cast("double"), 0).cast("long")


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), HTML_TAG, "")


def extract_or_default(c: Column | str, pattern: str, default: str = UNKNOWN_TEXT) -> Column:
    """First group of the first match, or ``default`` when there is no match
    (a bare regexp_extract would give '')."""
    c = _c(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(F.lit(default))


def first_match_class(c: Column | str, markers: list[str], default: int = -1) -> Column:
    """Index of the first marker (in list order) contained in the text, else default."""
    c = _c(c)
    out = F.lit(default)
    for i in reversed(range(len(markers))):
        out = F.when(c.contains(markers[i]), F.lit(i)).otherwise(out)
    return out


def json_field(c: Column | str, path: str) -> Column:
    return F.get_json_object(_c(c), path)


def strip_prefix(c: Column | str, prefix_regex: str) -> Column:
    return F.regexp_replace(_c(c), "^" + prefix_regex, "")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds; a wall-clock (NTZ) timestamp is read as UTC."""
    return F.unix_timestamp(_c(ts))


def format_epoch(sec: Column | str, zone: str = "UTC") -> Column:
    """Epoch seconds -> 'YYYY-MM-DD HH:MM:SS' wall clock in ``zone``, built with
    NTZ arithmetic so the session time zone plays no part."""
    epoch0 = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    ntz = epoch0 + F.make_dt_interval(secs=_c(sec).cast("decimal(18,6)"))
    if zone != "UTC":
        ntz = F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)
    return F.date_format(ntz, "yyyy-MM-dd HH:mm:ss")


def cosine_norm(co: Column | str, nu: Column | str, nv: Column | str) -> Column:
    """c / sqrt(nu * nv); 0 when nv is 0."""
    nv = _c(nv)
    return F.when(nv > 0, _c(co).cast("double") / F.sqrt((_c(nu) * nv).cast("double"))).otherwise(F.lit(0.0))


def iif_weight(n_users: Column | str) -> Column:
    """Inverse item frequency weight 1 / ln(1 + n)."""
    return F.lit(1.0) / F.log1p(_c(n_users).cast("double"))


def thousands(c: Column | str) -> Column:
    return F.format_number(_c(c).cast("long"), 0)


def truncate_text(c: Column | str, n: int = 35) -> Column:
    return F.substring(_c(c), 1, n)


def is_digits(c: Column | str) -> Column:
    return _c(c).rlike("^[0-9]+$")
