"""Scalar text expressions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimp.functions import patterns as P


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, '' where there is none."""
    return F.coalesce(F.regexp_extract(text, pattern, group), F.lit(""))


def attr_value(tag: Column, names: str) -> Column:
    """Value of the first of the named attributes in a tag, quoted either way or not at all."""
    return matched_value(tag, P.attribute(names))


def matched_value(match: Column, pattern: str) -> Column:
    """The value in a match of an attribute pattern."""
    return F.concat(*[first_match(match, pattern, group) for group in (2, 3, 4)])


def fold(text: Column) -> Column:
    """Full case folding: upper first so that sharp s becomes ss.

    The empty concatenation keeps the optimiser from reducing lower(upper(x)) to lower(x).
    """
    return F.lower(F.concat(F.upper(text), F.lit("")))


def ascii_fold(text: Column) -> Column:
    """Lower-cases A-Z only, like a byte-wise search."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(text: Column) -> Column:
    """Every whitespace run becomes one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, P.SPACES, " "))


def dehyphenate(text: Column) -> Column:
    return F.replace(text, F.lit("-\n"), F.lit(""))


def text_views(text: Column) -> dict[str, Column]:
    return {"as_is": text, "normalised": squeeze(text), "dehyphenated": squeeze(dehyphenate(text))}


def words(text: Column) -> Column:
    """Distinct whitespace-separated tokens."""
    return F.array_distinct(F.filter(F.split(text, P.SPACES, -1), lambda w: w != ""))


def escape_regex(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def fmt_size(n: Column, variant: str = "audit") -> Column:
    """Readable size; the two variants differ in MB digits and in having GB."""
    kb = F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1))
    if variant == "engine":
        mb = F.format_string("%.2f MB", F.bround(n / F.lit(1048576.0), 2))
        return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)
    mb = F.format_string("%.1f MB", F.bround(n / F.lit(1048576.0), 1))
    gb = F.format_string("%.2f GB", F.bround(n / F.lit(1073741824.0), 2))
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1048576, kb).when(n < 1073741824, mb).otherwise(gb))


def domain_of(uri: Column) -> Column:
    """Scheme and host in lower case; other values trimmed and cut at 80 characters."""
    trimmed = F.regexp_replace(uri, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    host = first_match(trimmed, r"(?i)^(https?://[^ \t\r\n/]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(F.substring(trimmed, 1, 80))


def sanitize_title(title: Column) -> Column:
    """A title made safe as part of a file name."""
    clean = F.regexp_replace(title, r"""[<>:"/\\|?*\x00-\x1f]""", "_")
    clean = F.substring(F.btrim(clean, F.lit(". _")), 1, 80)
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def render_name(template: Column, fields: dict[str, Column], default: Column) -> Column:
    """Fill {placeholders}; a template with an unknown one falls back to the default."""
    out = template
    for key, value in fields.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    allowed = "|".join(fields)
    known = F.regexp_replace(template, r"\{(" + allowed + r")\}", "")
    return F.when(F.coalesce(known, F.lit("{")).rlike(r"[{}]"), default).otherwise(out)


def saved_bytes(original: Column, compressed: Column, skipped: Column) -> Column:
    return F.when(skipped, F.lit(0)).otherwise(original - compressed).cast("bigint")


def saved_pct(original: Column, compressed: Column, skipped: Column) -> Column:
    return F.when(skipped | (original == 0), F.lit(0.0)).otherwise((1 - compressed / original) * 100)


def gps_decimal(dms: Column, ref: Column) -> Column:
    """'deg,min,sec' and a hemisphere letter to signed degrees; null where unreadable."""
    part = F.split(dms, ",")
    value = (part[0].try_cast("double") + part[1].try_cast("double") / 60.0
             + part[2].try_cast("double") / 3600.0)
    south_west = F.upper(F.btrim(F.coalesce(ref, F.lit("")))).isin("S", "W")
    return F.when(south_west, -value).otherwise(value)


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")
