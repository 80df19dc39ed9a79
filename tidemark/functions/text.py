"""String cleaning shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode separators, control characters and zero-width marks.
_BLANK = r"[\s\p{Z}\p{Cc}​﻿]"


def trimmed(col: Column) -> Column:
    """``col`` without blanks of any kind at its ends; null when nothing is left."""
    s = F.regexp_replace(col, f"^{_BLANK}+|{_BLANK}+$", "")
    return F.when(s != "", s)


def identifier_key(col: Column) -> Column:
    """Canonical form of an identifier; null for a null, empty or blank one.

    Case and surrounding blanks do not matter, a UUID means the same with or without hyphens or
    braces, and a counter means the same with or without leading zeros.
    """
    s = F.lower(trimmed(col))
    hex_only = F.regexp_replace(s, r"[{}\-]", "")
    s = F.when(hex_only.rlike("^[0-9a-f]{32}$"), hex_only).otherwise(s)
    return F.regexp_replace(s, r"^0+(?=[0-9]+$)", "")


def day_of(col: Column) -> Column:
    """DATE of a day written as 2024-05-01, 2024/05/01, 20240501, 1 May 2024 or an ISO date-time.

    Null for null, empty or unreadable text. An ISO date-time counts for the date it shows.
    """
    s = trimmed(col)
    iso = F.regexp_extract(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:$|[T ])", 0)
    dashed = F.regexp_replace(F.regexp_replace(iso, r"[T ]$", ""), r"[/.]", "-")
    return (
        F.when(iso != "", dashed.try_cast("date"))
        .when(s.rlike(r"^\d{8}$"), F.concat_ws("-", s.substr(1, 4), s.substr(5, 2), s.substr(7, 2)).try_cast("date"))
        .when(s.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_timestamp(F.initcap(s), F.lit("d MMM yyyy")).cast("date"))
    )


def source_key(col: Column) -> Column:
    """Source name in lower case with underscores; null for a null or blank one."""
    return F.regexp_replace(F.lower(trimmed(col)), r"[\s\-]+", "_")


def plain_markdown(col: Column) -> Column:
    """A line without the marks of bold, italic and code text."""
    for pattern in (r"\*\*([^\n]+?)\*\*", r"\*([^\n]+?)\*", r"`([^\n]+?)`"):
        col = F.regexp_replace(col, pattern, "$1")
    return col


def line_kind(col: Column) -> Column:
    """What a line of marked-up text is: fence, title, section, part, point, rule, bullet, item, row, blank or text."""
    bare = F.regexp_replace(col, r"^[ \t\r]+|[ \t\r]+$", "")
    return (
        F.when(bare.startswith("```"), "fence").when(col.startswith("# "), "title").when(col.startswith("## "), "section").when(col.startswith("### "), "part").when(col.startswith("#### "), "point")
        .when(bare == "---", "rule").when(bare.startswith("- ") | bare.startswith("* "), "bullet").when(col.rlike(r"^[ \t]*[0-9]+\.[ \t]+[^ \t\r]"), "item").when(col.startswith("|"), "row").when(bare == "", "blank").otherwise("text")
    )
