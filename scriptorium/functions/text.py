"""Text expressions: normal forms, escapes, truncation, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripting languages count it (fixed values).
WHITE = r"[\t\n\x0B\f\r    -     　﻿]"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def normal_text(x: Column) -> Column:
    """Line ends as one newline, trimmed."""
    return trim(F.regexp_replace(x, "\r\n?", "\n"))


def inline_text(x: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(x, f"{WHITE}+", " "))


def present(x: Column) -> Column:
    """Null for an empty string, which counts as missing."""
    return F.nullif(x, F.lit(""))


def paragraphs(x: Column, by: str = r"\n\s*\n+") -> Column:
    """Non-blank trimmed paragraphs in order."""
    return F.filter(F.transform(F.split(normal_text(x), by), trim), lambda p: p != "")


def truncated(x: Column, most: int = 160) -> Column:
    """At most so many characters: cut behind the last full stop or semicolon (full-width) that leaves 60 %, else right-trimmed,
    with an ellipsis."""
    flat = inline_text(x)
    if most <= 1:
        return F.when(F.length(flat) <= most, flat).otherwise("…" if most == 1 else "")
    head = F.substring(flat, 1, most - 1)
    last = F.lit(most - 1) - F.length(F.regexp_extract(head, "([^。；]*)$", 1))
    cut = F.when(last >= int(most * 0.6) + 1, F.substring(head, F.lit(1), last)).otherwise(F.rtrim(head))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_xml(x: Column, most: int | None = None) -> Column:
    """Trimmed, without characters that XML forbids, cut before it is escaped."""
    x = F.regexp_replace(trim(x), r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", "")
    x = F.substring(x, 1, most) if most else x
    return replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_markdown(x: Column, line_starts: bool = False) -> Column:
    """Entities for markup, backslashes before inline marks; line_starts: also before block marks."""
    x = replaced(F.regexp_replace(x, "\r\n?", "\n"), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])
    x = F.regexp_replace(x, r"([\\`*_\[\]])", r"\\$1")
    if line_starts:
        x = F.regexp_replace(x, r"(?m)^(\x20{0,3})([#+-])", r"$1\\$2")
        x = F.regexp_replace(x, r"(?m)^(\x20{0,3}[0-9]+)([.)])", r"$1\\$2")
    return trim(x)


def json_ld_safe(x: Column) -> Column:
    return replaced(x, [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")])


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour, of whole seconds."""
    s = seconds.cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def duration(seconds: Column) -> Column:
    return clock(F.floor(seconds + 0.5))


def timestamp(seconds: Column) -> Column:
    return clock(F.floor(seconds))


def iso_duration(seconds: Column) -> Column:
    """PT#H#M#S without zero parts; null unless positive."""
    s = F.floor(seconds + 0.5).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    text = F.concat(F.lit("PT"), part(F.floor(s / 3600), "H"), part(F.floor(s / 60) % 60, "M"), part(s % 60, "S"))
    return F.when(seconds > 0, text)


def clock_to_seconds(x: Column) -> Column:
    """Seconds of mm:ss or h:mm:ss."""
    parts = F.transform(F.split(x, ":"), lambda p: F.try_to_number(p, F.lit("999999999")).cast("long"))
    return F.when(x.rlike(r"^\d+:\d+(:\d+)?$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p))


def visible_length(x: Column) -> Column:
    """Characters without white space."""
    return F.length(F.regexp_replace(x, WHITE, ""))


def reading_minutes(characters: Column, a_minute: int = 400) -> Column:
    return F.greatest(F.lit(1), F.ceil(characters / a_minute).cast("long"))
