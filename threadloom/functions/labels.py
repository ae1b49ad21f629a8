"""Texts made for reading: sizes, ages, snippets, titles and protocol atoms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.functions.text import squeeze

#: What a segment of a message may hold, in characters (fixed value).
SEGMENT_CHARS = 16 * 1024


def head_and_tail(col: Column, limit: int = SEGMENT_CHARS) -> Column:
    """A longer text keeps the first three quarters of the limit and the last quarter."""
    tail = limit // 4
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.left(col, F.lit(limit - tail)), F.right(col, F.lit(tail))))


def head(col: Column, limit: int | None = SEGMENT_CHARS) -> Column:
    """The first characters up to the limit; without a limit the whole text."""
    return col if limit is None else F.left(col, F.lit(limit))


def tool_summary(name: Column, json: Column) -> Column:
    """``tool name input_keys=a,b``; without keys the name alone."""
    keys = F.array_sort(F.json_object_keys(json))
    return head_and_tail(F.concat(F.lit("tool "), F.coalesce(name, F.lit("")), F.when(F.size(keys) > 0, F.concat(F.lit(" input_keys="), F.array_join(keys, ","))).otherwise("")))


def token_label(n: Column) -> Column:
    """``1.2M``, ``34k`` or the number."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000.0))
        .when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def age_label(then: Column, now: Column) -> Column:
    """How long ago in words; a date for a week or more and for the future."""
    seconds = now.cast("double") - then.cast("double")
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    days = F.floor(seconds / 86400)
    return (
        F.when((seconds < 0) | (days >= 7), F.date_format(then, "MMM dd, HH:mm"))
        .when(minutes < 1, "just now")
        .when(hours < 1, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.when(hours == 1, " hour ago").otherwise(" hours ago")))
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def short_age(then: Column, now: Column) -> Column:
    hours = F.floor((now.cast("double") - then.cast("double")) / 3600)
    return F.when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))


def atom(col: Column) -> Column:
    """Percent-escaped but for letters, digits and ``. _ ~ : / + -``."""
    out = F.url_encode(col)
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%2B", "+"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def snippet(col: Column, limit: int, mark: str = "...") -> Column:
    """White space collapsed; a longer text is cut and ends in ``mark`` inside the limit."""
    text = squeeze(col)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - len(mark))), F.lit(mark)))


def title(custom: Column, summary: Column, preview: Column) -> Column:
    return F.coalesce(custom, summary, preview)


def short_id(col: Column) -> Column:
    """The first seven characters of a tool id without its prefix."""
    return F.left(F.regexp_replace(col, "^toolu_", ""), F.lit(7))


def fence(col: Column) -> Column:
    """A code fence longer than any run of backquotes inside."""
    runs = F.transform(F.regexp_extract_all(col, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def freshness(then: Column, now: Column) -> Column:
    """2 for now and the future, halved every seven days."""
    days = (now.cast("double") - then.cast("double")) / 86400
    return F.when(days <= 0, 2.0).otherwise(2 * F.pow(F.lit(2.0), -days / 7))


def clock_label(stamp: Column) -> Column:
    """``HH:mm`` of an RFC 3339 stamp in the session's zone; null if it is none."""
    return F.date_format(F.try_to_timestamp(stamp), "HH:mm")


def key_prefix(key: Column) -> Column:
    """A chunk key without its number: the text before the last colon; null without one."""
    return F.when(F.contains(key, F.lit(":")), F.regexp_replace(key, r"(?s):[^:]*\z", ""))


def hard_cut(col: Column, limit: int = 80) -> Column:
    """White space collapsed and cut, without a mark."""
    return F.left(squeeze(col), F.lit(limit))


#: Characters two columns wide (fixed values): East Asian wide and full-width blocks.
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"


def display_width(col: Column) -> Column:
    """Columns that a text takes on a terminal: two for wide characters, one for others."""
    return F.length(col) + F.regexp_count(col, F.lit(WIDE))


def display_cut(col: Column, width: int) -> Column:
    """A text wider than ``width`` columns is cut so that it fits with ``…`` after it.

    Of the first ``width`` characters, those whose columns end inside it are kept.
    """
    chars = F.split(F.left(col, F.lit(width)), "")
    ends = F.aggregate(chars, F.array().cast("array<int>"), lambda acc, c: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + display_width(c)))
    kept = F.size(F.filter(ends, lambda e: e <= width - 1))
    return F.when(display_width(col) <= width, col).otherwise(F.concat(F.left(col, kept), F.lit("…")))


def tool_output_id(entry: Column, parent: Column, block: Column, kind: Column, ident: Column) -> Column:
    """Names the output of one tool call or result in a viewer."""
    text = lambda c: c.cast("string")
    return F.concat(F.lit("entry:"), text(entry), F.lit(":parent:"), F.coalesce(parent, F.lit("top")), F.lit(":block:"), text(block), F.lit(":kind:"), kind, F.lit(":id:"), F.coalesce(ident, F.lit("none")))


def tool_summary_id(entry: Column, parent: Column) -> Column:
    return F.concat(F.lit("entry:"), entry.cast("string"), F.lit(":parent:"), F.coalesce(parent, F.lit("top")), F.lit(":kind:summary"))


def chunk_label(rationale: Column, hybrid: Column, semantic: Column, lexical: Column) -> Column:
    """Why a chunk was found, and its scores."""
    return F.format_string("%s hybrid=%.3f semantic=%.3f lexical=%.3f", rationale, hybrid.cast("double"), semantic.cast("double"), lexical.cast("double"))
