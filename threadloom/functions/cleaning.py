"""Cleaning of transcript text: commands, tags, fences, tables and status lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.functions.matching import quote
from threadloom.functions.text import blank_to_null, squeeze, strip

# Markup and phrases that transcripts carry.
CAVEAT = "Caveat: The messages below were generated by the user while running local commands."
SKILL_BASE = "Base directory for this skill:"
TAGS = ("system-reminder", "local-command-caveat", "local-command-stdout", "command-message", "command-name")
VALIDATION_TERMS = ("validation passed", "all checks pass", "working tree clean", "committed", "commit:", "validation:")
COMMAND_TERMS = ("cargo test", "just check", "git status", "git diff")
CODE_MARKERS = ("::{", "=>", "</", "<div", "function ", "const ", "let ", "fn ")
BOX = "─━│┃┌┐└┘├┤┬┴┼╭╮╰╯═║╔╗╚╝"


def any_in(col: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col, F.lit(needle))
    return out


def _between(col: Column, tag: str) -> Column:
    """What stands between the first opening and the first closing tag; null if they lack."""
    a, b = f"<{tag}>", f"</{tag}>"
    start, end = F.instr(col, a), F.instr(col, b)
    return F.when((start > 0) & (end > 0) & (start + len(a) <= end), F.substring(col, start + len(a), end - start - len(a)))


def skill_preview(col: Column) -> Column:
    """``/name args`` of a command message; null for others and for ``/clear``."""
    text = strip(col)
    name = _between(text, "command-name")
    name = F.when(F.startswith(name, F.lit("/")) & (name != "/clear"), name)
    return F.when(name.isNotNull(), F.concat_ws(" ", name, blank_to_null(_between(text, "command-args"))))


def is_clear_metadata(col: Column) -> Column:
    """Messages that only carry a command's wrapping."""
    text = strip(col)
    has = lambda needle: F.contains(text, F.lit(needle))
    return (
        (text == "")
        | F.startswith(text, F.lit(CAVEAT))
        | has("<local-command-caveat>")
        | has("<command-name>/clear</command-name>")
        | has("<command-message>clear</command-message>")
        | (has("<command-name>") & ~has("<command-name>/"))
        | has("<local-command-stdout>")
        | F.startswith(text, F.lit(SKILL_BASE))
    )


def strip_fences(col: Column) -> Column:
    """Without spans between triple backquotes; an open one takes the rest."""
    return F.regexp_replace(col, r"(?s)`{3}.*?(?:`{3}|\z)", "")


def strip_tags(col: Column) -> Column:
    """Without the spans of all structural tags, one kind after the other."""
    for tag in TAGS:
        col = F.regexp_replace(col, rf"(?s)<{quote(tag)}>.*?(?:</{quote(tag)}>|\z)", "")
    return col


def command_args(col: Column) -> Column:
    """The arguments of a command message; null if it is none or has none."""
    wrapped = F.contains(col, F.lit("<command-name>")) & F.contains(col, F.lit("</command-name>"))
    return F.when(wrapped, blank_to_null(F.nullif(F.regexp_extract(col, r"(?s)\A.*?<command-args>(.*?)</command-args>", 1), F.lit(""))))


def is_low_value(block: Column) -> Column:
    text = strip(block)
    marks = [f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]
    return (text == "") | F.startswith(text, F.lit("/")) | any_in(text, marks)


def is_status(block: Column) -> Column:
    low = F.lower(block)
    return any_in(low, VALIDATION_TERMS) & any_in(low, COMMAND_TERMS)


def is_artifact(block: Column) -> Column:
    """Boxes, tables and code rather than language."""
    count = lambda cls: F.regexp_count(block, F.lit(cls))
    solid, box = count(r"\P{IsWhite_Space}"), count(f"[{BOX}]")
    marks, letters = count(r"[|\-+=_`]"), count(r"[\p{IsAlphabetic}\p{N}]")
    return (
        (solid == 0)
        | (box * 4 >= solid)
        | ((box >= 3) & (solid <= 24))
        | ((marks * 2 > letters) & F.contains(block, F.lit("|")))
        | (any_in(block, CODE_MARKERS) & (marks > F.floor(letters / 4)))
    )


def semantic_turn(text: Column, assistant: Column) -> Column:
    """The part of a turn that carries meaning; null if nothing is left."""
    body = squeeze(strip_tags(strip_fences(F.coalesce(command_args(text), text))))
    blocks = F.transform(F.regexp_extract_all(body, F.lit(f"([{BOX}]+|[^{BOX}]+)"), F.lit(1)), strip)
    kept = F.filter(blocks, lambda b: (b != "") & ~is_low_value(b) & ~(assistant & is_status(b)) & ~is_artifact(b))
    return F.nullif(squeeze(F.array_join(kept, " ")), F.lit(""))


def list_preview(col: Column) -> Column:
    """Without anything in angle brackets, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(col, r"<[^>]*>?|>", ""), r"[ \t\r\n]+", " ")


def viewer_command(col: Column) -> Column:
    """How a command message is shown: its name and arguments, its output, or not at all."""
    text = strip(col)
    out = _between(text, "local-command-stdout")
    return (
        F.when(F.startswith(text, F.lit(CAVEAT)) | F.contains(text, F.lit("<local-command-caveat>")), None)
        .when(F.contains(text, F.lit("<command-name>/clear</command-name>")), None)
        .when(out.isNotNull(), blank_to_null(out))
        .when(F.startswith(text, F.lit(SKILL_BASE)), F.concat(F.lit("*Skill: "), F.get(F.filter(F.transform(F.split(F.substring(text, F.lit(len(SKILL_BASE) + 1), F.length(text)), "\n"), strip), lambda x: x != ""), F.lit(0)), F.lit("*")))
        .otherwise(F.coalesce(skill_preview(col), col))
    )


def command_tag(col: Column) -> Column:
    """``/name args`` of any command message, ``/clear`` too; null for others."""
    text = strip(col)
    name = _between(text, "command-name")
    name = F.when(F.startswith(name, F.lit("/")), name)
    return F.when(name.isNotNull(), F.concat_ws(" ", name, blank_to_null(_between(text, "command-args"))))


def export_command(col: Column) -> Column:
    """How exports show a command message: its output, its name and arguments, or the text itself.

    A message that is nothing but empty output is not shown (null).
    """
    text = strip(col)
    a, b = "<local-command-stdout>", "</local-command-stdout>"
    wrapped = F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)) & (F.length(text) >= len(a) + len(b))
    inner = F.substring(text, F.lit(len(a) + 1), F.length(text) - len(a) - len(b))
    return F.when(wrapped, blank_to_null(inner)).otherwise(F.coalesce(command_tag(col), col))
