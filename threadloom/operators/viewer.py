"""How entries are shown: tool calls, model names, collapsed lines and search in lines."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from threadloom.functions.labels import tool_summary
from threadloom.functions.matching import fold_case
from threadloom.functions.text import is_blank
from threadloom.operators.fold import result_text
from threadloom.operators.positions import positions


def _diff(old: str, new: str) -> str:
    return "\n".join([*(f"- {x}" for x in old.splitlines()), *(f"+ {x}" for x in new.splitlines())])


def _command(command: str, width: int) -> tuple[str, str | None]:
    room = max(0, width - len("Bash: "))
    lines = [y for x in command.splitlines() for y in ([x] if not room or len(x) <= room else textwrap.wrap(x, room))]
    return ("Bash: " + lines[0], "\n".join(lines[1:])) if len(lines) > 1 else ("Bash: " + command, None)


def tool_call(name: str, arguments: str | None, width: int = 90) -> tuple[str, str | None]:
    """A tool call's headline and body."""
    try:
        given = json.loads(arguments or "null")
    except ValueError:
        given = None
    args = given if isinstance(given, dict) else {}
    text = lambda k, d="": args[k] if isinstance(args.get(k), str) else d
    number = lambda k: args[k] if isinstance(args.get(k), int) and args[k] >= 0 else None
    path = text("file_path")
    if name == "Bash":
        return _command(text("command"), width)
    if name == "Read":
        start, count = number("offset"), number("limit")
        return "Read: " + path + (f":{start}" if start is not None else "") + (f"-{start + count}" if start is not None and count is not None else ""), None
    if name == "Edit":
        both = isinstance(args.get("old_string"), str) and isinstance(args.get("new_string"), str)
        return f"Edit: {path}", _diff(args["old_string"], args["new_string"]) if both else None
    if name == "Grep":
        return f'Grep: "{text("pattern")}" in ' + ("/".join(x for x in (text("path"), text("glob")) if x) or "."), None
    if name == "Glob":
        return f"Glob: {text('pattern')}" + (f" in {text('path')}" if text("path") else ""), None
    simple = {
        "Task": (f"Task ({text('subagent_type', 'agent')}): {text('description')}", text("prompt", None)),
        "Write": (f"Write: {path}", None),
        "WebFetch": (f"Fetch: {text('url')}", text("prompt", None)),
        "WebSearch": (f'Search: "{text("query")}"', None),
    }
    return simple.get(name) or (f"{name}:", json.dumps(given, indent=2, ensure_ascii=False, sort_keys=True))


def tool_calls(rows: DataFrame, width: int = 90) -> DataFrame:
    """``conv_ref, row_id, n, header, body`` of every tool call."""
    calls = rows.select("conv_ref", "row_id", F.posexplode("parts").alias("n", "p")).where(F.col("p.kind") == "tool_use")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shown = [tool_call(n or "", i, width) for n, i in zip(b["name"], b["input"])]
            b = b.assign(header=[h for h, _ in shown], body=[x for _, x in shown])
            yield b[["conv_ref", "row_id", "n", "header", "body"]]

    return calls.select("conv_ref", "row_id", "n", "p.name", "p.input").mapInPandas(run, "conv_ref string, row_id long, n int, header string, body string")


def model_label(col: Column) -> Column:
    """``family-4.5`` of a dated model id; other ids are cut to 20 characters."""
    new, old = r"^[a-z]+-([a-z]+)-(\d+)(?:-(\d{1,2}))?-\d{8}$", r"^[a-z]+-(\d+)(?:-(\d{1,2}))?-([a-z]+)-\d{8}$"
    version = lambda p, a, b: F.concat_ws(".", F.regexp_extract(col, p, a), F.nullif(F.regexp_extract(col, p, b), F.lit("")))
    return (
        F.when(col.rlike(new), F.concat_ws("-", F.regexp_extract(col, new, 1), version(new, 2, 3)))
        .when(col.rlike(old), F.concat_ws("-", F.regexp_extract(col, old, 3), version(old, 1, 2)))
        .when(F.length(col) > 20, F.concat(F.left(col, F.lit(19)), F.lit("…")))
        .otherwise(col)
    )


def body_lines(rendered: DataFrame) -> DataFrame:
    """Lines of rendered messages, blank ones collapsed: ``conv_ref, ordinal, line_no, line``.

    Of blank lines after each other inside a message the first stays.
    """
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    kept = F.filter(lines, lambda s: (F.btrim(s["line"]) != "") | (s["i"] == 0) | (F.btrim(F.get(F.split("body", "\n"), s["i"] - 1)) != ""))
    return rendered.select("conv_ref", "ordinal", F.posexplode(kept).alias("n", "s")).select("conv_ref", "ordinal", (F.col("n") + 1).alias("line_no"), F.col("s.line").alias("line"))


def find_in_lines(lines: DataFrame, conv_ref: str, text: str) -> DataFrame:
    """Lines of one conversation that hold a text in any case, with the next and previous.

    The matches form a ring: after the last comes the first.
    """
    hits = lines.where((F.col("conv_ref") == conv_ref) & F.contains(fold_case(F.col("line")), F.lit(text.lower())))
    order, everything = Window.partitionBy("conv_ref").orderBy("ordinal", "line_no"), Window.partitionBy("conv_ref")
    place = F.struct("ordinal", "line_no")
    return hits.select(
        "conv_ref", "ordinal", "line_no", "line",
        F.coalesce(F.lead(place).over(order), F.min(place).over(everything)).alias("next"),
        F.coalesce(F.lag(place).over(order), F.max(place).over(everything)).alias("previous"),
    )


def entry_index(entries: DataFrame) -> DataFrame:
    """Adds ``entry_index``: the place, from 0, of each parsed entry in its file.

    Lines that do not parse and file snapshots have no place.
    """
    seen = entries.where(F.col("error").isNull() & (F.col("type") != "file-history-snapshot"))
    return positions(seen, "path", "line_no", "_at").withColumn("entry_index", F.col("_at") - 1).drop("_at")


def entry_text(entries: DataFrame, tools: bool = False, thinking: bool = False) -> DataFrame:
    """The text of every entry's blocks, apart by blank lines: ``path, entry_index, text``."""

    def shown(b: Column) -> Column:
        text = F.when(b["type"] == "text", b["text"])
        if tools:
            text = text.when(b["type"] == "tool_use", tool_summary(b["name"], F.to_json(b["input"]))).when(b["type"] == "tool_result", result_text(b["content"]))
        return text.when(b["type"] == "thinking", b["thinking"]) if thinking else text

    texts = F.filter(F.transform("blocks", shown), lambda t: ~is_blank(t))
    return entry_index(entries).where(F.size("blocks") > 0).select("path", "entry_index", F.array_join(texts, "\n\n").alias("text"))


def result_display(content: Column) -> Column:
    """What a viewer shows of a tool result (VARIANT): its text, else its JSON spread over lines.

    A string stands for itself, of an array the texts of its items apart by blank lines;
    nothing at all is ``<no content>``.
    """
    items = F.try_variant_get(content, "$", "array<variant>")
    texts = F.filter(F.transform(items, lambda v: F.try_variant_get(v, "$.text", "string")), lambda t: t.isNotNull())
    plain = F.when(F.startswith(F.schema_of_variant(content), F.lit("STRING")), F.try_variant_get(content, "$", "string"))
    return F.when(content.isNull(), "<no content>").otherwise(
        F.coalesce(plain, F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")), pretty_json(F.to_json(content)))
    )


@F.pandas_udf(StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON over several lines, keys in order; text that is none stays."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False, sort_keys=True)
        except ValueError:
            return text

    return texts.map(one)
