"""What tools a conversation used, in total and in runs of tool-only messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import blank_to_null
from threadloom.operators.positions import positions, running_sum
from threadloom.session import cut_lineage

# Tools that are counted by themselves, as (counter, tool, verb, noun), in the order of the sentence.
TOOLS = (
    ("searched_patterns", "Grep", "Searched for", "pattern"),
    ("searched_file_patterns", "Glob", "Searched for", "file pattern"),
    ("read_files", "Read", "read", "file"),
    ("shell_commands", "Bash", "ran", "shell command"),
    ("edited_files", "Edit", "edited", "file"),
    ("wrote_files", "Write", "wrote", "file"),
    ("agents", "Task", "started", "agent"),
    ("fetched_urls", "WebFetch", "fetched", "URL"),
    ("web_searches", "WebSearch", "searched", "web"),
    ("other_tools", None, "called", "tool"),
)


def _counter(name: Column, tool: str | None) -> Column:
    named = [t for _, t, _, _ in TOOLS if t]
    hit = name == tool if tool else ~F.coalesce(name.isin(*named), F.lit(False))
    return F.count_if(hit)


def sentence(prefix: str = "") -> Column:
    """``Searched for 2 patterns, read 1 file``; empty without calls."""
    said = [
        F.when(F.col(prefix + c) > 0, F.concat(F.lit(f"{verb} "), F.col(prefix + c).cast("string"), F.lit(f" {noun}"), F.when(F.col(prefix + c) == 1, "").otherwise("s")))
        for c, _, verb, noun in TOOLS
    ]
    text = F.concat_ws(", ", *said)
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def tool_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Calls by tool for every group of messages."""
    calls = rows.select(*keys, F.explode(F.filter("parts", lambda p: p["kind"] == "tool_use")).alias("p"))
    return calls.groupBy(*keys).agg(*[_counter(F.col("p.name"), tool).alias(c) for c, tool, _, _ in TOOLS]).withColumn("sentence", sentence())


def tool_runs(rows: DataFrame) -> DataFrame:
    """Runs of assistant messages that only call tools, with one summary each.

    A run goes on over user messages that only hold tool results and ends with any
    other message or with a call of another parent. ``conv_ref, run, parent, first,
    last`` and the counters.
    """
    only = lambda kind: F.coalesce((F.size("parts") > 0) & F.forall("parts", lambda p: p["kind"] == kind), F.lit(False))
    role = F.lower(blank_to_null("role"))
    marked = rows.select(
        "conv_ref",
        "ordinal",
        "parts",
        blank_to_null("parent_tool_use_id").alias("parent"),
        F.when(only("tool_use") & (role == "assistant"), "call").when(only("tool_result") & (role == "user"), "result").otherwise("other").alias("is"),
    ).where(F.col("is") != "result")
    placed = cut_lineage(positions(marked, "conv_ref", "ordinal", "at"), "placed")
    before = placed.select("conv_ref", (F.col("at") + 1).alias("at"), F.col("is").alias("was"), F.col("parent").alias("had"))
    linked = placed.join(before, ["conv_ref", "at"], "left")
    goes_on = F.coalesce((F.col("was") == "call") & F.col("had").eqNullSafe(F.col("parent")), F.lit(False))
    linked = linked.withColumn("starts", F.when((F.col("is") == "call") & ~goes_on, 1).otherwise(0))
    runs = running_sum(linked, "conv_ref", "at", "starts", "run").where(F.col("is") == "call")
    calls = runs.withColumn("p", F.explode("parts"))
    return (
        calls.groupBy("conv_ref", "run", "parent")
        .agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), *[_counter(F.col("p.name"), tool).alias(c) for c, tool, _, _ in TOOLS])
        .withColumn("sentence", sentence())
    )
