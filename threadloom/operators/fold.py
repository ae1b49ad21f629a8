"""Fold the entries of transcripts into messages and conversations.

The fold is ordered, so it runs in windows over one file; a transcript file is the unit
that one task handles, as it is when it is read. All windows share the partitioning by
path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.cleaning import CAVEAT, is_clear_metadata, semantic_turn, skill_preview
from threadloom.functions.labels import SEGMENT_CHARS, head, head_and_tail, tool_summary
from threadloom.functions.paths import decode_path
from threadloom.functions.text import blank_to_null, is_blank, strip



def result_text(content: Column) -> Column:
    """Text of a tool result: a string, or the text items of an array; else null."""
    items = F.try_variant_get(content, "$", "array<variant>")
    one = F.transform(
        items,
        lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("STRING")), F.try_variant_get(v, "$", "string")).when(
            F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("text")) == "text", F.try_variant_get(v, "$.text", "string")
        ),
    )
    text = F.when(items.isNotNull(), F.array_join(F.filter(one, lambda t: t.isNotNull()), "\n")).when(
        F.startswith(F.schema_of_variant(content), F.lit("STRING")), F.try_variant_get(content, "$", "string")
    )
    return head_and_tail(text, SEGMENT_CHARS)


def text_of(blocks: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " "), F.lit(""))


def search_text_of(blocks: Column) -> Column:
    said = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_result", result_text(b["content"])))
    return F.coalesce(F.array_join(F.filter(said, lambda t: t != ""), " "), F.lit(""))


def counts_as_message(blocks: Column) -> Column:
    shows = lambda b: (
        ((b["type"] == "text") & ~is_blank(b["text"])) | b["type"].isin("tool_use", "tool_result") | ((b["type"] == "thinking") & ~is_blank(b["thinking"]))
    )
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(shows(b), F.lit(False))), F.lit(False))


def agent_text(blocks: Column, user: Column, limit: int | None = SEGMENT_CHARS) -> Column:
    """What a subagent's message adds to the search text; ``limit`` bounds a block's text."""
    one = lambda b: (
        F.when(b["type"] == "text", head(F.coalesce(F.when(user, skill_preview(b["text"])), b["text"]), limit))
        .when(b["type"] == "tool_use", tool_summary(b["name"], F.to_json(b["input"])))
        .when(b["type"] == "tool_result", result_text(b["content"]))
        .when(b["type"] == "thinking", head(b["thinking"], limit))
    )
    return F.array_join(F.filter(F.transform(blocks, one), lambda t: ~is_blank(t)), " ")


def judged_entries(entries: DataFrame) -> DataFrame:
    """Entries with what the fold knows of each: previews, warm-ups and ordinals.

    A ``Warmup`` message before the first real one is no message, nor is the next
    answer. Answers before the first real user message do not count; lines of one
    answer share the ordinal of its first counted line; subagent messages count.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ok = entries.where(F.col("error").isNull())
    user, answer = F.col("type") == "user", F.col("type") == "assistant"
    e = (
        ok.withColumn("text", F.when(user | answer, text_of(F.col("blocks"))))
        .withColumn("search", F.when(user | answer, search_text_of(F.col("blocks"))))
        .withColumn("skip", user & (F.col("text") == "") & (F.col("search") == ""))
        .withColumn("skill", F.when(user, skill_preview(F.col("text"))))
        .withColumn("clear", user & F.col("skill").isNull() & (F.col("text") != "") & is_clear_metadata(F.col("text")))
        .withColumn("preview", F.when(user & ~F.col("skip") & ~F.col("clear"), F.coalesce("skill", "text")))
        .withColumn("real", user & F.coalesce(F.col("preview") != "", F.lit(False)) & F.coalesce(strip(F.col("preview")) != "Warmup", F.lit(False)))
    )
    e = e.withColumn("seen", F.coalesce(F.max(F.col("real").cast("int")).over(before), F.lit(0)) == 1)
    e = e.withColumn("warmup", user & F.coalesce(strip(F.col("preview")) == "Warmup", F.lit(False)) & ~F.col("seen"))
    last_warmup = F.max(F.when(F.col("warmup"), F.col("line_no"))).over(before)
    last_answer = F.max(F.when(answer, F.col("line_no"))).over(before)
    e = e.withColumn("skipped", answer & F.coalesce(last_warmup > F.coalesce(last_answer, F.lit(-1)), F.lit(False)))
    count_user = user & ~F.col("skip") & ~F.col("clear") & ~F.col("warmup") & ((F.col("preview") != "") | (F.col("search") != ""))
    count_answer = answer & F.col("seen") & ~F.col("skipped") & counts_as_message(F.col("blocks"))
    sub = F.col("progress_type").isin("user", "assistant") & counts_as_message(F.col("blocks"))
    e = e.withColumn("counted", F.coalesce(count_user | count_answer | sub, F.lit(False)))
    same = Window.partitionBy("path", "msg_id", "counted").orderBy("line_no")
    first_of_id = F.col("msg_id").isNull() | ~answer | (F.row_number().over(same) == 1)
    e = e.withColumn("opens", (F.col("counted") & first_of_id).cast("int"))
    e = e.withColumn("running", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shared = F.first("running").over(same.rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("ordinal", F.when(F.col("counted"), F.when(answer & F.col("msg_id").isNotNull(), shared).otherwise(F.col("running"))).cast("int"))


def conversations(entries: DataFrame) -> DataFrame:
    """One row per transcript file: texts, previews, titles, tokens and duration.

    Files without any text, and those that only clear the screen, give no row.
    """
    e = judged_entries(entries)
    user, answer = F.col("type") == "user", F.col("type") == "assistant"
    counted_answer = answer & F.col("counted")
    # The last line of an answer stands for it, at the place of its first counted line.
    turn_key = F.when(counted_answer & F.col("msg_id").isNotNull(), F.col("msg_id")).otherwise(F.col("line_no").cast("string"))
    said = F.when(user & F.col("counted") & (F.col("preview") != ""), F.col("preview")).when(counted_answer, F.col("text"))
    turns = (
        e.where(F.col("counted") & (user | answer))
        .withColumn("said", F.nullif(said, F.lit("")))
        .withColumn("turn", F.when(user & (F.col("preview") != ""), semantic_turn(F.col("text"), F.lit(False))).when(answer, semantic_turn(F.col("text"), F.lit(True))))
        .groupBy("path", turn_key.alias("k"))
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.min(F.when(F.col("turn").isNotNull(), F.col("line_no"))).alias("turn_line"),
            F.min(F.when(F.col("said").isNotNull(), F.col("line_no"))).alias("said_line"),
            F.max_by("said", F.when(F.col("said").isNotNull(), F.col("line_no"))).alias("said"),
            F.max_by("turn", "line_no").alias("turn"),
        )
        .groupBy("path")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("said_line", "said")))).alias("said"),
            F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn_line", "turn", "ordinal")))).alias("turns"),
        )
    )
    tokens = sum((F.coalesce(F.col(f"usage.{f}"), F.lit(0)) for f in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")), F.lit(0))
    usage = (
        e.where(answer & F.col("usage").isNotNull())
        .groupBy("path", F.coalesce("msg_id", F.concat(F.lit("\0"), F.col("line_no").cast("string"))).alias("k"))
        .agg(F.max_by(tokens, "line_no").alias("tokens"))
        .groupBy("path")
        .agg(F.sum("tokens").cast("long").alias("total_tokens"))
    )
    trimmed = blank_to_null("title_value")
    part = F.when((user & ~F.col("skip")) | answer, F.nullif(F.col("search"), F.lit("")))
    own = strip(F.col("text"))
    mark = {"caveat": F.startswith(own, F.lit(CAVEAT)), "command": F.contains(own, F.lit("<command-name>/clear</command-name>")), "stdout": F.contains(own, F.lit("<local-command-stdout>"))}
    shown = user & (own != "")
    facts = e.groupBy("path").agg(
        *[F.first(c).alias(c) for c in ("file_name", "project_dir", "session", "file_size", "mtime")],
        F.min_by("cwd", F.when(user & F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"),
        F.min_by("model", F.when(answer & F.col("model").isNotNull(), F.col("line_no"))).alias("model"),
        F.min_by("title_value", F.when(F.col("type") == "summary", F.col("line_no"))).alias("first_summary"),
        F.max_by(trimmed, F.when((F.col("type") == "ai-title") & trimmed.isNotNull(), F.col("line_no"))).alias("ai_title"),
        F.max_by(F.struct(trimmed.alias("t")), F.when(F.col("type") == "custom-title", F.col("line_no"))).alias("custom"),
        F.min_by("ts", F.when((user | answer) & F.col("ts").isNotNull(), F.col("line_no"))).alias("first_ts"),
        F.max_by("ts", F.when((user | answer) & F.col("ts").isNotNull(), F.col("line_no"))).alias("last_ts"),
        F.sum("opens").cast("int").alias("message_count"),
        F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("line_no", part.alias("t"))))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("progress_type").isin("user", "assistant"), F.struct("line_no", agent_text(F.col("blocks"), F.col("progress_type") == "user").alias("t"))))).alias("agents"),
        F.bool_and(F.when(shown, mark["caveat"] | mark["command"] | mark["stdout"])).alias("all_marked"),
        *[F.coalesce(F.bool_or(shown & m), F.lit(False)).alias(f"saw_{k}") for k, m in mark.items()],
    )
    joined = facts.join(turns, "path", "left").join(usage, "path", "left")
    says = F.transform("said", lambda s: s["said"])
    minutes = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 60)
    custom = F.col("custom.t")
    summary = F.coalesce("ai_title", "first_summary")
    clear_only = F.coalesce(F.col("all_marked"), F.lit(False)) & F.col("saw_caveat") & F.col("saw_command") & F.col("saw_stdout")
    return (
        joined.where(~clear_only & (F.size("parts") > 0) & (F.size(F.coalesce("said", F.array().cast(joined.schema["said"].dataType))) > 0))
        .select(
            "path",
            "session",
            "project_dir",
            "file_size",
            "mtime",
            F.array_join(F.slice(says, 1, 3), " ... ").alias("preview_first"),
            F.array_join(F.slice(F.reverse(says), 1, 3), " ... ").alias("preview_last"),
            F.concat_ws(" ", custom, summary, F.array_join(F.transform("parts", lambda p: p["t"]), " ")).alias("full_text"),
            F.nullif(F.array_join(F.filter(F.transform("agents", lambda a: a["t"]), lambda t: t != ""), " "), F.lit("")).alias("agent_search_text"),
            F.transform("turns", lambda t: t["turn"]).alias("semantic_turns"),
            F.transform("turns", lambda t: F.struct(t["ordinal"].alias("start"), t["ordinal"].alias("finish"))).alias("semantic_turn_ranges"),
            "cwd",
            F.coalesce("cwd", decode_path(F.col("project_dir"))).alias("project_path"),
            "message_count",
            summary.alias("summary"),
            custom.alias("custom_title"),
            "model",
            F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            F.when(minutes > 0, minutes).alias("duration_minutes"),
        )
    )


def messages(entries: DataFrame, bad: str = "skip") -> DataFrame:
    """Transcript messages in order, lines of one answer merged into its last line.

    ``path, ordinal, role, timestamp, jsonl_line, assistant_message_id,
    parent_tool_use_id, parts``. ``bad`` says what becomes of lines that do not parse:
    ``skip`` leaves out the line, ``drop`` its transcript, and ``fail`` ends the query with
    an error that names the transcript and the line.
    """
    if bad not in ("skip", "drop", "fail"):
        raise ValueError(f"unknown treatment of bad lines: {bad!r}")
    if bad == "drop":
        entries = entries.join(entries.where(F.col("error").isNotNull()).select("path").distinct(), "path", "left_anti")
    if bad == "fail":
        told = F.concat(F.col("path"), F.lit(", line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))
        entries = entries.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
    ok = entries.where(F.col("error").isNull())
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    user, answer, sub = F.col("type") == "user", F.col("type") == "assistant", F.col("progress_type").isin("user", "assistant")
    text = text_of(F.col("blocks"))
    e = ok.where(user | answer | F.coalesce(sub, F.lit(False))).withColumn("text", text)
    clear = F.col("text").isNotNull() & (F.col("text") != "") & skill_preview(F.col("text")).isNull() & is_clear_metadata(F.col("text"))
    e = e.withColumn("clear", user & clear)
    opens = user & ~F.col("clear") & (F.size("blocks") > 0) & (strip(F.col("text")) != "Warmup")
    e = e.withColumn("seen", F.coalesce(F.max(opens.cast("int")).over(w), F.lit(0)) == 1)
    keep = (user & ~F.col("clear") & counts_as_message(F.col("blocks")) & (F.col("seen") | (strip(F.col("text")) != "Warmup"))) | (answer & F.col("seen") & counts_as_message(F.col("blocks"))) | (F.coalesce(sub, F.lit(False)) & counts_as_message(F.col("blocks")))
    kept = e.where(keep).withColumn("k", F.when(answer & F.col("msg_id").isNotNull(), F.col("msg_id")).otherwise(F.col("line_no").cast("string")))
    merged = kept.groupBy("path", "k").agg(
        F.min("line_no").alias("first_line"),
        F.max_by(F.struct("type", "progress_type", "ts", "line_no", "msg_id", "parent_tool_use_id", "blocks"), "line_no").alias("m"),
    )
    part = lambda b, i: F.struct(
        F.when(b["type"].isin("tool_use", "tool_result", "thinking"), b["type"]).otherwise("text").alias("kind"),
        F.coalesce(b["thinking"], b["text"]).alias("text"),
        b["id"].alias("id"),
        b["name"].alias("name"),
        F.to_json(b["input"]).alias("input"),
        b["tool_use_id"].alias("tool_use_id"),
        result_text(b["content"]).alias("content"),
        i.alias("part_index"),
    )
    number = F.row_number().over(Window.partitionBy("path").orderBy("first_line"))
    return merged.select(
        "path",
        number.alias("ordinal"),
        F.when(F.col("m.type") == "progress", F.col("m.progress_type")).otherwise(F.col("m.type")).alias("role"),
        F.col("m.ts").alias("timestamp"),
        F.col("m.line_no").alias("jsonl_line"),
        F.col("m.msg_id").alias("assistant_message_id"),
        F.col("m.parent_tool_use_id").alias("parent_tool_use_id"),
        F.transform(F.filter("m.blocks", lambda b: b["type"].isin("text", "tool_use", "tool_result", "thinking")), part).alias("parts"),
    )
