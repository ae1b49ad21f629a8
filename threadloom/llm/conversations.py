"""Rebuild ordered conversations from delivered message rows.

Subagent messages point at the tool call that started them. A *thread* is all
messages of a conversation with the same pointer; the main thread has none. The
pointers are resolved by pointer jumping over the table of threads (far smaller
than the messages): every round joins each thread with the thread it hangs under
and so doubles the distance covered, which needs O(log depth) equi-joins. Threads
whose pointer names no tool call are orphans; threads that never reach the main
thread lie on, or hang off, a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import blank_to_null, is_blank
from threadloom.operators import delivery
from threadloom.session import cut_lineage, forget

#: Reasons to drop a conversation, in the order in which ``reasons`` lists them.
REASONS = (
    "bad_role",  # a role other than user and assistant
    "some_ordinals_missing",
    "ordinals_not_1_to_n",
    "ordinals_against_lines",  # ordinals do not rise with first lines
    "orphan",  # a parent that is no tool call of the conversation
    "starts_without_user",
    "no_text",
    "unanswered",  # the last main message with text is not the assistant's
)


def _tool_ids(parts: Column) -> Column:
    calls = F.filter(parts, lambda p: (p["kind"] == "tool_use") & ~is_blank(p["id"]))
    return F.transform(calls, lambda p: blank_to_null(p["id"]))


def kept_messages(rows: DataFrame, keys: delivery.Keys = delivery.Keys()) -> DataFrame:
    """One row per message with what the checks need, but none of its text.

    ``conv, row, first_line, ordinal, role, parent, has_text, calls``. Rows without a
    conversation belong to none and are left out.
    """
    facts = {
        "ordinal": F.col("ordinal").cast("long"),
        "role": F.lower(blank_to_null("role")),
        "parent": blank_to_null("parent_tool_use_id"),
        "has_text": F.coalesce(F.exists("parts", lambda p: (p["kind"] == "text") & ~is_blank(p["text"])), F.lit(False)),
        "calls": F.coalesce(_tool_ids(F.col("parts")), F.array().cast("array<string>")),
    }
    # They go along with the rows that identify messages, so no row is joined back.
    kept = delivery.best_arrivals(delivery.message_keys(rows, keys, facts))
    return kept.where(F.col("conv").isNotNull()).select("conv", "row", "first_line", *facts)


def threads(kept: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Every subagent thread with its place below the main thread.

    ``conv, thread, status, depth, path``: ``status`` is ``ok``, ``orphan`` (its
    pointer, or one above it, names no tool call) or ``cycle``; ``path`` lists the
    threads from the one below the main thread down to this one.
    """
    names = kept.where(F.col("parent").isNotNull()).select("conv", F.col("parent").alias("thread")).distinct()
    holders = (
        kept.where(F.size("calls") > 0)
        .select("conv", F.explode("calls").alias("thread"), F.struct(F.col("parent").isNotNull().alias("sub"), F.col("parent").alias("up")).alias("at"))
        .groupBy("conv", "thread")
        .agg(F.min("at").alias("at"))  # a call seen twice: the main thread's goes first
    )
    state = names.join(holders, ["conv", "thread"], "left").select(
        "conv",
        "thread",
        F.when(F.col("at").isNull(), "orphan").when(F.col("at.up").isNull(), "ok").otherwise("open").alias("status"),
        F.col("at.up").alias("up"),
        F.array("thread").alias("path"),
    )
    state = cut_lineage(state, "threads")
    open_before = -1
    for _ in range(max_rounds):
        still = state.where(F.col("status") == "open").count()
        if not still or still == open_before:
            break
        open_before = still
        above = state.select("conv", F.col("thread").alias("up"), F.col("status").alias("s"), F.col("up").alias("next"), F.col("path").alias("head"))
        before, state = state, cut_lineage(
            state.join(above, ["conv", "up"], "left").select(
                "conv",
                "thread",
                F.when(F.col("status") == "open", F.coalesce("s", F.lit("orphan"))).otherwise(F.col("status")).alias("status"),
                F.when(F.col("status") == "open", F.col("next")).otherwise(F.col("up")).alias("up"),
                F.when((F.col("status") == "open") & F.col("head").isNotNull(), F.concat("head", "path")).otherwise(F.col("path")).alias("path"),
            ),
            "threads",
        )
        forget(before)
    return state.select(
        "conv",
        "thread",
        F.when(F.col("status") == "open", "cycle").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "ok", F.size("path")).alias("depth"),
        F.when(F.col("status") == "ok", F.col("path")).alias("path"),
    )


def verdicts(kept: DataFrame, hung: DataFrame) -> DataFrame:
    """One row per conversation: its counts and why it is to be dropped, if so.

    All checks are partial aggregates or equi-joins on ``(conversation, ordinal)``:
    a conversation that holds a third of all rows is spread like any other.
    """
    main = F.col("parent").isNull()
    position = F.struct(F.coalesce("ordinal", "first_line").alias("at"), F.col("row"))
    per_conv = kept.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ordinal").alias("n_ordinals"),
        F.min("ordinal").alias("least"),
        F.max("ordinal").alias("most"),
        F.bool_or(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("bad_role"),
        F.count_if(main).alias("n_main"),
        F.min(F.when(main, F.struct(position.alias("p"), F.coalesce(F.col("role") == "user", F.lit(False)).alias("is_user")))).alias("first_main"),
        F.max(F.when(main & F.col("has_text"), F.struct(position.alias("p"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("is_answer")))).alias("last_text"),
    )
    at = (
        kept.where(F.col("ordinal").isNotNull())
        .groupBy("conv", "ordinal")
        .agg(F.count(F.lit(1)).alias("times"), F.min("first_line").alias("lo"), F.max("first_line").alias("hi"))
    )
    after = at.select("conv", (F.col("ordinal") - 1).alias("ordinal"), F.col("lo").alias("next_lo"), F.lit(True).alias("has_next"))
    order = (
        at.join(after, ["conv", "ordinal"], "left")
        .groupBy("conv")
        .agg(
            F.bool_or(F.col("times") > 1).alias("repeated"),
            F.bool_or(F.when(F.col("has_next"), F.coalesce(F.col("hi") >= F.col("next_lo"), F.lit(True))).otherwise(False)).alias("falls"),
        )
    )
    lost = hung.groupBy("conv").agg(F.bool_or(F.col("status") == "orphan").alias("orphan"))
    numbered = F.col("n_ordinals") > 0
    flags = {
        "bad_role": F.col("bad_role"),
        "some_ordinals_missing": numbered & (F.col("n_ordinals") < F.col("n")),
        "ordinals_not_1_to_n": numbered & (F.col("repeated") | (F.col("least") != 1) | (F.col("most") != F.col("n_ordinals"))),
        "ordinals_against_lines": numbered & F.col("falls"),
        "orphan": F.coalesce("orphan", F.lit(False)),
        "starts_without_user": ~F.coalesce("first_main.is_user", F.lit(False)),
        "no_text": F.col("last_text").isNull(),
        "unanswered": F.col("last_text").isNotNull() & ~F.col("last_text.is_answer"),
    }
    return (
        per_conv.join(order, "conv", "left")
        .join(lost, "conv", "left")
        .select(
            "conv",
            "n",
            "n_main",
            F.filter(F.array(*[F.when(flags[r], F.lit(r)) for r in REASONS]), lambda r: r.isNotNull()).alias("reasons"),
        )
    )


def judged(rows: DataFrame, keys: delivery.Keys = delivery.Keys()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept messages, their threads and the verdict on every conversation."""
    kept = cut_lineage(kept_messages(rows, keys), "kept")
    hung = threads(kept)
    return kept, hung, verdicts(kept, hung)


def dropped(rows: DataFrame, keys: delivery.Keys = delivery.Keys()) -> DataFrame:
    """The conversations that have a reason to be dropped, with their reasons."""
    return judged(rows, keys)[2].where(F.size("reasons") > 0)


def conversations(rows: DataFrame, keys: delivery.Keys = delivery.Keys()) -> DataFrame:
    """The messages of all sound conversations, ready to be read in order.

    One row per message: ``conv_ref, thread, depth, path, position, role, text`` and
    the row it came from. Reading the rows of one thread by ``position`` gives its
    dialogue; ``path`` leads from the main thread (null thread, depth 0) to it. Text
    parts of a message are joined by blank lines.

    Defined results: blank roles, nulls in ordinals, parents or parts never fail,
    they are judged by the reasons above, and exactly the conversations that
    :func:`dropped` lists are left out; repeated deliveries count once; threads on a
    cycle, or hanging off one, have a null depth and path; no rows give no conversations;
    other columns of the input may have any name.
    """
    kept, hung, judged_ = judged(rows, keys)
    # The conversations that go are the smaller list; main messages need no thread.
    gone = cut_lineage(judged_.where(F.size("reasons") > 0).select("conv"), "gone")
    left = kept.join(gone, "conv", "left_anti").select("conv", "row", "first_line", "ordinal", "role", "parent")
    below = left.where(F.col("parent").isNotNull()).join(hung.select("conv", F.col("thread").alias("parent"), "depth", "path"), ["conv", "parent"], "left")
    main = left.where(F.col("parent").isNull()).select("*", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))
    texts = rows.select(
        F.col(keys.row).alias("row"),
        F.array_join(
            F.transform(F.filter("parts", lambda p: (p["kind"] == "text") & ~is_blank(p["text"])), lambda p: p["text"]), "\n\n"
        ).alias("text"),
    )
    placed = main.unionByName(below).join(texts, "row")
    return placed.select(
        F.col("conv").alias("conv_ref"),
        F.col("parent").alias("thread"),
        "depth",
        "path",
        F.coalesce("ordinal", "first_line").alias("position"),
        "role",
        "text",
        F.col("row").alias(keys.row),
    )
