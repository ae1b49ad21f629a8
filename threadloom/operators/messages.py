"""Search inside messages: segments, matches, scores and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.labels import SEGMENT_CHARS, head, head_and_tail, tool_summary
from threadloom.functions.matching import all_of, fold_case, has_literal, is_sensitive, normalize, quote, word_matches
from threadloom.functions.text import is_blank, squeeze
from threadloom.plans.query import ParsedQuery, parse
from threadloom.session import held

#: Where a hit was found, by rank (fixed values).
SOURCES = ("dialogue", "tool", "thinking")


def segment_text(part: Column, limit: int | None = SEGMENT_CHARS) -> Column:
    """The searchable text of a message part.

    Of longer results and summaries of tools head and tail are kept, of text and thinking
    the head; without a limit every part is whole.
    """
    bounded = (lambda c: c) if limit is None else (lambda c: head_and_tail(c, limit))
    text = (
        F.when(part["kind"] == "tool_use", bounded(tool_summary(part["name"], part["input"])))
        .when(part["kind"] == "tool_result", bounded(part["content"]))
        .otherwise(head(part["text"], limit))
    )
    return F.coalesce(text, F.lit(""))


def segments(rows: DataFrame, limit: int | None = SEGMENT_CHARS) -> DataFrame:
    """Messages with their searchable segments and the body they make up.

    Adds ``segments`` (``text, normal, source`` as rank, ``tools, tool_results, thinking`` and
    the offsets of the segment in bytes and characters) and ``body``, the segments'
    texts joined by line ends. Messages without a segment are left out.
    """
    kind = lambda p, k: F.coalesce(p["kind"] == k, F.lit(False))
    raw = F.transform(
        F.coalesce("parts", F.array().cast(rows.schema["parts"].dataType)),
        lambda p: F.struct(
            segment_text(p, limit).alias("text"),
            F.when(kind(p, "thinking"), 2).when(kind(p, "tool_use") | kind(p, "tool_result"), 1).otherwise(0).alias("source"),
            kind(p, "tool_use").alias("tools"),
            kind(p, "tool_result").alias("tool_results"),
            kind(p, "thinking").alias("thinking"),
        ),
    )
    texts = F.transform(F.filter(raw, lambda s: ~is_blank(s["text"])), lambda s: s.withField("normal", normalize(s["text"])))
    kept = held(rows.withColumn("segments", texts), F.size("segments") > 0)
    start = lambda measure: F.aggregate(
        "segments",
        F.array().cast("array<int>"),
        lambda acc, s: F.array_append(acc, F.when(F.size(acc) == 0, 0).otherwise(F.element_at(acc, -1)) + measure(s["text"]) + 1),
    )
    kept = kept.withColumn("_bytes", start(F.octet_length)).withColumn("_chars", start(F.length))
    at = lambda ends, i: F.when(i == 0, 0).otherwise(F.get(F.col(ends), i - 1))
    return (
        kept.withColumn("segments", F.transform("segments", lambda s, i: s.withField("byte", at("_bytes", i)).withField("char", at("_chars", i))))
        .withColumn("body", F.array_join(F.transform("segments", lambda s: s["text"]), "\n"))
        .drop("_bytes", "_chars")
    )


def _word_span(word: str):
    """A word's match covers its whole segment."""

    def span(s: Column) -> Column:
        return F.when(
            word_matches(s["normal"], word),
            F.struct(
                s["byte"].alias("b0"),
                (s["byte"] + F.octet_length(s["text"])).alias("b1"),
                s["char"].alias("c0"),
                (s["char"] + F.length(s["text"])).alias("c1"),
            ),
        )

    return span


def _literal_span(literal: str):
    """From the first to the last occurrence of a literal in a segment."""
    needle = literal if is_sensitive(literal) else literal.lower()

    def span(s: Column) -> Column:
        text = s["text"] if is_sensitive(literal) else fold_case(s["text"])
        around = F.split(text, quote(needle), -1)
        first, last = F.element_at(around, 1), F.element_at(around, -1)
        return F.when(
            F.contains(text, F.lit(needle)),
            F.struct(
                (s["byte"] + F.octet_length(first)).alias("b0"),
                (s["byte"] + F.octet_length(text) - F.octet_length(last)).alias("b1"),
                (s["char"] + F.length(first)).alias("c0"),
                (s["char"] + F.length(text) - F.length(last)).alias("c1"),
            ),
        )

    return span


def _may_hold(text: str) -> Column:
    """False only for messages none of whose parts can hold ``text`` (in lower case).

    Literals may run over the end of a part, so they are looked for piece by piece;
    results above a segment's size always may, as their head and tail meet.
    """
    pieces = [F.lit(p) for p in text.split("\n") if p]
    longest = max(text.split("\n"), key=len)
    if not pieces:
        return F.lit(True)
    fields = ("text", "content", "name", "input")

    def holds(p: Column) -> Column:
        out = F.contains(F.lit("tool input_keys=,"), F.lit(longest))
        for f in fields:
            out = out | F.contains(fold_case(p[f]), F.lit(longest)) | (F.length(p[f]) > SEGMENT_CHARS)
        # A tool's summary is put together from its name and keys.
        return out | (p["kind"] == "tool_use") if any(c in longest for c in " =,_") else out

    return F.coalesce(F.exists("parts", lambda p: F.coalesce(holds(p), F.lit(False))), F.lit(False))


def _any(flag: str) -> Column:
    return F.exists("_touched", lambda s: s[flag])


def hits(rows: DataFrame, query: str | ParsedQuery, radius: int = 1, limit: int | None = SEGMENT_CHARS) -> DataFrame:
    """Messages that hold all words and literals of the query, with scores and ranges.

    ``rows`` are messages of :func:`delivery.delivered`, or others with an ordinal; a column
    ``timestamp``, the time of the conversation, goes along. ``limit`` bounds the characters of a segment; without it
    parts of any length are searched whole.

    ``conv_ref, ordinal, score, source, preview, focus, read, tools, tool_results,
    thinking, subagents``. A score is 4 a distinct term, 3 a literal, 2 a pair of words
    side by side, and the inverse of the bytes the matches span. ``read`` is the focus
    and ``radius`` messages around it, inside the conversation.

    All words must match in one message; an empty query finds nothing.
    """
    if "message_count" not in rows.columns:
        rows = rows.join(rows.groupBy("conv_ref").agg(F.max("ordinal").alias("message_count")), "conv_ref")
    q = parse(query) if isinstance(query, str) else query
    words, literals = ([], list(q.literals)) if q.quoted_only else (q.words, q.required)
    if not words and not literals:
        words = ["\0"]  # nothing holds it
    # Most messages fail cheap tests on their raw parts, before any segment is built.
    likely = rows.where(all_of([_may_hold(w) for w in words] + [_may_hold(x.lower()) for x in literals]))
    parts = segments(likely, limit).withColumn("normal", F.array_join(F.transform("segments", lambda s: s["normal"]), " "))
    found = held(parts, all_of([has_literal(F.col("body"), x) for x in literals] + [word_matches(F.col("normal"), w) for w in words]))
    spans = [F.transform("segments", _word_span(w)) for w in words]
    spans += [F.transform("segments", _literal_span(x)) for x in literals]
    found = found.withColumn("_terms", F.array(*spans))
    flat = F.filter(F.flatten("_terms"), lambda x: x.isNotNull())
    found = held(found.withColumn("_spans", flat), F.size("_spans") > 0)
    matched = F.size(F.filter("_terms", lambda t: F.exists(t, lambda x: x.isNotNull())))
    touched = F.filter(F.transform("segments", lambda s, i: F.when(F.exists("_terms", lambda t: F.get(t, i).isNotNull()), s)), lambda s: s.isNotNull())
    found = found.withColumn("_touched", touched)
    low = lambda k: F.array_min(F.transform("_spans", lambda x: x[k]))
    high = lambda k: F.array_max(F.transform("_spans", lambda x: x[k]))
    pairs = sum((F.contains("normal", F.lit(f"{a} {b}")).cast("int") for a, b in zip(words, words[1:])), F.lit(0))
    score = matched * 4.0 + F.lit(3.0 * len(literals)) + pairs * 2.0 + 1.0 / F.greatest(high("b1") - low("b0"), F.lit(1))
    begin = F.greatest(low("c0") - 41, F.lit(0))
    preview = F.left(squeeze(F.substring(F.col("body"), begin + 1, high("c1") + 80 - begin)), F.lit(160))
    scored = found.select(
        "conv_ref",
        "ordinal",
        score.alias("score"),
        F.element_at(F.array(*map(F.lit, SOURCES)), F.array_min(F.transform("_touched", lambda s: s["source"])) + 1).alias("source"),
        preview.alias("preview"),
        low("b0").alias("first_offset"),
        *[_any(o).alias(o) for o in ("tools", "tool_results", "thinking")],
        (~is_blank("parent_tool_use_id")).alias("subagents"),
        "message_count",
        (F.col("timestamp") if "timestamp" in rows.columns else F.lit(None).cast("timestamp")).alias("timestamp"),
    )
    return scored.select(
        "conv_ref",
        "ordinal",
        "score",
        "source",
        "preview",
        F.struct(F.col("ordinal").alias("start"), F.col("ordinal").alias("end")).alias("focus"),
        F.struct(F.greatest(F.col("ordinal") - radius, F.lit(1)).alias("start"), F.least(F.col("ordinal") + radius, F.col("message_count")).alias("end")).alias("read"),
        "tools",
        "tool_results",
        "thinking",
        "subagents",
        "first_offset",
        "timestamp",
    )


def _best_first(*before: Column) -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return [F.col("score").desc(), *before, F.col("ordinal"), rank, F.col("first_offset")]


def best_hits(found: DataFrame, limit: int) -> DataFrame:
    """The hits in their total order, cut: score, newer conversation, ref, place."""
    return found.orderBy(*_best_first(F.col("timestamp").desc_nulls_last(), F.col("conv_ref"))).limit(limit)


def best_in_conversation(found: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` hits of each conversation, the best; no conversation is left out."""
    order = Window.partitionBy("conv_ref").orderBy(*_best_first())
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")
