"""Search end to end: a shortlist of conversations, their messages, chunks, and both fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.operators import lexical, messages, ranking, semantic
from threadloom.plans.query import ParsedQuery, as_exact, parse

#: Sources of chunks (fixed values).
VISIBLE, SUBAGENT = "visible_dialogue", "agent_subagent_dialogue"
#: Kinds of hits in the order of output (fixed values).
KINDS = ("exact", "lexical", "hybrid", "semantic")


def shortlist(corpus: DataFrame, query: str | ParsedQuery, now: Column, top: int) -> DataFrame:
    """``conv_ref, rank``: the conversations whose messages are looked at; 500 at most."""
    best = lexical.search(corpus, query, now, top=lexical.shortlist_size(top))
    order = Window.orderBy(F.col("score").desc(), F.col("mtime").desc_nulls_last(), "conv_ref")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("conv_ref").agg(F.min("rank").alias("rank"))


def until_enough(found: DataFrame, listed: DataFrame, top: int) -> DataFrame:
    """The hits of the first ``top`` conversations of the shortlist that have any.

    Conversations behind these are never asked by a search that stops early.
    """
    with_hits = listed.join(found.select("conv_ref").distinct(), "conv_ref", "left_semi")
    first = with_hits.orderBy("rank").limit(top).select("conv_ref")
    return found.join(F.broadcast(first), "conv_ref", "left_semi")  # at most top rows


def message_hits(corpus: DataFrame, rows: DataFrame, query: str, now: Column, top: int, per_conversation: int = 2, exact: bool = False) -> DataFrame:
    """Hits in messages of the shortlisted conversations, with ``kind`` and ``rank``."""
    q = parse(query)
    q = as_exact(query) if exact and not q.quoted_only else q
    listed = shortlist(corpus, q, now, top)
    inside = rows.join(F.broadcast(listed.select("conv_ref")), "conv_ref", "left_semi")  # 500 rows at most
    found = messages.best_in_conversation(messages.hits(inside, q), lexical.candidate_limit(top, per_conversation))
    kind = "exact" if exact or q.quoted_only else "lexical"
    return in_output_order(until_enough(found, listed, top).withColumn("kind", F.lit(kind)))


def in_output_order(found: DataFrame) -> DataFrame:
    """Adds ``rank`` to a bounded list: score, kind, conversation, place."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), kind, "conv_ref", "focus.start")))


def candidates(chunks: DataFrame, scope: DataFrame | None = None, subagents: bool = True) -> DataFrame:
    """Chunks of the dialogue and, with ``subagents``, of what subagents said.

    ``scope`` (``conv_ref, source``) keeps the chunks of these conversations and sources.
    """
    found = chunks.where(F.col("source") == VISIBLE)
    if subagents:
        found = found.unionByName(chunks.where(F.col("source") == SUBAGENT))
    return found if scope is None else found.join(scope.select("conv_ref", "source").distinct(), ["conv_ref", "source"], "left_semi")


def chunk_hits(chunks: DataFrame, vector: list[float], query: str, limit: int | None) -> DataFrame:
    """The best chunk of each conversation as hits, with ``kind`` and ``rank``."""
    best = semantic.rank(chunks, vector, query).where(F.col("m_start").isNotNull())
    # Equal to nine digits is equal: sums of products differ in their last bits.
    best = best.withColumn("score", F.round("hybrid", 9)).withColumn("kind", F.lit("semantic"))
    best = best.withColumn("focus", F.struct(F.col("m_start").alias("start"), F.col("m_end").alias("end")))
    if limit is not None:
        best = best.orderBy(F.col("score").desc(), "conv_ref", "focus.start").limit(limit)
    return in_output_order(best)


def hybrid(corpus: DataFrame, rows: DataFrame, chunks: DataFrame, query: str, vector: list[float], now: Column, top: int = 10, per_conversation: int = 2, scope: DataFrame | None = None) -> DataFrame:
    """Both lists fused and joined with their conversations.

    ``conv_ref, title, focus, lexical_rank, semantic_rank, score, source, subagents``. Lists
    hold ``candidate_limit`` hits at most.
    """
    limit = lexical.candidate_limit(top, per_conversation)
    lex = message_hits(corpus, rows, query, now, top, per_conversation).where(F.col("rank") <= limit)
    sem = chunk_hits(candidates(chunks, scope), vector, query, limit)
    fused = ranking.fuse(lex.select("conv_ref", "focus", "rank", (F.col("kind") == "exact").alias("exact")), sem.select("conv_ref", "focus", "rank"))
    agents = sem.where(F.col("source") == SUBAGENT).select("conv_ref", "focus", F.lit(True).alias("_sub")) if "source" in sem.columns else None
    if agents is not None:
        fused = fused.join(agents.distinct(), ["conv_ref", "focus"], "left").withColumn("subagents", F.coalesce("_sub", F.lit(False))).drop("_sub")
    titles = corpus.groupBy("conv_ref").agg(F.max_by("title", F.struct("mtime", "path")).alias("title"))
    return fused.join(titles, "conv_ref")
