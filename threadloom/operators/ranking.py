"""Fusion of ranked lists and grouping of hits by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.session import cut_lineage

#: Constant of reciprocal-rank fusion (fixed value).
RRF_K = 60
#: A message that tools write by themselves (fixed value).
BOILERPLATE = ("The file ", " has been updated successfully.")


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two lists of ``conv_ref, focus, rank`` (``exact`` in the first).

    Hits meet if conversation and focus are equal. A focus that comes several times in
    the semantic list counts with its last rank and as hybrid. ``score`` is the sum of
    1 / (60 + rank).
    """
    left = lexical.select("conv_ref", "focus", F.col("rank").alias("lexical_rank"), "exact")
    right = semantic.groupBy("conv_ref", "focus").agg(F.max("rank").alias("semantic_rank"), F.count(F.lit(1)).alias("times"))
    joined = left.join(right, ["conv_ref", "focus"], "full_outer")
    share = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (RRF_K + F.col(c))).otherwise(0.0)
    both = F.col("semantic_rank").isNotNull() & (F.col("lexical_rank").isNotNull() | (F.col("times") > 1))
    out = joined.select(
        "conv_ref",
        "focus",
        "lexical_rank",
        "semantic_rank",
        (share("lexical_rank") + share("semantic_rank")).alias("score"),
        F.when(both, "hybrid").when(F.col("lexical_rank").isNull(), "semantic").when(F.col("exact"), "exact").otherwise("lexical").alias("source"),
        F.when(F.coalesce("exact", F.lit(False)), 0).when(F.col("lexical_rank").isNotNull(), 1).otherwise(2).alias("priority"),
    )
    return out.orderBy(F.col("score").desc(), "priority", "conv_ref", "focus.start").limit(limit) if limit is not None else out


def top_per_conversation(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each conversation, without merging."""
    evidence = F.array_position(F.array(F.lit("dialogue"), F.lit("tool"), F.lit("thinking")), F.col("source"))
    w = Window.partitionBy("conv_ref").orderBy(F.floor(F.col("score") * 10).desc(), evidence, F.col("score").desc(), "ordinal")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def until_conversations(ranked: DataFrame, top: int) -> DataFrame:
    """Hits in rank order until the first hit of the ``top``-th conversation.

    ``ranked`` is a bounded result list with a column ``rank``.
    """
    first = (F.row_number().over(Window.partitionBy("conv_ref").orderBy("rank")) == 1).cast("int")
    seen = F.coalesce(F.sum("_first").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("_first", first).withColumn("_seen", seen).where(F.col("_seen") < top).drop("_first", "_seen")


_FLAGS = ("tools", "tool_results", "thinking", "subagents")
_EVIDENCE = {"dialogue": 0, "tool": 1, "thinking": 2}
_KIND = {"exact": 0, "lexical": 1, "hybrid": 2, "semantic": 3}


def fold_hits(rows: list[dict], keep: int, all_hits: bool = False) -> list[dict]:
    """The fold over one conversation's hits in their order.

    A duplicate (same focus, same preview, or both the boilerplate of an update) is
    merged into the hit kept before: flags are or-ed, ranges united, the higher score
    stays. After each new hit the list is sorted and cut, so a duplicate of a hit that
    was cut counts as new.
    """
    kept: list[dict] = []
    plain = lambda p: p.startswith(BOILERPLATE[0]) and p.endswith(BOILERPLATE[1])

    def order(h):
        return (-int(h["score"] * 10 // 1), _EVIDENCE.get(h["source"], 0), -h["score"], h["focus_start"], _KIND.get(h.get("kind", "lexical"), 1))

    for row in rows:
        twin = None
        if not all_hits:
            twin = next((h for h in kept if (h["focus_start"], h["focus_end"]) == (row["focus_start"], row["focus_end"]) or h["preview"] == row["preview"] or (plain(h["preview"]) and plain(row["preview"]))), None)
        if twin:
            for f in _FLAGS:
                twin[f] = bool(twin[f]) or bool(row[f])
            twin["read_start"], twin["read_end"] = min(twin["read_start"], row["read_start"]), max(twin["read_end"], row["read_end"])
            twin["score"] = max(twin["score"], row["score"])
            continue
        kept = sorted([*kept, dict(row)], key=order)[:keep]
    return sorted(kept, key=order)[:keep]


_GROUPED = (
    "conv_ref string, group_score double, total_hits int, hit int, ordinal int, score double, source string, preview string, "
    "focus_start int, focus_end int, read_start int, read_end int, tools boolean, tool_results boolean, thinking boolean, subagents boolean"
)


def group_hits(hits: DataFrame, per_conversation: int = 2, all_hits: bool = False) -> DataFrame:
    """Hits grouped by conversation with duplicates merged; one row per kept hit.

    ``hits`` holds a bounded number of hits of each conversation (see
    ``messages.best_in_conversation``), so a group never holds more than that;
    ``total_hits`` counts them.
    """
    flat = hits.select(
        "conv_ref", "ordinal", "score", "source", "preview", F.col("focus.start").alias("focus_start"), F.col("focus.end").alias("focus_end"),
        F.col("read.start").alias("read_start"), F.col("read.end").alias("read_end"), *_FLAGS, "first_offset",
    )

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["score", "ordinal", "first_offset"], ascending=[False, True, True])
        kept = fold_hits(ordered.to_dict("records"), per_conversation, all_hits)
        out = pd.DataFrame(kept).drop(columns="first_offset")
        out["hit"], out["total_hits"], out["group_score"] = range(1, len(out) + 1), len(group), out["score"].max()
        return out[[c.split()[0] for c in _GROUPED.split(", ")]]

    return flat.groupBy("conv_ref").applyInPandas(fold, _GROUPED)


def best_groups(grouped: DataFrame, top: int) -> DataFrame:
    """The hits of the ``top`` groups by score, then by conversation."""
    grouped = cut_lineage(grouped, "groups")  # a few rows a conversation, so that the fold in Python runs once
    leaders = grouped.where(F.col("hit") == 1).orderBy(F.col("group_score").desc(), "conv_ref").limit(top).select("conv_ref")
    return grouped.join(leaders, "conv_ref", "left_semi")


def output_lines(groups: list[dict], query: str, mode: str, titles: dict[str, str]) -> Iterator[str]:
    """The text form of grouped results; ``groups`` are the rows of :func:`best_groups`."""
    from urllib.parse import quote as percent

    atom = lambda s: percent(s, safe="._~:/+-")
    cut = lambda s, n: (lambda t: t if len(t) <= n else t[: n - 3] + "...")(" ".join(s.split()))
    refs = list(dict.fromkeys(g["conv_ref"] for g in sorted(groups, key=lambda g: (-g["group_score"], g["conv_ref"], g["hit"]))))
    yield f"protocol agent-search v=2 mode={mode} groups={len(refs)} hits={len(groups)}"
    yield f"query text={atom(query)} hits={len(groups)}"
    yield f"groups count={len(refs)}"
    for n, ref in enumerate(refs, 1):
        mine = sorted((g for g in groups if g["conv_ref"] == ref), key=lambda g: g["hit"])
        yield f"conversation rank={n} ref={atom(ref)} score={mine[0]['group_score']:.6f} hits={len(mine)} total={mine[0]['total_hits']} | {cut(titles.get(ref, ''), 240)}"
        for g in mine:
            source = g["source"] if g["source"] != "dialogue" else mode
            flags = "".join(f" {f.replace('_', '-')}=true" for f in _FLAGS if g[f])
            yield f"hit ref={atom(ref)} source={source} score={g['score']:.6f} focus=m{g['focus_start']}..m{g['focus_end']} | {cut(g['preview'], 500)}"
            yield f"read ref={atom(ref)}:m{g['read_start']}..m{g['read_end']} focus=m{g['focus_start']}..m{g['focus_end']}{flags}"
