"""Ranked search over conversations: lexical, exact and browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.labels import freshness
from threadloom.functions.matching import adjacent_count, all_of, fold_case, has_cjk, has_literal, has_prefix, prefix_count
from threadloom.plans.query import ParsedQuery, parse
from threadloom.session import held

# Weight of a field, most occurrences of a word, most adjacent pairs.
WEIGHTS = {"title": 5.0, "project": 4.0, "summary": 3.0, "body": 1.0}
WORD_CAP, PAIR_CAP = 10, 3


def field_score(col: Column, weight: float, words: list[str]) -> tuple[Column, Column]:
    """Weighted saturated word counts, and the weighted bonus for words side by side."""
    counts = [prefix_count(col, w, WORD_CAP) for w in words]
    tf = sum((F.log(1 + c.cast("double")) for c in counts), F.lit(0.0)) * weight
    pairs = adjacent_count(col, words, PAIR_CAP) * (2.0 * weight) if len(words) > 1 else F.lit(0.0)
    return tf, pairs


def search(corpus: DataFrame, query: str | ParsedQuery, now: Column, top: int | None = None, debug: bool = False) -> DataFrame:
    """Conversations that hold all words (as prefixes) and all literals, best first.

    An empty query browses: everything, newest first. A query of literals only is
    exact: newest first. Otherwise the score is the sum over the fields plus freshness;
    if a word matches nowhere as a prefix, a query with CJK words still accepts
    substrings, at a flat score. Cheap substring tests stand in a filter of their own
    before any counting.
    """
    q = parse(query) if isinstance(query, str) else query
    fresh = freshness(F.col("mtime"), now)
    words, literals = ([], list(q.literals)) if q.quoted_only else (q.words, q.required)
    found = corpus.where(all_of([has_literal(F.col("literal_text"), x) for x in literals])) if literals else corpus
    if not words:
        out = found.withColumn("freshness", fresh).withColumn("score", F.col("freshness"))
        order = [F.col("mtime").desc_nulls_last(), F.col("conv_ref")]
    else:
        # Words hold no separators, so the raw text in lower case decides; it is cheaper.
        raw = fold_case(F.col("literal_text"))
        found = found.where(all_of([F.contains(raw, F.lit(w)) for w in words]))
        prefixed = all_of([has_prefix(F.col("text_l"), w) for w in words])
        cjk = any(has_cjk(w) for w in words)
        parts = {name: field_score(F.col(f"{name}_l"), weight, words) for name, weight in WEIGHTS.items()}
        total = sum((tf + pairs for tf, pairs in parts.values()), F.lit(0.0))
        if cjk:
            total = F.when(prefixed, total).otherwise(0.5 * len(words))
        else:
            found = held(found, prefixed)
        out = found.withColumn("freshness", fresh)
        if debug:
            for name, (tf, pairs) in parts.items():
                out = out.withColumn(f"{name}_tf", tf).withColumn(f"{name}_adjacent", pairs)
        out = out.withColumn("score", total + F.col("freshness"))
        order = [F.col("score").desc(), F.col("mtime").desc_nulls_last(), F.col("conv_ref")]
    extra = [f"{n}_{k}" for n in WEIGHTS for k in ("tf", "adjacent")] if debug and words else []
    out = out.select("conv_ref", "path", "project_name", "title", "mtime", "freshness", *extra, "score")
    return out.orderBy(*order).limit(top) if top is not None else out


def shortlist_size(top: int) -> int:
    """How many conversations are looked at for messages."""
    return max(50, min(500, 5 * top))


def candidate_limit(top: int, per_conversation: int) -> int:
    return max(top, top * max(1, per_conversation) * 4)
