"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import contamination, conversations, mixing, neighbours, privacy, reading, splitting
from threadloom.plans import delivery_queries
from threadloom.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    cut = splitting.pieces(table(spark, root, "cache_entries"))
    return cut.where(F.col("piece") == 1).select(F.col("entry").alias("entry_id"), F.col("turn").alias("turn_no"), "range_start")


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces(table(spark, root, "cache_entries"))


def p1_joined(spark: SparkSession, root: str) -> DataFrame:
    """Every cut turn put together again without its overlaps, and if all limits hold."""
    cut = splitting.pieces(table(spark, root, "cache_entries"))
    # Overlaps are counted in bytes of UTF-8, so they are dropped from the bytes.
    pieces = cut.groupBy("entry", "turn").agg(F.array_sort(F.collect_list(F.struct("piece", "overlap_bytes", "text"))).alias("ps"), F.max("piece_bytes").alias("most"), F.max("overlap_bytes").alias("overlap"))
    joined = F.array_join(F.transform("ps", lambda p: F.decode(F.substring(F.encode(p["text"], "UTF-8"), p["overlap_bytes"] + 1, F.octet_length(p["text"])), "UTF-8")), "")
    return pieces.select(
        F.col("entry").alias("entry_id"), F.col("turn").alias("turn_no"), F.octet_length(joined).alias("bytes"), F.md5(joined).alias("digest"),
        ((F.col("most") <= 2400) & (F.col("overlap") <= 600)).alias("fits"),
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return conversations.dropped(table(spark, root, "messages")).select(F.col("conv").alias("conv_ref"))


def p5_conversations(spark: SparkSession, root: str) -> DataFrame:
    return conversations.conversations(table(spark, root, "messages"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return privacy.mentions(table(spark, root, "cache_entries"))


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    return privacy.redacted(table(spark, root, "cache_entries"))


def _chunk_vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select(F.col("chunk_id").alias("id"), "embedding")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.pairs(neighbours.neighbours(_chunk_vectors(spark, root)))


def p4_recall(spark: SparkSession, root: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all others, exactly, and what the index found of them.

    ``queries`` is their number, ``enough`` if at least nine tenths of their five best
    were found. The exact search is a product of these with every block of vectors.
    """
    vectors = _chunk_vectors(spark, root)
    units = neighbours.unit_vectors(vectors)
    asked = units.where(F.col("id") % 100 == 0)
    found = neighbours.neighbours(vectors).where(F.col("id") % 100 == 0)
    exact = neighbours.exact(asked, units)
    # Copies are equally near, so a neighbour as similar as the fifth best is right.
    least = exact.groupBy("id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    right = found.join(least, "id").where(F.col("similarity") >= F.col("least") - 2e-5).groupBy("id").agg(F.count(F.lit(1)).alias("right"))
    both = least.join(right, "id", "left").agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.coalesce("right", F.lit(0))) / F.sum("n")).alias("recall"))
    return both.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_leaks(spark, root).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, root: str) -> DataFrame:
    return contamination.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p7_sources(spark: SparkSession, root: str) -> DataFrame:
    """Per target source: its documents, and if the mix keeps to its repeats and its share."""
    documents, targets = table(spark, root, "documents"), table(spark, root, "mix_targets")
    chosen, report = mixing.mix(documents, targets)
    most = chosen.groupBy("source").agg(F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    caps = mixing.targets(targets).select("source", "max_repeats")
    near = F.abs(F.col("taken") - F.col("budget")) <= F.coalesce("longest", F.lit(0))
    return report.join(most, "source", "left").join(caps, "source").select(
        "source", "documents", F.round("target_share", 9).alias("target_share"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("within_budget")
    )


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_levels(spark, root).where(F.col("level") >= 4).select("doc_id")


def p8_levels(spark: SparkSession, root: str) -> DataFrame:
    return reading.reading_levels(table(spark, root, "documents"), table(spark, root, "reading_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_joined": p1_joined,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_conversations": p5_conversations,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_sources": p7_sources,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

_TURNS = r"""t AS (
          SELECT entry_id, unnest(semantic_turns) AS turn, generate_subscripts(semantic_turns, 1) AS turn_no, semantic_turn_ranges AS r
          FROM cache_entries),
        large AS (
          SELECT *, regexp_replace(turn, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS bare FROM t
          WHERE strlen(regexp_replace(turn, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 2400 AND turn_no <= len(r) AND r[turn_no] IS NOT NULL)"""
_BARE = r"nullif(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_SOURCE = r"regexp_replace(lower(" + _BARE.format("source") + r"), '[\s-]+', '_', 'g')"

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_TURNS} SELECT entry_id, CAST(turn_no AS INTEGER) AS turn_no, r[turn_no].start AS range_start FROM large",
    "p1_joined": f"WITH {_TURNS} SELECT entry_id, CAST(turn_no AS INTEGER) AS turn_no, strlen(bare)::INTEGER AS bytes, md5(bare) AS digest, true AS fits FROM large",
    "p4_recall": """SELECT count(*) AS queries, true AS enough FROM chunks
        WHERE chunk_id % 100 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p5_found": delivery_queries.LABELS
    + f""",
        kept AS (
          SELECT ranked.conv_ref, ranked.row_id, ranked.first_line, m.ordinal, lower({_BARE.format("m.role")}) AS role, {_BARE.format("m.parent_tool_use_id")} AS parent,
            len(list_filter(m.parts, lambda p: p.kind = 'text' AND {_BARE.format("p.text")} IS NOT NULL)) > 0 AS has_text,
            list_transform(list_filter(m.parts, lambda p: p.kind = 'tool_use' AND {_BARE.format("p.id")} IS NOT NULL), lambda p: {_BARE.format("p.id")}) AS calls
          FROM ranked JOIN messages m USING (row_id) WHERE rn = 1 AND ranked.conv_ref IS NOT NULL),
        lines AS (SELECT *, lead(first_line) OVER (PARTITION BY conv_ref ORDER BY ordinal, row_id) AS next_line FROM kept WHERE ordinal IS NOT NULL),
        falls AS (SELECT DISTINCT conv_ref FROM lines WHERE next_line IS NOT NULL AND next_line <= first_line),
        calls AS (SELECT DISTINCT conv_ref, unnest(calls) AS call FROM kept),
        orphans AS (SELECT DISTINCT kept.conv_ref FROM kept LEFT JOIN calls ON kept.conv_ref = calls.conv_ref AND kept.parent = calls.call WHERE parent IS NOT NULL AND call IS NULL),
        facts AS (
          SELECT conv_ref, count(*) AS n, count(ordinal) AS numbered, count(DISTINCT ordinal) AS different, min(ordinal) AS least, max(ordinal) AS most,
            bool_or(coalesce(role NOT IN ('user', 'assistant'), true)) AS bad_role,
            arg_min(coalesce(role, '?'), (coalesce(ordinal, first_line), row_id)) FILTER (parent IS NULL) AS opens,
            arg_max(coalesce(role, '?'), (coalesce(ordinal, first_line), row_id)) FILTER (parent IS NULL AND has_text) AS closes
          FROM kept GROUP BY conv_ref)
        SELECT conv_ref FROM facts
        WHERE bad_role OR (numbered > 0 AND (numbered < n OR different < numbered OR least <> 1 OR most <> numbered))
          OR (numbered > 0 AND conv_ref IN (SELECT conv_ref FROM falls)) OR conv_ref IN (SELECT conv_ref FROM orphans)
          OR coalesce(opens <> 'user', true) OR coalesce(closes <> 'assistant', true)""",
    # Passages of twelve words as letters, inside documents as letters.
    "p6_found": r"""WITH d AS (
          SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', chr(1), 'g'), '\]\([^()\s]+\)', ']', 'g'), '\\[nrtbf]', ' ', 'g') AS t
          FROM documents WHERE text IS NOT NULL),
        s AS (
          SELECT doc_id, regexp_replace(lower(regexp_replace(replace(replace(replace(t, '&shy;', ''), '&amp;', '&'), '&nbsp;', ' '), '\p{Cf}|\p{Mn}|\p{Me}', '', 'g')), '[^\p{L}\p{N}]+', '', 'g') AS letters
          FROM d),
        w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM eval_items),
        p AS (SELECT item_id, unnest(list_transform(range(1, len(words) - 10), lambda i: array_to_string(words[i:i + 11], ''))) AS passage FROM w)
        SELECT DISTINCT doc_id, item_id FROM s JOIN p ON contains(s.letters, p.passage)""",
    "p7_sources": f"""WITH d AS (SELECT {_SOURCE} AS source, count(*) AS documents FROM documents WHERE {_BARE.format("text")} IS NOT NULL GROUP BY ALL),
        t AS (SELECT {_SOURCE} AS source, sum(target_share) AS target_share FROM mix_targets WHERE target_share > 0 GROUP BY ALL)
        SELECT t.source, coalesce(d.documents, 0) AS documents, round(t.target_share, 9) AS target_share, true AS within_repeats, true AS within_budget
        FROM t LEFT JOIN d ON t.source = d.source WHERE t.source IS NOT NULL""",
}
