"""Registered queries of the delivery operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.operators import delivery
from threadloom.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return delivery.extra_copies(table(spark, root, "messages"))


def p2_delivered(spark: SparkSession, root: str) -> DataFrame:
    """What each message came to: its kept row, first line and number of copies."""
    kept = delivery.deliver(table(spark, root, "messages"))
    return kept.select(F.col("conv").alias("conv_ref"), F.col("row").alias("row_id"), F.col("line").alias("jsonl_line"), "first_line", "copies")


QUERIES = {"p2_found": p2_found, "p2_delivered": p2_delivered}

#: Labels spread over shared lines and ids until nothing changes; USING KEY is not
#: needed because a label only ever falls.
LABELS = r"""
WITH RECURSIVE raw AS (
  SELECT row_id, conv_ref, jsonl_line AS line, batch_no,
         nullif(regexp_replace(assistant_message_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS id
  FROM messages),
rep AS (SELECT conv_ref, line, min(id) AS a, unnest(list_distinct(list(id))) AS b FROM raw WHERE id IS NOT NULL GROUP BY conv_ref, line),
link AS (SELECT DISTINCT conv_ref, a, b FROM rep WHERE a <> b UNION SELECT DISTINCT conv_ref, b, a FROM rep WHERE a <> b),
reach AS (
  SELECT DISTINCT conv_ref, a AS v, a AS w FROM link
  UNION
  SELECT reach.conv_ref, reach.v, link.b FROM reach JOIN link ON reach.conv_ref = link.conv_ref AND reach.w = link.a),
root AS (SELECT conv_ref, v, min(w) AS r FROM reach GROUP BY conv_ref, v),
named AS (
  SELECT raw.*, coalesce(raw.id, first_rep.a) AS one
  FROM raw LEFT JOIN (SELECT DISTINCT conv_ref, line, a FROM rep) first_rep ON raw.conv_ref = first_rep.conv_ref AND raw.line = first_rep.line),
keyed AS (
  SELECT named.*, coalesce(root.r, named.one) AS k_id, CASE WHEN named.one IS NULL THEN named.line END AS k_line
  FROM named LEFT JOIN root ON named.conv_ref = root.conv_ref AND named.one = root.v),
ranked AS (
  SELECT *, row_number() OVER w AS rn, min(line) OVER g AS first_line, count(*) OVER g AS copies
  FROM keyed
  WINDOW w AS (PARTITION BY conv_ref, k_id, k_line ORDER BY line DESC, batch_no, row_id),
         g AS (PARTITION BY conv_ref, k_id, k_line))
"""

ORACLES = {
    "p2_found": LABELS + "SELECT row_id FROM ranked WHERE rn > 1",
    "p2_delivered": LABELS + "SELECT conv_ref, row_id, CAST(line AS BIGINT) AS jsonl_line, CAST(first_line AS BIGINT) AS first_line, copies FROM ranked WHERE rn = 1",
}
