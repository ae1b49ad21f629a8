"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage, forget


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and an order-free checksum of an edge set: equal sets, equal pair."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scope: str, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """The least member of every vertex's component, inside each ``scope``.

    ``edges`` holds pairs ``(scope, a, b)`` of one comparable type. The result has
    one row per vertex that occurs in an edge between two different vertices:
    ``(scope, vertex, root)`` with ``root`` the least vertex it is connected to.
    Edges with a null end and loops link nothing and vertices only seen in them do
    not appear; an empty edge table gives an empty result; repeated edges count
    once.

    Each round is one large-star and one small-star step (a minimum per vertex and
    an equi-join on the vertex), so no neighbourhood is ever gathered in a task and
    a chain of n vertices needs O(log^2 n) rounds. Rounds are cut by tables written
    to the shared folder.
    """
    cur = (
        edges.select(scope, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    cur = cut_lineage(cur, "components")
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(scope, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(scope, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, [scope, "u"])
            .where(F.col("v") > F.col("u"))
            .select(scope, F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") > F.col("v"))
            .distinct()
        )
        low = large.groupBy(scope, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [scope, "u"])
            .select(
                scope,
                F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"),
            )
            .select(scope, "e.u", "e.v")
            .where(F.col("u") > F.col("v"))
            .distinct()
        )
        before, cur = cur, cut_lineage(small, "components")
        forget(before)
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(scope, F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return cur.select(scope, F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
