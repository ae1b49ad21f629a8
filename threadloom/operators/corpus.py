"""The conversation table that searches run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.labels import title
from threadloom.functions.matching import normalize
from threadloom.functions.paths import decode_path, project_root, short_name
from threadloom.functions.text import blank_to_null
from threadloom.plans.query import Ref


def current_entries(entries: DataFrame) -> DataFrame:
    """The newest version of every file: latest time, then larger, then higher id.

    Empty folds stay away. The rank's limit is applied before the shuffle, so a file
    with very many versions costs a row a task.
    """
    newest = Window.partitionBy("path").orderBy(F.col("mtime").desc_nulls_last(), F.col("file_size").desc_nulls_last(), F.col("entry_id").desc())
    return (
        entries.withColumn("_version", F.row_number().over(newest))
        .where(F.col("_version") == 1)
        .drop("_version")
        .where(~F.coalesce("is_empty", F.lit(False)))
    )


def join_filled(*columns: Column | str) -> Column:
    """The non-empty texts joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def searchable(entries: DataFrame, include_agents: bool = True) -> DataFrame:
    """Normalised text per field next to the raw text for literals.

    ``conv_ref, path, session_id, project_dir, project_name, mtime, title, title_l,
    summary_l, project_l, body_l, text_l, literal_text``.
    """
    agents = F.col("agent_search_text") if include_agents else F.lit(None).cast("string")
    project = short_name(F.coalesce("cwd", decode_path(F.col("project_dir"))))
    body = join_filled("full_text", agents)
    return entries.select(
        "conv_ref",
        "path",
        "session_id",
        "project_dir",
        project.alias("project_name"),
        "mtime",
        title(F.col("custom_title"), F.col("summary"), F.col("preview_first")).alias("title"),
        normalize(F.coalesce("custom_title", F.lit(""))).alias("title_l"),
        normalize(F.coalesce("summary", F.lit(""))).alias("summary_l"),
        normalize(F.coalesce(project, F.lit(""))).alias("project_l"),
        normalize(body).alias("body_l"),
        normalize(join_filled(body, project)).alias("text_l"),
        join_filled(body, project).alias("literal_text"),
    )


def in_workspace(table: DataFrame, project_dir: str) -> DataFrame:
    """Rows of the same main project, worktrees included."""
    return table.where(project_root(F.col("project_dir")) == F.lit(project_dir.split("--worktrees-")[0]))


def without_projects(table: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose project, or the part before its first slash, is not excluded; no project stays."""
    name = F.col("project_name")
    return table.where(name.isNull() | ~(name.isin(*names) | F.substring_index(name, "/", 1).isin(*names))) if names else table


def by_session(table: DataFrame, uuid: str) -> DataFrame:
    """All copies of one session."""
    return table.where(F.col("session_id") == blank_to_null(F.lit(uuid)))


def session_labels(table: DataFrame) -> DataFrame:
    """A session's label is its id, or its path where the id is unknown or not unique.

    Rows without an id take no part in the count, so they are no group of their own.
    """
    shared = table.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    marked = table.join(shared, "session_id", "left")
    unclear = F.col("session_id").isNull() | F.col("_n").isNotNull()
    return marked.withColumn("label", F.when(unclear, F.col("path")).otherwise(F.col("session_id"))).drop("_n")


def resolve_ref(table: DataFrame, ref: Ref) -> str:
    """The one conversation whose ref begins like ``ref``; none or several are an error."""
    found = [r[0] for r in table.where(F.startswith("conv_ref", F.lit(f"ch_{ref.prefix}"))).select("conv_ref").distinct().limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"ch_{ref.prefix} is {'ambiguous' if found else 'unknown'}")
    return found[0]


def selected(table: DataFrame) -> DataFrame:
    """``{"sessionId", "sessionPath"}`` of each row as JSON."""
    return table.select("conv_ref", F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.col("path").alias("sessionPath"))).alias("json"))


def signature(entries: DataFrame) -> DataFrame:
    """A digest per conversation row of all that its chunks depend on."""
    parts = F.to_json(F.struct("path", "semantic_turns", "semantic_turn_ranges"), {"ignoreNullFields": "false"})
    return entries.select("conv_ref", "path", F.sha2(parts, 256).alias("signature"))


def list_projects(entries: DataFrame) -> DataFrame:
    """Projects with at least one transcript, the latest first."""
    return entries.groupBy("project_dir").agg(F.max("mtime").alias("latest"), F.count(F.lit(1)).alias("transcripts")).orderBy(F.col("latest").desc_nulls_last(), "project_dir")
