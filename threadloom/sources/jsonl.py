"""Read append-only JSONL transcripts into lines, entries and parse errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.paths import decode_path, short_name
from threadloom.functions.text import is_blank

def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every transcript below ``root``, without its content: ``path, file_name, file_size, mtime``.

    Files are listed, not opened, so this costs the same however large they are.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    return files.where(~F.startswith("file_name", F.lit("agent-")))


def newest_files(files: DataFrame) -> DataFrame:
    """Listed files with their project's name and path, the latest first."""
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select("*", folder.alias("project_dir"), decode_path(folder).alias("project_path"), short_name(decode_path(folder)).alias("project_name")).orderBy(F.col("mtime").desc(), "path")


def read_lines(spark: SparkSession, root: str | list[str], recursive: bool = True) -> DataFrame:
    """Every physical line of every transcript below ``root``, or of a list of files, blank ones included.

    ``path, file_name, project_dir, session, file_size, mtime, line_no, raw``. A file
    is one transcript and is read by one task; files of agents are left out.
    """
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower())
    files = reader.text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.regexp_replace("value", "\n\\z", "").alias("value"),
    )
    return _numbered(files)


def no_lines(spark: SparkSession) -> DataFrame:
    schema = "path string, file_name string, project_dir string, session string, file_size long, mtime timestamp, line_no int, raw string"
    return spark.createDataFrame([], schema)


def _numbered(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return (
        files.where(~F.startswith("file_name", F.lit("agent-")))
        .select(
            "path",
            "file_name",
            F.element_at(parts, -2).alias("project_dir"),
            F.regexp_replace("file_name", r"\.jsonl\z", "").alias("session"),
            "file_size",
            "mtime",
            F.posexplode(F.split("value", "\r?\n")).alias("n", "raw"),
        )
        .select("path", "file_name", "project_dir", "session", "file_size", "mtime", (F.col("n") + 1).cast("int").alias("line_no"), "raw")
    )


def _get(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def _has(value: str, path: str) -> Column:
    """True if the JSON value has something other than null at ``path``."""
    return _get(value, path, "variant").isNotNull() & (F.schema_of_variant(_get(value, path, "variant")) != "VOID")


#: Fields an entry must have, by its type (fixed values); other types need none.
REQUIRED = {
    "user": ("$.message.role", "$.message.content"),
    "assistant": ("$.message.role", "$.message.content"),
    "summary": ("$.summary",),
    "custom-title": ("$.customTitle",),
    "ai-title": ("$.aiTitle",),
    "agent-name": ("$.agentName",),
    "progress": ("$.data",),
    "system": ("$.subtype",),
    "file-history-snapshot": ("$.messageId", "$.snapshot", "$.isSnapshotUpdate"),
}
#: Fields a content block must have, by its type (fixed values).
BLOCK_REQUIRED = {
    "text": ("text",),
    "tool_use": ("id", "name", "input"),
    "tool_result": ("tool_use_id",),
    "thinking": ("thinking", "signature"),
    "image": ("source",),
}

_BLOCK = "type string, text string, id string, name string, input variant, tool_use_id string, content variant, thinking string, signature string, source variant"


def blocks_of(content: Column) -> Column:
    """Content blocks of a message: an array as it is, a string as one text block."""
    as_blocks = F.try_variant_get(content, "$", "array<variant>")
    one = lambda v: F.struct(*[F.try_variant_get(v, f"$.{f.split()[0]}", f.split()[1]).alias(f.split()[0]) for f in _BLOCK.split(", ")])
    text = F.try_variant_get(content, "$", "string")
    plain = F.array(F.struct(*[(F.lit("text") if n == "type" else text if n == "text" else F.lit(None)).cast(k).alias(n) for n, k in (f.split() for f in _BLOCK.split(", "))]))
    return F.when(as_blocks.isNotNull(), F.transform(as_blocks, one)).when(text.isNotNull() & F.startswith(F.schema_of_variant(content), F.lit("STRING")), plain)


def _block_broken(b: Column) -> Column:
    checks = F.lit(False)
    for kind, fields in BLOCK_REQUIRED.items():
        lacks = F.lit(False)
        for f in fields:
            lacks = lacks | b[f].isNull()
        checks = checks | ((b["type"] == kind) & lacks)
    return F.coalesce(b["type"].isNull() | checks, F.lit(False))


def parse(lines: DataFrame) -> DataFrame:
    """Non-blank lines parsed to entries; ``error`` says why a line is none.

    Adds ``type, ts, cwd, parent_tool_use_id, msg_id, model, usage, blocks, title_value,
    progress_type, error``. Unknown types are entries, unknown block types are blocks; a
    missing required field makes the line an error, as bad JSON does.
    """
    parsed = lines.where(~is_blank("raw")).withColumn("entry", F.try_parse_json("raw"))
    parsed = parsed.withColumn("type", _get("entry", "$.type", "string"))
    content = F.coalesce(_get("entry", "$.message.content", "variant"), _get("entry", "$.data.message.message.content", "variant"))
    progress = (F.col("type") == "progress") & (_get("entry", "$.data.type", "string") == "agent_progress")
    is_message = F.col("type").isin("user", "assistant")
    parsed = parsed.withColumn("blocks", F.when(is_message | progress, blocks_of(content)))
    missing = F.lit(None).cast("string")
    for kind, paths in REQUIRED.items():
        for p in paths:
            missing = F.coalesce(missing, F.when((F.col("type") == kind) & ~F.coalesce(_has("entry", p), F.lit(False)), F.lit(f"missing field {p[2:]}")))
    shape = F.when(is_message & F.col("blocks").isNull(), "content is neither text nor blocks").when(
        (F.col("type") == "assistant") & _get("entry", "$.message.content", "array<variant>").isNull(), "content of an answer must be blocks"
    )
    broken = F.when(is_message & F.exists(F.coalesce("blocks", F.array().cast(parsed.schema["blocks"].dataType)), _block_broken), "a content block lacks a field")
    usage = lambda f: F.coalesce(_get("entry", f"$.message.usage.{f}", "bigint"), F.lit(0)).alias(f)
    fields = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return parsed.select(
        *lines.columns,
        "type",
        F.try_to_timestamp(_get("entry", "$.timestamp", "string")).alias("ts"),
        _get("entry", "$.cwd", "string").alias("cwd"),
        F.when(progress, F.coalesce(_get("entry", "$.data.agentId", "string"), F.lit("agent"))).otherwise(_get("entry", "$.parent_tool_use_id", "string")).alias("parent_tool_use_id"),
        _get("entry", "$.message.id", "string").alias("msg_id"),
        _get("entry", "$.message.model", "string").alias("model"),
        F.when(_has("entry", "$.message.usage"), F.struct(*[usage(f) for f in fields])).alias("usage"),
        "blocks",
        F.coalesce(_get("entry", "$.summary", "string"), _get("entry", "$.customTitle", "string"), _get("entry", "$.aiTitle", "string")).alias("title_value"),
        F.when(progress, _get("entry", "$.data.message.type", "string")).alias("progress_type"),
        F.when(F.col("entry").isNull(), "not JSON").when(F.col("type").isNull(), "missing field type").otherwise(F.coalesce(missing, shape, broken)).alias("error"),
    )


def parse_errors(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines that are no entries, with up to two lines before and after each.

    Line numbers are physical ones; blank lines count and appear in the context. The
    context is joined on, so files without errors are not sorted.
    """
    bad = entries.where(F.col("error").isNotNull()).select("path", "line_no", F.col("raw").alias("line_content"), F.col("error").alias("error_message"))
    near = bad.select("path", F.col("line_no").alias("bad_no"), F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])).alias("d")).withColumn("line_no", F.col("bad_no") + F.col("d"))
    context = (
        near.join(lines.select("path", "line_no", "raw"), ["path", "line_no"])
        .groupBy("path", F.col("bad_no").alias("line_no"))
        .agg(F.array_sort(F.collect_list(F.struct("d", "raw"))).alias("c"))
    )
    side = lambda before: F.coalesce(F.transform(F.filter("c", lambda x: (x["d"] < 0) if before else (x["d"] > 0)), lambda x: x["raw"]), F.array().cast("array<string>"))
    return bad.join(context, ["path", "line_no"], "left").select(
        "path", F.col("line_no").alias("line_number"), "line_content", "error_message", side(True).alias("context_before"), side(False).alias("context_after")
    )

