"""Transcripts as streams.

A file stream remembers paths, so it never sees that a file grew. Two ways around:
``grown_lines`` reads the growing files in a listing-driven batch and keeps, per file,
how many lines it has delivered; ``message_stream`` takes lines from any stream and
keeps the state of each conversation in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from threadloom.session import cut_lineage, forget
from threadloom.sources import jsonl
from threadloom.sources.manifest import Store, read_changed


def grown_lines(spark: SparkSession, root: str, store: Store) -> DataFrame:
    """Lines appended since the last call, with physical line numbers.

    The store holds ``path, file_size, mtime, delivered``. Files are listed, and only those
    that changed are opened. A last line without its line end may still be growing; it is
    delivered as it is, and again only if lines follow it.
    """
    files = cut_lineage(jsonl.list_files(spark, root).select("path", "file_size", "mtime"), "files")
    held = store.read()
    lines = read_changed(spark, root, files, held)
    new = lines
    if held is not None:
        seen = lines.join(held.select("path", "delivered"), "path", "left")
        new = seen.where(F.col("line_no") > F.coalesce("delivered", F.lit(0))).drop("delivered")
    out = cut_lineage(new, "lines")
    upto = out.groupBy("path").agg(F.max("line_no").alias("_now"))
    before = files.withColumn("delivered", F.lit(0)) if held is None else files.join(held.select("path", "delivered"), "path", "left")
    now = before.join(upto, "path", "left").select("path", "file_size", "mtime", F.coalesce("_now", "delivered", F.lit(0)).alias("delivered"))
    store.write(now)
    forget(files)
    return out


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New transcript files as a stream of lines; for transcripts that are complete when they appear."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.jsonl")
    files = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return jsonl._numbered(
        files.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.regexp_replace("value", "\n\\z", "").alias("value"),
        )
    )


def into(stream: DataFrame, checkpoint: str, write, once: bool = True):
    """Starts ``write(batch, number)`` on every micro-batch; with ``once`` what is there is taken and the query ends."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


_OUT = "conv_ref string, jsonl_line long, assistant_message_id string, ordinal int, is_repeat boolean"
_STATE = "next int, ids array<string>, ordinals array<int>"


def _number(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Ordinals in order of arrival; lines of one answer share the first one's."""
    nxt, ids, ordinals = state.get if state.exists else (1, [], [])
    known = dict(zip(ids, ordinals))
    for batch in batches:
        batch = batch.sort_values("jsonl_line")
        numbers, repeats = [], []
        for ident in batch["assistant_message_id"]:
            ident = ident.strip() if isinstance(ident, str) and ident.strip() else None
            if ident in known:
                numbers.append(known[ident])
                repeats.append(True)
                continue
            if ident:
                known[ident] = nxt
            numbers.append(nxt)
            repeats.append(False)
            nxt += 1
        yield batch.assign(ordinal=numbers, is_repeat=repeats)[[c.split()[0] for c in _OUT.split(", ")]]
    state.update((nxt, list(known), list(known.values())))


def message_stream(lines: DataFrame) -> DataFrame:
    """Numbers messages of a stream of ``conv_ref, jsonl_line, assistant_message_id``."""
    keyed = lines.select("conv_ref", F.col("jsonl_line").cast("long").alias("jsonl_line"), "assistant_message_id").where(F.col("conv_ref").isNotNull())
    return keyed.groupBy("conv_ref").applyInPandasWithState(_number, _OUT, _STATE, "append", "NoTimeout")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type of an event stream, closed by a watermark."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
