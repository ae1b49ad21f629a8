"""Incremental folds and embeddings: only what changed is computed again.

A store is a folder of versions; the current one is named in a small file that is
replaced by a rename, so readers see the old or the new version, never half of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.session import cut_lineage, drop_path, forget
from threadloom.sources import jsonl

#: Version of the layout; a store of another version is not read.
SCHEMA_VERSION = 1


class Store:
    """A table kept in versions below ``path``; ``key`` says what it was made with."""

    def __init__(self, spark: SparkSession, path: str, key: str = ""):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def read(self) -> DataFrame | None:
        """The current table; null if there is none of this layout and key."""
        fs, at = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(at):
            return None
        state = json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])
        if state["schema"] != SCHEMA_VERSION or state["key"] != self.key:
            return None
        return self.spark.read.parquet(f"{self.path}/{state['version']}")

    def write(self, df: DataFrame) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        jvm = self.spark._jvm
        fs, tmp = self._fs(f"{self.path}/.CURRENT-{version}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps({"version": version, "schema": SCHEMA_VERSION, "key": self.key}).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT"), options)
        return self.spark.read.parquet(f"{self.path}/{version}")

    def clear(self) -> None:
        drop_path(self.spark, self.path)


def changed_files(files: DataFrame, held: DataFrame | None) -> DataFrame:
    """Files whose size or time is not the one held; all of them without a store."""
    if held is None:
        return files
    same = ["path", "file_size", "mtime"]
    return files.join(held.select(*same).distinct(), same, "left_anti")


def read_changed(spark: SparkSession, root: str, files: DataFrame, held: DataFrame | None) -> DataFrame:
    """The lines of the files that are not held as they are; the others are not opened.

    Only names of changed files come to the driver.
    """
    if held is None:
        return jsonl.read_lines(spark, root)
    paths = [r["path"] for r in changed_files(files, held).select("path").toLocalIterator()]
    return jsonl.read_lines(spark, paths) if paths else jsonl.no_lines(spark)


def refresh(store: Store, root: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Folds the changed transcripts below ``root`` and keeps the rest; files that are gone go.

    ``fold`` makes rows with ``path`` of lines. Files that fold to nothing are kept as
    empty entries, so they are not read again before they change. What changed is told by
    a listing; unchanged files are not opened.
    """
    files = cut_lineage(jsonl.list_files(store.spark, root).select("path", "file_size", "mtime"), "files")
    held = store.read()
    todo = changed_files(files, held)
    fresh = cut_lineage(fold(read_changed(store.spark, root, files, held)), "fresh")
    have = [c for c in ("file_size", "mtime") if c in fresh.columns]
    rows = todo.join(fresh.drop(*have), "path", "left").join(fresh.select("path", F.lit(False).alias("is_empty")).distinct(), "path", "left")
    rows = rows.withColumn("is_empty", F.coalesce("is_empty", F.lit(True)))
    if held is not None:
        keep = held.join(files, ["path", "file_size", "mtime"], "left_semi")
        rows = keep.unionByName(rows, allowMissingColumns=True)
    out = store.write(rows)
    forget(fresh)
    forget(files)
    return out


def refresh_embeddings(store: Store, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeds chunks whose key or text is new; vectors of unchanged chunks are reused.

    Chunks of the same file that are no longer made disappear with the new version. A
    null text equals a null text; of a key that is held several times with one text any
    vector is taken, as they are equal. The store's key should name the model and the
    sizes the chunks were made with.
    """
    held = store.read()
    if held is None:
        return store.write(embed(chunks))
    known = held.groupBy(F.col("chunk_key").alias("_key"), F.col("text").alias("_text")).agg(F.first("embedding").alias("embedding"))
    same = F.col("chunk_key").eqNullSafe(F.col("_key")) & F.col("text").eqNullSafe(F.col("_text"))
    joined = cut_lineage(chunks.join(known, same, "left").drop("_key", "_text"), "vectors")
    old = joined.where(F.col("embedding").isNotNull())
    new = embed(joined.where(F.col("embedding").isNull()).select(*chunks.columns))
    out = store.write(old.select(*chunks.columns, "embedding").unionByName(new))
    forget(joined)
    return out
