"""Messages delivered at least once: keep exactly one row of each.

The work is done on identifiers only:

1. *Pre-aggregate.* Rows collapse to their distinct ``(conversation, line, id)``
   before anything is shuffled, so a group of copies costs one row per partition.
2. *Resolve aliases.* Lines that carry several ids link those ids; the links (a
   small edge table) go through connected components.
3. *Dictionary-encode.* Every message key gets an exact code: a shard by hash and
   a dense position inside the shard. Codes never collide, because the position is
   a rank over the keys themselves.
4. *Select per unseen bit.* The arrivals of a shard come best first and set the bit of
   their message's code. An arrival whose bit is set already is a copy; the one that
   finds it unset is delivered (:func:`first_of_bits`).
5. *Union.* Across runs a shard's seen messages are bitmaps, one per 32,768 positions.
   New bits are added as a part and published as the next version by one rename, which
   fails where another writer was first (:class:`SeenStore`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.functions.text import blank_to_null
from threadloom.operators.components import connected_components
from threadloom.operators.positions import positions
from threadloom.session import cut_lineage, drop_path, forget

#: Bits of one bitmap, fixed by Spark's bitmap functions.
BITS = 32768


@dataclass(frozen=True)
class Keys:
    """Names of the columns that identify a delivered row."""

    conv: str = "conv_ref"
    line: str = "jsonl_line"
    ident: str = "assistant_message_id"
    batch: str = "batch_no"
    row: str = "row_id"


def _arrivals(rows: DataFrame, keys: Keys, facts: dict[str, Column]) -> DataFrame:
    """Distinct ``(conv, line, id)`` with their best row and its facts, the rest folded in."""
    base = rows.select(
        F.col(keys.conv).alias("conv"),
        F.col(keys.line).cast("long").alias("line"),
        blank_to_null(F.col(keys.ident).cast("string")).alias("id"),
        F.col(keys.batch).cast("long").alias("batch"),
        F.col(keys.row).alias("row"),
        *[c.alias(f"_{name}") for name, c in facts.items()],
    )
    alone = F.col("conv").isNull() | (F.col("line").isNull() & F.col("id").isNull())
    # A null batch counts as the last one.
    rank = F.struct(F.col("batch").isNull().alias("late"), F.col("batch"), F.col("row"), *[F.col(f"_{name}").alias(name) for name in facts])
    return (
        base.withColumn("solo", F.when(alone, F.col("row").cast("string")))
        .groupBy("conv", "line", "id", "solo")
        .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("copies"))
    )


def message_keys(rows: DataFrame, keys: Keys = Keys(), facts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct ``(conv, line, id)`` groups with the message each belongs to.

    Adds ``k_id`` and ``k_line`` to the arrivals: the least id of the message, or
    its line where it has no id at all. Both are null for rows that identify
    nothing (``solo`` then holds the row itself). ``facts`` are columns of the rows that
    go along with the best row of each arrival, so nothing has to be joined back.
    """
    arrivals = _arrivals(rows, keys, facts or {})
    known = F.col("id").isNotNull() & F.col("line").isNotNull()
    nothing = F.lit(None).cast("string")
    # Only lines meet in a window and only names in a join: rows without them, which may be
    # a large part of all, would share one key. Arrivals are distinct, so a line's window
    # holds its distinct ids.
    lined = arrivals.where(F.col("solo").isNull() & F.col("line").isNotNull()).withColumn("rep", F.min("id").over(Window.partitionBy("conv", "line")))
    loose = arrivals.where(F.col("solo").isNotNull() | F.col("line").isNull()).withColumn("rep", nothing)
    groups = lined.unionByName(loose).withColumn("named", F.when(F.col("solo").isNull(), F.coalesce("id", "rep")))
    groups = cut_lineage(groups, "arrivals")
    links = groups.where(known & (F.col("id") != F.col("rep"))).select("conv", F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links, "conv", "a", "b").select("conv", F.col("vertex").alias("named"), "root")
    shown = ("conv", "line", "id", "solo", "best", "copies", "k_id", "k_line")
    named = groups.where(F.col("named").isNotNull()).join(roots, ["conv", "named"], "left").withColumn("k_id", F.coalesce("root", "named"))
    named = named.withColumn("k_line", F.lit(None).cast("long")).select(*shown)
    nameless = groups.where(F.col("named").isNull()).withColumn("k_id", nothing).withColumn("k_line", F.when(F.col("solo").isNull(), F.col("line")))
    return named.unionByName(nameless.select(*shown))


def messages(rows: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """One row per message: its best arrival, first line and number of copies.

    The best arrival has the highest line, then the lowest batch, then the lowest
    row. Columns ``conv, k_id, k_line, solo, line, batch, row, first_line, copies``.
    """
    return best_arrivals(message_keys(rows, keys))


def best_arrivals(keyed: DataFrame) -> DataFrame:
    """The messages of a table made by :func:`message_keys`."""
    order = F.struct(F.col("line").isNull(), -F.col("line"), F.col("best.late"), F.col("best.batch"), F.col("best.row"))
    facts = keyed.schema["best"].dataType.names[3:]
    return (
        keyed.groupBy("conv", "k_id", "k_line", "solo")
        .agg(
            F.min_by(F.struct("line", "best"), order).alias("pick"),
            F.min("line").alias("first_line"),
            F.sum("copies").alias("copies"),
        )
        .select("conv", "k_id", "k_line", "solo", "pick.line", "pick.best.batch", "pick.best.row", "first_line", "copies", *[F.col(f"pick.best.{f}").alias(f) for f in facts])
    )


def _key() -> Column:
    """The message key as one exact string; the parts cannot run into each other."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(part(F.col("conv")), part(F.col("k_id")), part(F.col("k_line").cast("string")), part(F.col("solo")))


def identifiers(keyed: DataFrame) -> DataFrame:
    """Every identifier of :func:`message_keys`, with its message: ``(conv, kind, value, key)``."""
    named = keyed.withColumn("key", _key())
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    return (
        named.select(
            "conv",
            "key",
            F.explode(
                F.when(F.col("solo").isNotNull(), F.array(entry("row", "solo"))).otherwise(
                    F.array(entry("id", "id"), entry("line", "line"))
                )
            ).alias("e"),
        )
        .select("conv", "e.kind", "e.value", "key")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def encode(found: DataFrame, shards: int = 256, known: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """Exact dictionary codes ``(shard, code)`` for the messages ``found``.

    ``known`` (``key, shard, code``) holds messages that have a code already; the
    others follow the next free code of their shard (``bases``: ``shard, base``) in
    key order, so codes stay dense and a bitmap has no holes. ``shards`` bounds the
    rows one task ranks: keys are unique here, so the hash spreads them evenly
    whatever the skew of the input.
    """
    keyed = found.withColumn("key", _key())
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("key")).cast("long") - 1
    if known is None:
        return keyed.withColumn("shard", shard).withColumn("code", rank)
    joined = keyed.join(known.select("key", "shard", "code"), "key", "left")
    new = (
        joined.where(F.col("code").isNull())
        .withColumn("shard", shard)
        .join(F.broadcast(bases), "shard", "left")  # one row per shard
        .withColumn("code", F.coalesce("base", F.lit(0)) + rank)
        .drop("base")
    )
    return joined.where(F.col("code").isNotNull()).unionByName(new)


def bitmaps(codes: DataFrame) -> DataFrame:
    """``(shard, bucket, bits)``: the bits of all ``codes``, or-ed per bucket."""
    return codes.groupBy("shard", F.floor(F.col("code") / BITS).cast("long").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("code") % BITS).alias("bits")
    )


def unseen(codes: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``codes`` whose bit is not set in the bitmaps ``seen``."""
    at = codes.withColumn("bucket", F.floor(F.col("code") / BITS).cast("long"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("code") % BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(code % 8 as int))"))
    return at.join(seen, ["shard", "bucket"], "left").where(F.coalesce(bit == 0, F.lit(True))).drop("bits", "bucket")


def coded_arrivals(rows: DataFrame, keys: Keys = Keys(), shards: int = 256) -> DataFrame:
    """The arrivals of :func:`message_keys` with the code of their message.

    The codes are those of :func:`encode`. ``first_line`` and ``copies`` are the
    message's, ``line, batch, row`` the arrival's.
    """
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    keyed = message_keys(rows, keys).withColumn("key", _key()).withColumn("shard", shard).repartition("shard")
    message = Window.partitionBy("shard", "key")
    told = keyed.select(
        "conv", "k_id", "k_line", "solo", "line", "best.late", "best.batch", "best.row", "key", "shard",
        F.min("line").over(message).alias("first_line"), F.sum("copies").over(message).alias("copies"),
    )
    # The window over the shard comes last, so that every shard is left in one partition.
    return told.withColumn("code", F.dense_rank().over(Window.partitionBy("shard").orderBy("key")).cast("long") - 1)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that find the bit of their code unset; a shard's rows come in one run."""
    shard, bits = None, np.zeros(0, np.uint8)
    for batch in batches:
        shards, codes = batch.column("shard").to_numpy(), batch.column("code").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                shard, bits = shards[a], np.zeros(0, np.uint8)
            own, first = np.unique(codes[a:b], return_index=True)
            if (need := int(own[-1]) // 8 + 1) > bits.size:
                bits = np.concatenate((bits, np.zeros(max(need, 2 * bits.size) - bits.size, np.uint8)))
            at, bit = own >> 3, (1 << (own & 7)).astype(np.uint8)
            keep[a + first[(bits[at] & bit) == 0]] = True
            np.bitwise_or.at(bits, at, bit)
        yield batch.filter(pa.array(keep))


def first_of_bits(coded: DataFrame, *columns: str) -> DataFrame:
    """Of every code the best arrival, as ``columns`` with ``shard`` and ``code``.

    The highest line is best, then the lowest batch (null last), then the lowest row. A
    task holds one shard's bits at a time.
    """
    order = ["shard", F.col("line").desc_nulls_last(), "late", "batch", "row"]
    picked = coded.sortWithinPartitions(*order).select(*columns, "shard", "code")
    return picked.mapInArrow(_fresh, picked.schema)


def deliver(rows: DataFrame, keys: Keys = Keys(), seen: DataFrame | None = None, shards: int = 256) -> DataFrame:
    """One arrival of every message whose bit is unset.

    Rows belong to one message if, inside one conversation, they share the line or a
    non-blank id (case matters, surrounding white space does not), directly or
    through other rows. The highest line stays, then the lowest batch, then the
    lowest row. The row column must be unique.

    Defined results: a row without a conversation, or without both line and id, is a
    message of its own; a null batch sorts last and a null line below every line;
    an empty table delivers nothing; rows repeated in full differ by their row
    column and so all but one go; other columns play no part and may have any name.
    """
    out = ("conv", "k_id", "k_line", "solo", "line", "batch", "row", "first_line", "copies", "key")
    codes = first_of_bits(coded_arrivals(rows, keys, shards), *out)
    return codes if seen is None else unseen(codes, seen)


def extra_copies(rows: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """The row ids that :func:`deliver` does not keep, as one column."""
    kept = first_of_bits(coded_arrivals(rows, keys), "row").select(F.col("row").alias(keys.row))
    return rows.select(keys.row).join(kept, keys.row, "left_anti")


def delivered(rows: DataFrame, keys: Keys = Keys(), ordinal: str = "ordinal") -> DataFrame:
    """The remaining row of every message, numbered in its conversation.

    The columns of ``rows``; ``ordinal`` is the place, from 1 without gaps, in the order of
    the ordinals given, then of first lines (messages without an ordinal come last, those
    without a line last of these), then of rows. ``message_count`` is added: the messages of
    the conversation. Rows without a conversation belong to none and are left out.

    Only identifiers are shuffled and numbered, and the rows joined once.
    """
    kept = best_arrivals(message_keys(rows, keys, {"given": F.col(ordinal).cast("long")})).where(F.col("conv").isNotNull())
    late = F.lit(1 << 31)
    place = F.coalesce("given", late + F.coalesce("first_line", late))
    at = positions(kept.select("conv", "row", place.alias("at"), F.coalesce("first_line", late).alias("line")), "conv", "at", "_place", ties=("line", "row"))
    at = cut_lineage(at.select("conv", F.col("row").alias(keys.row), "_place"), "places")
    counts = at.groupBy("conv").agg(F.max("_place").alias("message_count"))
    found = rows.join(at.join(counts, "conv").drop("conv"), keys.row)
    return found.withColumn(ordinal, F.col("_place").cast(rows.schema[ordinal].dataType)).select(*rows.columns, "message_count")


class Conflict(RuntimeError):
    """Another writer published a version of the store first."""


class SeenStore:
    """Dictionary and bitmaps of everything delivered so far, in numbered versions.

    ``take`` returns the messages of a new set of rows that no earlier call returned and
    publishes their bits. A call adds one part: new words of the dictionary and new bits,
    nothing is written twice. A version is a small file that lists its parts; version n + 1
    is published by a rename that fails if there is one, so of two writers one wins and the
    other reads the new version and takes again. A run that dies half-way leaves the old
    version in force. Across calls the first arrival of a message wins.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def version(self) -> tuple[int, list[str]]:
        """The number of the current version, 0 if there is none, and its parts."""
        fs, at = self._fs(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, []
        last = max(numbers)
        state = json.loads(self.spark.read.text(f"{self.path}/versions/{last:08d}", wholetext=True).first()[0])
        if state["shards"] != self.shards:
            raise ValueError(f"the store has {state['shards']} shards, not {self.shards}")
        return last, state["parts"]

    def _read(self, parts: list[str], kind: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{p}/{kind}" for p in parts]) if parts else None

    def take(self, rows: DataFrame, keys: Keys = Keys(), tries: int = 5) -> DataFrame:
        """The undelivered messages among ``rows``; their bits are then set.

        The dictionary maps every identifier (id, line) to its message's code, so a
        later copy is known by either of them.
        """
        keyed = cut_lineage(message_keys(rows, keys), "keyed")
        for _ in range(tries):
            number, parts = self.version()
            part = f"part-{uuid.uuid4().hex}"
            try:
                out = self._add(keyed, parts, part)
                self._publish(number + 1, [*parts, part])
                forget(keyed)
                return out
            except Conflict:
                drop_path(self.spark, f"{self.path}/{part}")
        raise Conflict(f"{tries} other writers were first")

    def _add(self, keyed: DataFrame, parts: list[str], part: str) -> DataFrame:
        home = f"{self.path}/{part}"
        dictionary, seen = self._read(parts, "dictionary"), self._read(parts, "bitmaps")
        names, found = identifiers(keyed), best_arrivals(keyed)
        if dictionary is None:
            codes = encode(found, self.shards)
        else:
            met = names.join(dictionary, ["conv", "kind", "value"])
            known = met.groupBy("key").agg(F.min(F.struct("shard", "code")).alias("at")).select("key", "at.shard", "at.code")
            bases = dictionary.groupBy("shard").agg((F.max("code") + 1).alias("base"))
            codes = encode(found, self.shards, known, bases)
            seen = seen.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        codes.write.parquet(f"{home}/arrived")
        codes = self.spark.read.parquet(f"{home}/arrived")
        (codes if seen is None else unseen(codes, seen)).write.parquet(f"{home}/delivered")
        out = self.spark.read.parquet(f"{home}/delivered")
        words = names.join(codes.select("key", "shard", "code"), "key").select("conv", "kind", "value", "shard", "code")
        (words if dictionary is None else words.join(dictionary, ["conv", "kind", "value"], "left_anti")).write.parquet(f"{home}/dictionary")
        bitmaps(out).write.option("compression", "zstd").parquet(f"{home}/bitmaps")
        return out

    def compact(self) -> None:
        """One part in place of all: the dictionary as it is, the bits or-ed."""
        number, parts = self.version()
        if len(parts) < 2:
            return
        part = f"part-{uuid.uuid4().hex}"
        self._read(parts, "dictionary").write.parquet(f"{self.path}/{part}/dictionary")
        bits = self._read(parts, "bitmaps").groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.option("compression", "zstd").parquet(f"{self.path}/{part}/bitmaps")
        self._publish(number + 1, [part])

    def _publish(self, number: int, parts: list[str]) -> None:
        jvm = self.spark._jvm
        fs, tmp = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps({"shards": self.shards, "parts": parts}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{number:08d}"), plain)
        except Py4JJavaError as error:
            fs.delete(tmp, False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(f"version {number} is there already") from None

    def forget(self) -> None:
        drop_path(self.spark, self.path)
