"""Mix sources to target shares of tokens, with capped repeats.

Every document gets an exponential key whose rate is its quality weight (Efraimidis
and Spirakis): taking the documents of a source in the order of their keys is
weighted sampling without replacement. A source's token budget is spent on complete
epochs first and then on a prefix of that order.

The prefix sums are taken in steps, so that no source is sorted in one task: tokens are
summed per narrow bin of the key, the bin in which the budget ends is found from the
sums and binned again more narrowly, and only the documents of that last bin are sorted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.text import blank_to_null
from threadloom.session import cut_lineage

#: Split pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Options:
    """``vocabulary``: a file of ranks of a public byte-level tokenizer, readable on
    every executor. ``total_tokens``: size of the mix; by default the largest for
    which every source that has documents reaches its share within its repeats.
    ``bins``: bins of the key per factor e. ``seed``: another seed, another sample."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    total_tokens: int | None = None
    bins: int = 4096
    seed: int = 17


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, kept per process."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha() or b == 32)


def quality(text: str, tokens: int) -> float:
    """A weight from 0.05 to 1: the share of letters and spaces, less for short texts."""
    raw = text.encode("utf-8", "surrogatepass")
    share = 1 - len(raw.translate(None, _LETTERS)) / max(1, len(raw))
    return max(0.05, share * min(1.0, tokens / 64))


def _measure(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            tokens, weights = [], []
            for text in batch.column(2):
                text = text.as_py()
                n = len(encode(text))
                tokens.append(n)
                weights.append(quality(text, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(weights, pa.float64())],
                names=["doc_id", "source", "tokens", "weight"],
            )

    return run


def source_name(col: Column | str) -> Column:
    """One spelling of a source: lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(blank_to_null(col)), r"[\s-]+", "_")


def sizes(documents: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, source, tokens, weight, key, bin`` of every document with text and source."""
    usable = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name("source").alias("source"), "text").where(
        F.col("source").isNotNull() & blank_to_null("text").isNotNull()
    )
    measured = usable.mapInArrow(_measure(options.vocabulary), "doc_id long, source string, tokens long, weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(options.seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(uniform) / F.col("weight")
    return measured.withColumn("key", key).withColumn("bin", F.floor(F.log("key") * options.bins))


def targets(table: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats``: one row per source with a positive share.

    Spellings of one source are added up and keep the lower cap; a null cap is 1.
    """
    return (
        table.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)).alias("max_repeats"))
        .where(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share"))
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )


def budgets(measured: DataFrame, table: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per target source: what it has, its budget, full epochs and the rest.

    Sources without documents get no budget and the others' shares are scaled to
    make up one; the target shares stay in the report.
    """
    have = measured.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    stock = targets(table).join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available")
    )
    supply = F.col("available") * F.greatest("max_repeats", F.lit(0))
    live = supply > 0
    everything = Window.partitionBy(F.lit(0))  # one row per source
    scaled = stock.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(everything)))
    most = F.min(F.when(live, supply / F.col("share"))).over(everything)
    total = F.lit(float(options.total_tokens)) if options.total_tokens is not None else most
    budget = F.when(live, F.least(F.floor(total * F.col("share") + 1e-6), supply)).otherwise(0).cast("long")
    return scaled.withColumn("budget", budget).select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "available",
        "budget",
        F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("available") > 0, F.col("budget") % F.col("available")).otherwise(0).cast("long").alias("rest"),
    )


def _split(placed: DataFrame, bins: str) -> tuple[DataFrame, DataFrame]:
    """Documents outside the bin in which their source's rest ends, with ``one_more``, and those in it.

    ``before`` has the tokens that stand before a document's bins so far; in the second
    part it is brought up to that bin. One row per source is broadcast.
    """
    sums = placed.groupBy("source", bins).agg(F.sum("tokens").alias("in_bin"), F.first("before").alias("so_far"), F.first("rest").alias("of_rest"))
    upto = F.col("so_far") + F.sum("in_bin").over(Window.partitionBy("source").orderBy(bins).rowsBetween(Window.unboundedPreceding, 0))
    ends = (
        sums.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("of_rest")) & (F.col("of_rest") > 0))
        .groupBy("source")
        .agg(F.min(F.struct(F.col(bins).alias("at"), (F.col("upto") - F.col("in_bin")).alias("before"))).alias("cut"))
    )
    known = placed.join(F.broadcast(ends), "source", "left")
    decided = known.where(~F.coalesce(F.col(bins) == F.col("cut.at"), F.lit(False)))
    decided = decided.withColumn("one_more", F.coalesce((F.col(bins) < F.col("cut.at")).cast("int"), F.lit(0)))
    return decided.drop("cut"), known.where(F.col(bins) == F.col("cut.at")).withColumn("before", F.col("cut.before")).drop("cut")


def mix(documents: DataFrame, table: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The documents of the mix with their copies, and the report of shares.

    The first: ``doc_id, source, tokens, copies`` with at least one copy and at most
    the source's repeats. The second, one row per target source: ``source,
    target_share, documents, available, budget, taken, actual_share, epochs``.

    After full epochs documents are taken in key order while the middle of a document
    lies inside the rest of the budget, so a source misses its budget by half a
    document at most.

    Defined results: documents without text, source or target take no part; sources
    with no documents or no repeats are reported with nothing taken; equal keys are
    ordered by id; documents that come twice take part twice; empty tables give an
    empty mix; other columns may have any name.
    """
    measured = cut_lineage(sizes(documents, options), "sizes")
    plan = cut_lineage(budgets(measured, table, options), "budgets")
    wanted = F.broadcast(plan.select("source", "epochs", "rest"))  # a row per target source
    placed = measured.join(wanted, "source").withColumn("before", F.lit(0).cast("long"))
    decided, edge = _split(placed, "bin")
    # The bin with the cut grows with its source, so it is binned again, more narrowly.
    more, edge = _split(cut_lineage(edge.withColumn("fine", F.floor(F.log("key") * (options.bins * options.bins))), "edge"), "fine")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("one_more", (F.col("before") + before + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    shown = ("doc_id", "source", "tokens", "epochs", "one_more")
    parts = decided.select(*shown).unionByName(more.select(*shown)).unionByName(edge.select(*shown))
    chosen = parts.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("one_more")).cast("int").alias("copies")).where(F.col("copies") > 0)
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    report = plan.join(taken, "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    report = report.withColumn("actual_share", F.col("taken") / F.nullif(F.sum("taken").over(Window.partitionBy(F.lit(0))), F.lit(0))).select(
        "source", "target_share", "documents", "available", "budget", "taken", "actual_share", "epochs"
    )
    return chosen, report
