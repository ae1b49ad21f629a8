"""Chunks of conversations, their embeddings and ranking by similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from threadloom.functions.cleaning import any_in
from threadloom.functions.matching import all_of, fold_case, has_literal, normalize, normalize_text, word_matches
from threadloom.plans.query import parse


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in bytes (defaults are fixed values of the format)."""

    target: int = 2400
    overlap: int = 300
    context_turns: int = 1

    def __post_init__(self):
        if not 0 <= self.overlap < self.target:
            raise ValueError("the overlap must be smaller than the target")


class Embedder(Protocol):
    """Gives vectors for passages and queries; instances are sent to the executors."""

    def embed_passages(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Deterministic word-hash vectors: no model, for tests and as a stand-in."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim, np.float32)
        for word in normalize_text(text).split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1 if h >> 63 else -1
        return v.tolist()

    def embed_passages(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._one(text)


def _floor(raw: bytes, at: int) -> int:
    """The last character boundary of UTF-8 text at or before ``at``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def long_pieces(text: str, options: ChunkOptions) -> Iterator[str]:
    """Pieces of at most the target, each starting the overlap before the last one's end."""
    raw = text.encode()
    while len(raw) > options.target:
        end = _floor(raw, options.target) or len(text[:1].encode())
        yield raw[:end].decode()
        start = max(_floor(raw, end - options.overlap), 1)
        while start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
        raw = raw[start:].decode().lstrip().encode()
    if raw:
        yield raw.decode()


def pack(turns: list[tuple[str, int, int]], options: ChunkOptions) -> list[tuple[str, int, int]]:
    """Turns packed into chunks up to the target; the texts and ranges of messages.

    A new chunk opens with the turns before it, as far as they fit into the overlap.
    Turns above the target stand alone and are cut.
    """
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int, int]] = []

    def size() -> int:
        return sum(len(t.encode()) for t, _, _ in held) + 2 * max(0, len(held) - 1)

    def flush():
        if held:
            out.append(("\n\n".join(t for t, _, _ in held), min(a for _, a, _ in held), max(b for _, _, b in held)))
            held.clear()

    stripped = [(t.strip(), a, b) for t, a, b in turns]
    for i, (text, a, b) in enumerate(stripped):
        if not text:
            continue
        n = len(text.encode())
        if n > options.target:
            flush()
            out += [(piece, a, b) for piece in long_pieces(text, options)]
            continue
        if held and size() + 2 + n > options.target:
            flush()
            for earlier in stripped[max(0, i - options.context_turns) : i]:
                if earlier[0] and size() + len(earlier[0].encode()) <= options.overlap:
                    held.append(earlier)
        held.append((text, a, b))
    flush()
    return out


_CHUNKS = "conv_ref string, path string, session_id string, chunk_index int, chunk_key string, text string, m_start int, m_end int"


def _pack_rows(options: ChunkOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = [
                    (t or "", g["start"], g["finish"]) for t, g in zip(r["semantic_turns"] or [], r["semantic_turn_ranges"] or []) if g and g["start"] is not None and g["finish"] is not None
                ]
                for k, (text, a, b) in enumerate(pack(turns, options)):
                    text = " ".join(text.split())
                    if text:
                        rows.append((r["conv_ref"], r["path"], r["session_id"], k, f"{r['path']}:{k}", text, a, b))
            c = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], names=[f.split()[0] for f in _CHUNKS.split(", ")])

    return run


def build_chunks(entries: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of every conversation row, packed where the row is; nothing is shuffled."""
    return entries.select("conv_ref", "path", "session_id", "semantic_turns", "semantic_turn_ranges").mapInArrow(_pack_rows(options), _CHUNKS)


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """Adds ``embedding``; passages are embedded in small batches inside Arrow batches."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches):
        for b in batches:
            texts = [f"passage: {t or ''}" for t in b.column("text").to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed_passages(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 where a norm is 0 or a vector is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def overlap_score(text: Column, query: str) -> Column:
    """0.2 times the share of the query's words that occur anywhere in the text."""
    words = query.lower().split()
    if not words:
        return F.lit(0.0)
    low = fold_case(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) * (0.2 / len(words))


def quality(score: Column) -> Column:
    return F.when(score >= 0.85, "strong").when(score >= 0.65, "good").when(score >= 0.35, "fair").otherwise("weak")


def rationale(score: Column, lexical: Column) -> Column:
    return F.when(score < 0.35, "weak_match").when(lexical > 0, "lexical_boosted").otherwise("semantic_only")


def rank(chunks: DataFrame, vector: list[float], query: str, top: int | None = None) -> DataFrame:
    """The best chunk of every conversation, best first.

    ``hybrid`` is the cosine plus the overlap of words. Quoted literals must occur in
    the chunk itself. Chunks whose vector has another length, or a value that is null or
    not finite, do not count.
    """
    q = parse(query)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = chunks.where((F.size("embedding") == len(vector)) & ~odd).where(all_of([has_literal(F.col("text"), x) for x in q.literals]))
    # The vector's sum and norm are constants of the plan; the data side is one pass.
    wanted = F.array(*[F.lit(float(v)) for v in vector])
    scored = usable.withColumn("semantic", cosine(F.col("embedding"), wanted)).withColumn("lexical", overlap_score(F.col("text"), q.unquoted or query))
    scored = scored.withColumn("hybrid", F.col("semantic") + F.col("lexical"))
    best = Window.partitionBy("conv_ref").orderBy(F.col("hybrid").desc(), F.col("semantic").desc(), F.col("lexical").desc(), "session_id", "chunk_index", "chunk_id")
    out = (
        scored.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") == 1)
        .select(
            "conv_ref", *(c for c in ("source",) if c in chunks.columns), "session_id", "chunk_id", "chunk_index", "m_start", "m_end", "semantic", "lexical", "hybrid",
            quality(F.col("hybrid")).alias("quality"), rationale(F.col("hybrid"), F.col("lexical")).alias("rationale"),
        )
    )
    if top is None:
        return out
    return out.orderBy(F.col("hybrid").desc(), F.col("semantic").desc(), F.col("lexical").desc(), "conv_ref", "session_id", "chunk_index").limit(top)


def matched_terms(text: Column, query: str) -> Column:
    """The distinct words of the query that the text holds, in the query's order."""
    words = list(dict.fromkeys(normalize_text(query).split()))
    low = normalize(text)
    return F.filter(F.array(*[F.when(word_matches(low, w), F.lit(w)) for w in words]), lambda w: w.isNotNull()) if words else F.array().cast("array<string>")


def suspicious(chunks: DataFrame) -> DataFrame:
    """Chunks whose text still carries fences or structural tags, which cleaning should have removed."""
    marks = ("```", "<system-reminder>", "<command-name>", "<local-command-stdout>")
    return chunks.where(any_in(F.col("text"), marks))
