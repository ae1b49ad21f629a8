"""Find held-out test passages inside a corpus.

A passage is ``words`` consecutive words of a test item. Both sides are reduced to
their letters and digits, so case, punctuation, markup, invisible characters and
line breaks, also inside a word, make no difference. The search is a MinHash
containment search, partitioned by size: a passage is the set of its shingles, and the
longer a passage is, the longer are the shingles of its partition, so the fewer places
of a document it has to be compared with. A passage is sketched by the least hash of its
shingles. A document that holds the passage has all its shingles, hence that hash, so
none is missed; every place that has it is verified, first by a digest of the passage
and then letter by letter.

Test items are cut into passages by the cluster. Only sketches (28 bytes a passage) are
sent to executors; what was found is joined to the passages.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage

#: Tags with attributes of any length, over lines too, and comments. Possessive, so every
#: character is looked at once for each "<" before it that opens a name.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++)"""
_TAG = re.compile(rf"<!--.*?-->|</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+{_VALUE})?+)*+\s*+/?>|</?[A-Za-z][^<>\n]{{0,200}}>", re.S)
#: A tag without any value may be a comparison in prose or code; up to here it is a tag.
LOOSE_TAG = 200
_LINK = re.compile(r"""\]\(\s*(?:<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))+)(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)""")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf]")

#: Stands between documents; it is kept as a letter and equals nothing in an item.
WALL = 0x10FFFF
#: Texts are searched in blocks of about this many characters, whole texts only.
BLOCK = 1_500_000
#: Partitions of passages by letters: from that many on, and the length of their shingles.
SIZES = ((1, 1), (8, 8), (32, 16), (56, 32), (112, 64))


@dataclass(frozen=True)
class Options:
    """``words``: length of a passage. ``sketches``: passages that are searched for at
    once; 28 bytes each are sent to the executors, so the default sends 560 MB at most.
    Larger sets are taken by ranges of the hash, with one more pass over the corpus each."""

    words: int = 12
    sketches: int = 20_000_000


def _markup(m: re.Match) -> str:
    tag = m[0]
    return "\x01" if len(tag) <= LOOSE_TAG or "=" in tag or tag.startswith("<!--") or " " not in tag else tag


def clean(text: str) -> str:
    """``text`` in one spelling: markup marked as such, compatibility forms folded."""
    if "<" in text:
        text = _TAG.sub(_markup, text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and not 0xD800 <= int(m[1], 16) < 0xE000 else " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


_LETTER, _UNSEEN = 1, 2


def _kinds() -> np.ndarray:
    """For every code point below 0x30000: letter or digit, invisible, or neither."""
    kinds = np.zeros(0x30000, np.uint8)
    for code in range(0x30000):
        c = chr(code)
        if c.isalnum():
            kinds[code] = _LETTER
        elif unicodedata.category(c) in ("Cf", "Mn", "Me"):
            kinds[code] = _UNSEEN
    return kinds


_KINDS: np.ndarray | None = None


def squash(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters and digits of a cleaned text, and where words begin and end.

    A word begins where the visible character before it is no letter or digit.
    """
    global _KINDS
    if _KINDS is None:
        _KINDS = _kinds()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[np.minimum(codes, 0x2FFFF)]
    kinds = np.where(codes == WALL, _LETTER, kinds)
    seen = kinds != _UNSEEN
    codes, letter = codes[seen], kinds[seen] == _LETTER
    wall = codes == WALL
    solid = letter & ~wall
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty_like(letter)
    after[-1:] = False
    after[:-1] = solid[1:]
    return codes[letter], ~before[letter], ~after[letter]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` codes, built by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, width, power = (codes.astype(np.uint64) + np.uint64(1)) * _MIX, 1, _BASE
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                # `out` covers the first `done` codes; this power of two follows.
                out = part[:n].copy() if out is None else out[:n] * power + part[done : done + n]
                done += width
            if done == k:
                break
            part = part[: len(part) - width] * power + part[width:]
            power = power * power
            width *= 2
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def digest(codes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(codes.tobytes())


def _size_class(n: int) -> int:
    return max(i for i, (least, _) in enumerate(SIZES) if n >= least)


_PASSAGE = "part int, hash long, offset int, length int, digest binary, letters string, item_id long, place int, total int"


def _cut(words: int):
    """Every passage of every item with its sketch; shorter items have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in _PASSAGE.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, begins, _ends = squash(clean(text.as_py()))
                at = np.append(np.flatnonzero(begins), len(codes))
                total = len(at) - words
                if total <= 0:
                    continue
                hashes = {k: shingle_hashes(codes, k) for _, k in SIZES}
                for place in range(total):
                    a, b = int(at[place]), int(at[place + words])
                    part = _size_class(b - a)
                    k = SIZES[part][1]
                    offset = int(hashes[k][a : b - k + 1].argmin())
                    letters = codes[a:b]
                    rows.append((part, int(hashes[k][a + offset].view(np.int64)), offset, b - a, digest(letters), letters.tobytes().decode("utf-32-le", "replace"), item, place, total))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def passages(items: DataFrame, options: Options = Options()) -> DataFrame:
    """All passages of ``item_id, text``: sketch, digest and letters, item and place in it."""
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    return usable.mapInArrow(_cut(options.words), _PASSAGE)


@dataclass
class Partition:
    """The sketches of the passages of one size class, by rising hash."""

    k: int
    hashes: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    digests: np.ndarray  # rows of 16 bytes
    filter: np.ndarray  # bits by the top of the hash
    shift: np.uint64


def _partitions(sketches: pa.Table) -> list[Partition]:
    out = []
    parts = sketches.column("part").to_numpy()
    hashes = sketches.column("hash").to_numpy().view(np.uint64)
    digests = np.frombuffer(b"".join(sketches.column("digest").to_pylist()), "V16")
    for part, (_, k) in enumerate(SIZES):
        rows = np.flatnonzero(parts == part)
        if not len(rows):
            continue
        rows = rows[np.argsort(hashes[rows], kind="stable")]
        width = max(16, int(len(rows) * 16).bit_length())
        shift = np.uint64(64 - width)
        bits = np.zeros(1 << width, bool)
        bits[(hashes[rows] >> shift).astype(np.int64)] = True
        offsets, lengths = (sketches.column(c).to_numpy()[rows] for c in ("offset", "length"))
        out.append(Partition(k, hashes[rows], offsets, lengths, digests[rows], bits, shift))
    return out


def _search(partitions: list[Partition], texts: list[tuple[int, str]]) -> set[tuple[int, bytes, str]]:
    """``(document, digest, letters)`` of every passage found in one block of texts."""
    codes, begins, ends = squash(chr(WALL).join(clean(t) for _, t in texts))
    walls = np.flatnonzero(codes == WALL)
    found: set[tuple[int, bytes, str]] = set()
    for part in partitions:
        h = shingle_hashes(codes, part.k)
        at = np.flatnonzero(part.filter[(h >> part.shift).astype(np.int64)])
        first = np.searchsorted(part.hashes, h[at], "left")
        last = np.searchsorted(part.hashes, h[at], "right")
        for p, lo, hi in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
            for s in range(lo, hi):
                a = p - int(part.offsets[s])
                b = a + int(part.lengths[s])
                if a < 0 or b > len(codes) or not begins[a] or not ends[b - 1]:
                    continue
                if digest(codes[a:b]) == part.digests[s].tobytes():
                    found.add((texts[int(np.searchsorted(walls, a))][0], part.digests[s].tobytes(), codes[a:b].tobytes().decode("utf-32-le", "replace")))
    return found


_SCHEMA = "doc_id long, digest binary, letters string"


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block: list[tuple[int, str]] = []
            size, rows = 0, set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if doc is None or not text:
                    continue
                block.append((doc, text))
                size += len(text)
                if size >= BLOCK:
                    rows |= _search(shared.value, block)
                    block, size = [], 0
            if block:
                rows |= _search(shared.value, block)
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())], names=["doc_id", "digest", "letters"]
            )

    return run


def leaks(documents: DataFrame, items: DataFrame, options: Options = Options()) -> DataFrame:
    """Documents that hold a passage of a test item, one row per pair.

    ``doc_id, item_id, passages_found, passages_of_item``: how many of the item's
    passages (distinct places) stand in the document.

    Defined results: null and blank texts, and items of fewer than ``words`` words,
    give nothing; passages shared by items count for each; documents with one id count
    as one; documents are searched whole, of any length; no items or no documents give
    no rows; other columns may have any name.

    The corpus is read once and never shuffled; only the passages found are. More than
    ``sketches`` different passages take another pass for each such number.
    """
    spark = documents.sparkSession
    table = cut_lineage(passages(items, options), "passages")
    sketches = table.select("part", "hash", "offset", "length", "digest").distinct()
    passes = max(1, -(-sketches.count() // options.sketches))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for n in range(passes):
        mine = sketches.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == n) if passes > 1 else sketches
        shared = spark.sparkContext.broadcast(_partitions(mine.toArrow()))
        part = texts.mapInArrow(_finder(shared), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return (
        found.join(table.select("digest", "letters", "item_id", "place", "total"), ["digest", "letters"])
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("place").cast("int").alias("passages_found"), F.first("total").alias("passages_of_item"))
    )
