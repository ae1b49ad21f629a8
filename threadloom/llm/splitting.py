"""Split texts that exceed a byte limit into overlapping pieces.

Balanced targets: the least possible number of pieces is computed, equally spaced
cut targets are placed, every target is snapped to the strongest boundary near it,
and a piece is added whenever any limit fails.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.functions.text import strip

#: Cut places by strength; a cut lies at the end of the match.
BOUNDARIES = (
    (6, re.compile(r"\n[^\S\n]*\n\s*")),  # between paragraphs
    (5, re.compile(r"\n[^\S\n]*")),  # between lines
    (4, re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”’)]*\s*")),  # between sentences
    (3, re.compile(r"[,;:]\s+|[、，；：]\s*")),  # between clauses
    (2, re.compile(r"\s+")),  # between words
)
#: A cut between two letters, and one inside a character seen as one by readers.
LETTER, INSIDE = 1, 0


@dataclass(frozen=True)
class Limits:
    """Sizes in UTF-8 bytes."""

    size: int = 2400
    overlap: int = 300

    def __post_init__(self):
        if self.size < 64 or self.overlap < 0 or self.overlap * 3 > self.size:
            raise ValueError("need a size of 64 bytes or more and an overlap of at most a third of it")


def _inside(text: str, i: int) -> bool:
    """True if a cut before ``text[i]`` would part what is read as one character."""
    c, before = text[i], text[i - 1]
    if unicodedata.combining(c) or "︀" <= c <= "️" or c == "‍" or before == "‍":
        return True
    if "\U0001f3fb" <= c <= "\U0001f3ff":
        return True
    if "\U0001f1e6" <= c <= "\U0001f1ff" and "\U0001f1e6" <= before <= "\U0001f1ff":
        # Two of them are one flag; an odd number before the cut parts a pair.
        first = i
        while first > 0 and "\U0001f1e6" <= text[first - 1] <= "\U0001f1ff":
            first -= 1
        return (i - first) % 2 == 1
    if "ᅠ" <= c <= "ᇿ" and ("ᄀ" <= before <= "ᇿ" or "가" <= before <= "힣"):
        return True  # vowels and finals of Hangul belong to what is before them
    return c == "\n" and before == "\r"


class _Text:
    """A text with byte offsets of its characters and its boundaries."""

    def __init__(self, text: str):
        self.text = text
        if text.isascii():
            self.at = range(len(text) + 1)
        else:
            at, n = [0], 0
            for c in text:
                n += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                at.append(n)
            self.at = at
        self.bytes = self.at[-1]
        strength: dict[int, int] = {}
        for level, pattern in BOUNDARIES:
            for m in pattern.finditer(text):
                strength.setdefault(m.end(), level)
        strength.pop(len(text), None)
        self.places = sorted(strength)
        self.strength = strength

    def char(self, byte: int) -> int:
        """The last character offset at or before ``byte``."""
        if isinstance(self.at, range):
            return max(0, min(byte, self.bytes))
        lo, hi = 0, len(self.at) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.at[mid] <= byte else (lo, mid - 1)
        return lo

    def snap(self, target: float, reach: float, low: int, high: int) -> int:
        """The strongest cut within ``reach`` bytes of ``target``, the nearest of equals.

        Only cuts strictly between the character offsets ``low`` and ``high`` count.
        """
        from bisect import bisect_left, bisect_right

        first = max(low + 1, self.char(int(target - reach)))
        last = min(high - 1, self.char(int(target + reach)))
        best = None
        for k in self.places[bisect_left(self.places, first) : bisect_right(self.places, last)]:
            rank = (self.strength[k], -abs(self.at[k] - target))
            if best is None or rank > best[0]:
                best = (rank, k)
        if best:
            return best[1]
        k = min(max(self.char(int(target)), low + 1), high - 1)
        for step in range(64):  # long runs of joined characters are cut where they are
            for j in (k - step, k + step):
                if low < j < high and not _inside(self.text, j):
                    return j
        return k


def split_points(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Character ranges of the pieces of ``text``; one range if it is short enough.

    Every piece has at most ``limits.size`` bytes, each starts before the one before
    it ends, by ``limits.overlap`` bytes or up to two thirds more or less, and together they
    cover the text. Only where eight pieces more than needed do not give such overlaps
    (a text without places to cut) other overlaps are taken.
    """
    t = _Text(text)
    total = t.bytes
    if total <= limits.size:
        return [(0, len(text))]
    count = least = -(-(total - limits.overlap) // (limits.size - limits.overlap))
    while True:
        step = (total - limits.overlap) / count
        reach = min(step / 6, limits.size / 4)
        pieces, start = [], 0
        for k in range(1, count):
            end = t.snap(k * step + limits.overlap, reach, start, len(text))
            pieces.append((start, end))
            if limits.overlap:
                start = t.snap(t.at[end] - limits.overlap, limits.overlap / 2, start, end)
            else:
                start = end
        pieces.append((start, len(text)))
        fits = all(a < b and t.at[b] - t.at[a] <= limits.size for a, b in pieces)
        # Runs of joined characters may leave no cut at a good distance, however many pieces there are.
        even = all(abs(t.at[b] - t.at[a] - limits.overlap) <= limits.overlap * 2 // 3 for (_, b), (a, _) in zip(pieces, pieces[1:]))
        if fits and (even or count > least + 8):
            return pieces
        count += 1


_SCHEMA = "entry long, turn int, piece int, pieces int, range_start int, range_end int, overlap_bytes int, piece_bytes int, text string"


def _cut(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("entry", "turn", "piece", "pieces", "range_start", "range_end", "overlap_bytes", "piece_bytes", "text")}
            for row in batch.to_pylist():
                ranges = split_points(row["text"], limits)
                before = 0
                for n, (a, b) in enumerate(ranges, 1):
                    text = row["text"][a:b]
                    out["entry"].append(row["entry"])
                    out["turn"].append(row["turn"])
                    out["piece"].append(n)
                    out["pieces"].append(len(ranges))
                    out["range_start"].append(row["range_start"])
                    out["range_end"].append(row["range_end"])
                    out["overlap_bytes"].append(len(row["text"][a:before].encode()) if n > 1 else 0)
                    out["piece_bytes"].append(len(text.encode()))
                    out["text"].append(text)
                    before = b
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema(
                    [("entry", pa.int64())]
                    + [(c, pa.int32()) for c in ("turn", "piece", "pieces", "range_start", "range_end", "overlap_bytes", "piece_bytes")]
                    + [("text", pa.string())]
                ),
            )

    return run


def oversized_turns(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Turns above the limit that have a range, one row each, found inside the JVM."""
    size = lambda t: F.octet_length(t)
    # Only turns whose raw size is above the limit are stripped and looked at again.
    large = F.filter(
        F.transform(
            F.coalesce("semantic_turns", F.array().cast("array<string>")),
            lambda t, i: F.struct((i + 1).cast("int").alias("turn"), F.when(size(t) > limits.size, strip(t)).alias("text")),
        ),
        lambda s: size(s["text"]) > limits.size,
    )
    return (
        entries.select(F.col("entry_id").alias("entry"), F.col("semantic_turn_ranges").alias("ranges"), F.explode(large).alias("s"))
        .select("entry", "s.turn", F.get("ranges", F.col("s.turn") - 1).alias("r"), "s.text")
        .where(F.col("r").isNotNull())
        .select("entry", "turn", F.col("r.start").alias("range_start"), F.col("r.finish").alias("range_end"), "text")
    )


def pieces(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of every turn longer than the limit, each with its turn's range.

    ``entry, turn, piece, pieces, range_start, range_end, overlap_bytes, piece_bytes,
    text``; turns count from 1, pieces too. Dropping the first ``overlap_bytes`` of
    each piece and joining the rest gives the stripped turn back exactly.

    Defined results: null turns, null turn arrays and turns without a range at their
    place give nothing; a range with a null start keeps it; a turn of any length is
    cut, at letters where it has no boundary; repeated turns are cut each for itself;
    an empty table gives no pieces; other columns may have any name.

    No shuffle: turns are exploded and filtered in the JVM and only those above the
    limit reach Python.
    """
    return oversized_turns(entries, limits).mapInArrow(_cut(limits), _SCHEMA)
