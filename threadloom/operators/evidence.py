"""Where in a text a query matches, and which spots to show.

Matching with exact offsets is a scan over characters, so these run in Arrow-batched
Python, on rows that a search has already chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.functions.matching import is_alphanumeric, is_sensitive, normalize_text
from threadloom.plans.query import ParsedQuery, parse

# Bytes between hits of a cluster, bytes of a cluster, clusters shown, terms looked for.
GAP, SPAN, SHOWN, TERMS = 50, 200, 3, 64
#: Bytes between hits, for highlighting, that are painted over (fixed values).
JOINTS = " _-/"


def terms_of(query: str | ParsedQuery, limit: int | None = TERMS) -> list[tuple[str, bool]]:
    """Words (False) and literals (True) to look for; equal but for case counts once.

    Of longer queries the first ``limit`` terms are looked for, without a limit all.
    """
    q = parse(query) if isinstance(query, str) else query
    words, out = [(w, False) for w in q.words], {}
    identifiers = [(t, True) for t in q.unquoted.split() if "_" in t]
    for text, literal in [*words, *identifiers, *((x, True) for x in q.literals)]:
        out.setdefault((text.lower(), literal), (text, literal))
    return list(out.values())[:limit]


def _pattern(text: str, literal: bool) -> re.Pattern:
    if literal:
        return re.compile(re.escape(text), 0 if is_sensitive(text) else re.I)
    spaced = "".join(f"[{re.escape('_-/')} ]" if c == " " else re.escape(c) for c in text)
    # A word that begins with a letter or digit only begins where a word does.
    return re.compile((r"(?<![^\W_])" if is_alphanumeric(text[0]) else "") + spaced, re.I)


def ranges(text: str, query: str | ParsedQuery) -> list[tuple[int, int, int]]:
    """Matches that do not overlap within a term: ``(start, end, term)`` in characters."""
    found = []
    for n, (term, literal) in enumerate(terms_of(query)):
        found += [(m.start(), m.end(), n) for m in _pattern(term, literal).finditer(text)]
    return sorted(found)


def merged(found: list[tuple[int, int, int]], text: str = "") -> list[tuple[int, int]]:
    """Touching matches, and those with only a joint between, as one span each."""
    out: list[list[int]] = []
    for start, end, _ in found:
        if out and (start <= out[-1][1] or (text and set(text[out[-1][1] : start]) <= set(JOINTS))):
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def spans(text: str, query: str | ParsedQuery) -> list[tuple[str, bool]]:
    """The text cut into parts, each with whether it matches."""
    out, at = [], 0
    for start, end in merged(ranges(text, query), text):
        out += [(text[at:start], False)] * (start > at) + [(text[start:end], True)]
        at = end
    return out + [(text[at:], False)] * (at < len(text))


def clusters(text: str, found: list[tuple[int, int, int]], missing: set[int]) -> list[tuple[int, int]]:
    """Up to three spots that show best why a text matches.

    Hits near to each other form a spot of bounded size. Spots with terms that are
    missing elsewhere go first, then those with words side by side, with more terms,
    shorter ones and earlier ones; each new spot should add a missing term while it can.
    Distances are in bytes of UTF-8.
    """
    byte = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
    groups: list[list[tuple[int, int, int]]] = []
    for hit in found:
        if groups:
            end = max(e for _, e, _ in groups[-1])
            near = byte(hit[0]) <= byte(end) + GAP and byte(max(end, hit[1])) - byte(groups[-1][0][0]) <= SPAN
            if near:
                groups[-1].append(hit)
                continue
        groups.append([hit])

    def beside(group) -> int:
        gaps = (text[a[1] : b[0]] for a, b in pairwise(group) if a[2] != b[2] and b[0] >= a[1])
        return sum(bool(gap) and not any(map(is_alphanumeric, gap)) for gap in gaps)

    spots = []
    for g in groups:
        terms = {n for _, _, n in g}
        if not missing or terms & missing:
            start, end = g[0][0], max(e for _, e, _ in g)
            spots.append(((-len(terms & missing), -beside(g), -len(terms), byte(end) - byte(start), start), (start, end), terms & missing))
    spots.sort()
    chosen, covered = [], set()
    for _, spot, new in spots:
        if new - covered and len(chosen) < SHOWN:
            covered |= new
            chosen.append(spot)
    chosen += [spot for _, spot, _ in spots if spot not in chosen][: SHOWN - len(chosen)]
    return sorted(chosen)


def hidden_context(text: str, preview: str, query: str | ParsedQuery) -> list[tuple[int, int]]:
    """Spots worth showing besides a preview; none if the preview shows all there is."""
    terms = terms_of(query)
    found = ranges(text, query)
    shown = ranges(preview, query)
    missing = set(range(len(terms))) - {n for _, _, n in shown}
    if not found or (not missing and len(found) <= len(shown)):
        return []
    return clusters(text, found, missing)


def literal_window(text: str, literal: str, before: int = 81, after: int = 80) -> str:
    """The surroundings of the first match of a literal, with marks where they are cut."""
    m = _pattern(literal, True).search(text)
    if not m:
        return ""
    a, b = max(0, m.start() - before), min(len(text), m.end() + after)
    return ("…" if a else "") + text[a:b].strip() + ("…" if b < len(text) else "")


_STRUCTURAL = re.compile(r"<([^>]*)>")


def without_structural_tags(text: str) -> str:
    """Tags whose name has a dash vanish with what they enclose; others stay; space collapses."""
    out, at = [], 0
    while m := _STRUCTURAL.search(text, at):
        name = m[1].strip().lstrip("/").split()[:1]
        out.append(text[at : m.start()])
        at = m.end()
        if not name or "-" not in name[0]:
            out.append(m[0])
            continue
        out.append(" ")
        if not m[1].lstrip().startswith("/"):
            close = text.find(f"</{name[0]}>", at)
            at = at if close < 0 else close + len(name[0]) + 3
    return " ".join("".join([*out, text[at:]]).split())


def evidence(rows: DataFrame, query: str, text: str = "full_text", preview: str = "preview_first") -> DataFrame:
    """``conv_ref, spots``: the spots of each row's text, as texts with offsets."""
    q = parse(query)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [{"start": s, "end": e, "text": t[s:e]} for s, e in hidden_context(t, p or "", q)] if t else []
                for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["conv_ref", "spots"])

    return rows.select("conv_ref", F.col(text), F.col(preview)).mapInArrow(run, "conv_ref string, spots array<struct<start:int,end:int,text:string>>")


def query_terms(query: str) -> list[str]:
    """Distinct normalised words in order."""
    return list(dict.fromkeys(normalize_text(query).split()))
