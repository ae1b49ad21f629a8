"""Queries: parsing of quotes, words and literals, modes and conversation refs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from threadloom.functions.matching import normalize_text

MODES = ("lexical", "exact", "semantic", "hybrid")


@dataclass(frozen=True)
class ParsedQuery:
    """A search string: what is outside quotes, and the quoted literals in order."""

    raw: str
    unquoted: str
    literals: tuple[str, ...] = field(default=())

    @property
    def quoted_only(self) -> bool:
        return bool(self.literals) and not self.unquoted

    @property
    def empty(self) -> bool:
        return not self.literals and not self.unquoted

    @property
    def words(self) -> list[str]:
        """Normalised words; terms with an underscore are identifiers, not words."""
        return normalize_text(" ".join(t for t in self.unquoted.split() if "_" not in t)).split()

    @property
    def required(self) -> list[str]:
        """Literals that must occur: the quoted ones, then identifiers."""
        return [*self.literals, *(t for t in self.unquoted.split() if "_" in t)]

    @property
    def lexical_text(self) -> str:
        return self.raw if self.quoted_only else self.unquoted


def parse(query: str) -> ParsedQuery:
    """Quotes toggle; blank quotes vanish; an open last quote still is a literal."""
    outside, literals = [], []
    for i, part in enumerate(query.split('"')):
        if i % 2 == 0:
            outside.append(part)
        elif part.strip():
            literals.append(part)
    return ParsedQuery(query, "".join(outside).strip(), tuple(literals))


def as_exact(query: str) -> ParsedQuery:
    """The whole query as one literal, as exact mode reads unquoted text."""
    return parse('"' + query.replace('"', "") + '"')


def effective_mode(query: ParsedQuery, given: str | None = None, configured: str | None = None) -> str:
    if query.quoted_only:
        return "exact"
    mode = given or configured or "lexical"
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def shown_mode(mode: str) -> str:
    """The mode an interactive list runs in: it has no exact and no hybrid one."""
    return "semantic" if mode == "semantic" else "lexical"


@dataclass(frozen=True)
class SearchOptions:
    """Settings of a search, read from ``[search]`` of a TOML file; unknown keys are errors."""

    mode: str = "lexical"
    top: int = 10
    hits_per_conversation: int = 2
    budget: int = 6000
    include_agents: bool = True
    exclude_projects: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")

    @classmethod
    def from_toml(cls, text: str) -> SearchOptions:
        import tomllib

        given = tomllib.loads(text).get("search", {})
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def is_uuid(query: str) -> bool:
    return bool(_UUID.fullmatch(query.strip()))


@dataclass(frozen=True)
class Ref:
    """A conversation by a prefix of its digest, with an optional range of messages."""

    prefix: str
    start: int | None = None
    end: int | None = None


_REF = re.compile(r"ch_([0-9a-fA-F]{8,32})(?::m(\d+)(?:\.\.m(\d+))?)?")


def parse_ref(text: str) -> Ref:
    m = _REF.fullmatch(text)
    if not m:
        raise ValueError(f"no conversation ref: {text!r}")
    if m[2] is None:
        return Ref(m[1].lower())
    start = int(m[2])
    end = int(m[3]) if m[3] else start
    if start < 1 or end < start:
        raise ValueError(f"no range of messages: {text!r}")
    return Ref(m[1].lower(), start, end)


def parse_range(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"m(\d+)(?:\.\.m(\d+))?", text)
    if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
        raise ValueError(f"no range of messages: {text!r}")
    return int(m[1]), int(m[2] or m[1])


def check_focus(refs: list[Ref], focus: tuple[int, int], ref: str | None = None) -> None:
    """A focus must lie inside a requested range; without a ref only one conversation may be read."""
    if ref is None and len({r.prefix for r in refs}) > 1:
        raise ValueError("a focus without a ref is ambiguous")
    mine = [r for r in refs if ref is None or r.prefix.startswith(ref) or ref.startswith(r.prefix)]
    if not any(r.start is None or (r.start <= focus[0] and focus[1] <= r.end) for r in mine):
        raise ValueError("the focus lies outside the requested ranges")


# FNV-1a with 128 bits, and the namespace of refs.
_NAMESPACE, _OFFSET, _PRIME = "agent-v1", 0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B


def digest(project: str, filename: str) -> str:
    """32 hex digits over the parts, each preceded by its length as eight bytes."""
    value = _OFFSET
    for part in (_NAMESPACE, project, filename):
        raw = part.encode()
        for byte in len(raw).to_bytes(8, "little") + raw:
            value = ((value ^ byte) * _PRIME) % (1 << 128)
    return f"{value:032x}"
