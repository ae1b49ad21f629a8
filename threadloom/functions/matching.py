"""Normalisation, word-prefix matching and literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters besides white space that separate words.
SEPARATORS = (
    "_-/"
    "\u3000\u3001\u3002\u3008\u3009\u300a\u300b\u300c\u300d\u300e\u300f\u3010\u3011\u3014\u3015\u3016\u3017"
    "\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f\u201c\u201d\u2018\u2019\u2014\u2026\u00b7"
)

# Unicode's white space.
_WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_TO_SPACE = "".join(dict.fromkeys(_WHITE + SEPARATORS))
_NO_LETTER_AT_END = r"[^\p{IsAlphabetic}\p{N}]\z"
CJK = r"[\x{4E00}-\x{9FFF}]"


def quote(text: str) -> str:
    """``text`` as a regular expression that matches it and nothing else."""
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|&#~ " else c for c in text)


def is_alphanumeric(c: str) -> bool:
    import unicodedata

    return c.isalpha() or unicodedata.category(c)[0] == "N" or c.isalnum()


def fold_case(col: Column) -> Column:
    """Lower case letter by letter: a capital sigma never becomes a final one."""
    return F.lower(F.replace(col, F.lit("Σ"), F.lit("σ")))


def normalize(col: Column | str) -> Column:
    """Each separator becomes one space, everything else is lower-cased; no trimming."""
    col = F.col(col) if isinstance(col, str) else col
    return fold_case(F.translate(col, _TO_SPACE, " " * len(_TO_SPACE)))


def normalize_text(text: str) -> str:
    """The same for a query on the driver."""
    return "".join(" " if c in SEPARATORS or c.isspace() and c not in "\x1c\x1d\x1e\x1f" else c.lower() for c in text)


def prefix_count(col: Column, word: str, cap: int) -> Column:
    """Occurrences of ``word`` at the start of a word, at most ``cap``.

    Occurrences do not overlap and are found from the left; one counts if it stands
    at the start or after a character that is neither letter nor digit.
    """
    if not word:
        return F.lit(0)
    tail_opens = not is_alphanumeric(word[-1])
    before = F.split(col, quote(word), -1)
    heads = F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))
    opens = F.filter(heads, lambda p, i: F.when(p == "", (i == 0) | F.lit(tail_opens)).otherwise(p.rlike(_NO_LETTER_AT_END)))
    return F.when(F.contains(col, F.lit(word)), F.least(F.size(opens), F.lit(cap))).otherwise(0)


def has_prefix(col: Column, word: str) -> Column:
    return F.contains(col, F.lit(word)) & (prefix_count(col, word, 1) > 0)


def adjacent_count(col: Column, words: list[str], cap: int = 3) -> Column:
    """Occurrences of neighbouring query words side by side, over all pairs at most ``cap``."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return F.least(F.lit(cap), sum((prefix_count(col, p, cap) for p in pairs), F.lit(0)))


def has_cjk(text: str) -> bool:
    return any("\u4e00" <= c <= "\u9fff" for c in text)


def word_matches(col: Column, word: str) -> Column:
    """Prefix match, or for CJK words any occurrence."""
    return (has_prefix(col, word) | F.contains(col, F.lit(word))) if has_cjk(word) else has_prefix(col, word)


def is_sensitive(literal: str) -> bool:
    """Smart case: a capital makes a literal case-sensitive."""
    return any(c.isupper() for c in literal)


def has_literal(col: Column, literal: str) -> Column:
    if is_sensitive(literal):
        return F.contains(col, F.lit(literal))
    return F.contains(fold_case(col), F.lit(literal.lower()))


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
