"""Find personal information in free text and put typed placeholders in its place.

Mailboxes, phone numbers, identity numbers and street addresses have shapes of their
own; an identity number also needs a label before it, or a person beside it. Names have
no shape. For them the corpus itself is asked which terms reveal the entities found by
shape. One pass counts, for every term, how often it occurs, is capitalised, stands
beside another capitalised term, and in which contexts (the two tokens before and after
a capitalised run). Then, on the aggregated counts alone:

1. Terms are *seeds* if mailboxes are named after them, or stand directly beside a mailbox.
2. Contexts are *cues* if most of what stands in them is a name so far. No cue is given
   in advance.
3. A term *discloses* a person in the share of its occurrences that stand at a cue or
   beside a name. In bits: the share over ``prior``, the share that any word would have.
   Terms above ``least_bits`` are names wherever they stand, in any case. Steps 2 and 3
   are done twice.

Names are removed for a placeholder. Places that are mostly written in addresses are
generalised where they stand alone (``[PLACE]``); they are learnt from addresses whose
end is marked by a postal code.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage

FIELDS = ("full_text", "preview_first", "agent_search_text")
KINDS = ("email", "phone", "id_number", "address", "name")


@dataclass(frozen=True)
class Options:
    """``prior``: the share of words that are names in any text. ``least_bits``: what a
    term must disclose to be a name; 4.3 bits over 0.01 are a fifth of its occurrences.
    ``least_cue``: share of names that a context must hold to be a cue.
    ``least_names``: different names that must stand in it.
    ``broadcast_terms``: a larger lexicon is joined to the texts' terms instead of
    being sent to every executor; the result is the same."""

    prior: float = 0.01
    least_bits: float = 4.3
    least_cue: float = 0.5
    least_names: int = 3
    broadcast_terms: int = 200_000


# -- fixed shapes and words ------------------------------------------------------------

#: Mailboxes of functions, not of persons (fixed words).
ROLE_MAILBOXES = frozenset("git root admin noreply no-reply donotreply do-not-reply postmaster mailer-daemon daemon build bot support info".split())

_AT = re.compile(r"@|\s?\(at\)\s?|\s?\[at\]\s?| at ", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9](?:[\w.+'-]|(?: dot | ?\[dot\] ?| ?\(dot\) ?)(?=\w))*$", re.I)
_DOT_LOCAL = re.compile(r"(?:^|(?<=[\s:=<(\",;|]))[\w+-]+(?: dot [\w+-]+)*$", re.I)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| dot | ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]+)+", re.I)
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)
_TOP = re.compile(r"[A-Za-z]{2,24}$")
_SPELT_DOT = re.compile(r" dot |\[dot\]|\(dot\)", re.I)

_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_PHONE = re.compile(
    r"(?<![\w+.:/@#$-])(?:"
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"  # North America with country code
    r"|1[ .-](?:\(\d{3}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}"  # and with the trunk prefix
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}"
    r"|\+(?!1)[1-9]\d{0,2}(?: ?\(0\) ?| |-)?\d{2,5}(?:[ -]?\d{2,8}){1,3}"  # other country codes
    r"|07\d{3} ?\d{6}|0\d{2} \d{4} \d{4}|0\d{4} \d{5,6}"  # Britain
    r"|0\d{1,4} \d{4,6} \d{2,4}|0\d{2,4}/\d{5,9}"  # Germany
    r"|0[1-9](?:[ .]\d{2}){4}"  # France
    r"|0\d{1,2}-\d{3} \d{3} \d{2}|0\d{1,2}-\d{2,3}(?: \d{2}){2,3}"  # Sweden
    r"|\(\d{2}\) ?9?\d{4}-\d{4}"  # Brazil
    rf"|{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{6,14}}"  # spelt out
    r")(?![\w@]|[.:,]\d|-\d)",
    re.I,
)
#: Bank accounts hold what looks like a phone number.
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")

_ID_SHAPE = (
    r"(?<![\w+.:/@#$-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}"
    r"|(?:19|20)?\d{6}[-+]\d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]{1,2}\d{6,8}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{11}"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r")(?![\w@]|[.:,]\d|-\d)"
)
#: Numbers that are made of a person's data or carry check digits need no label.
_ID_ALONE = re.compile(r"(?<![\w.-])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])")
#: Labels of the numbers that a state gives a person (fixed words).
_ID_LABEL = (
    r"(?:ssn|social[ _]security|national[ _]insurance|national[ _]id|passport|identity[ _]card|id[ _]card|tax[ _]id|driv(?:ing|er'?s?) licen[cs]e|"
    r"ausweis\w*|personalausweis\w*|reisepass\w*|steuer-?id\w*|personnummer|numéro de sécurité(?: sociale)?|carte d'identité|dni|nif|nie|"
    r"codice fiscale|carta d'identità|cpf|pesel|bsn|documento de identidad|pasaporte|passaporto)"
)
_ID_LABELLED = re.compile(rf"(?<!\w){_ID_LABEL}\W*?(?:(?:number|nummer|no|num|nr|is|says|said|was|n°|#)\W*?){{0,3}}(?P<id>{_ID_SHAPE})", re.I)
#: Between a person and the person's number: punctuation and at most three words.
_NUMBER_BESIDE = re.compile(rf" ?[,;:(|\t] ?(?:[^\W\d_]+[ :.#]*){{0,3}}?(?P<id>{_ID_SHAPE})")

#: Kinds of streets (fixed words).
_STREET = r"(?:Court|Lane|Street|Terrace|Road|Rd|Way|Crescent|Avenue|Ave|Boulevard|Blvd|Drive|Square|Row|Close|Place|Hill|Gardens|Mews|Walk|Parkway|St|Dr|Ct|Ln|Pl|Sq)"
_STREET_FIRST = r"(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Ll]argo|[Cc]alle|[Aa]venida|[Pp]aseo|[Pp]laza|[Cc]arrer|[Cc]arretera|[Rr]ua|[Pp]raça|[Tt]ravessa|[Uu]l\.|[Uu]lica|[Aa]l\.)"
_SHORT = re.compile(r" (?:Rd|St|Dr|Ct|Ln|Pl|Sq)\.$")
_CITY_WORD = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_UNIT_NO = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|No\.) ?\d{1,4}[A-Za-z]?, )?"
_STREET_LINE = re.compile(
    rf"(?<![\w.:/-])(?:{_UNIT_NO}\d{{1,5}}[A-Za-z]? (?:[A-Z][\w'’-]* ){{1,3}}?{_STREET}\b\.?(?: {_STREET}\b\.?)?"
    r"|(?:[A-ZÄÖÜÅØÆ][a-zäöüßåøæé]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|straat|laan|plein|gracht|kade|gatan|vägen|gata|gate|veien|vej|gade|katu|tie)) \d{1,4} ?[a-z]?\b"
    r"|\d{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée) (?:(?:de la|de l'|des|du|de|d') ?)?"
    rf"(?:{_CITY_WORD})(?: {_CITY_WORD})?)"
)
_STREET_FIRST_LINE = re.compile(
    rf"(?<![\w.:/-]){_STREET_FIRST} (?:(?:de|del|della|delle|dei|di|da|do|dos|das|la|las|los|el) ){{0,2}}{_CITY_WORD}(?: (?:(?:de|del|di|e|y) )?{_CITY_WORD}){{0,3}},? (?:n[.º°]? ?)?\d{{1,5}}[A-Za-z]?\b"
)
#: One of these, in lower case, stands in every text that the rarer patterns can match (fixed words).
_STREET_MARKS = ("via ", "viale ", "piazza ", "corso ", "largo ", "calle ", "avenida ", "paseo ", "plaza ", "carrer", "rua ", "praça ", "travessa ", "ul. ", "ulica ", "al. ")
_ID_MARKS = ("ssn", "social", "national", "passport", "identity", "card", "tax", "licen", "ausweis", "reisepass", "steuer", "personnummer", "numéro", "identité", "dni", "nif", "nie", "fiscale", "identità", "cpf", "pesel", "bsn", "identidad", "pasaporte", "passaporto")
_STRONG_MARKS = ("Dr. ", "Mr. ", "Mrs. ", "Ms. ", "Prof. ", "Author:", "-by:")
_POST_CODE = r"(?:\d{5}(?:-\d{3,4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})"
_CITY_CODE = re.compile(rf"(?:, |,?\s)({_CITY_WORD}(?: {_CITY_WORD}){{0,2}}),? (?:[A-Z]{{2}},? )?{_POST_CODE}(?!\w)")
_CODE_CITY = re.compile(rf"(?:, |,?\s)(?:\d{{5}}|\d{{4}} [A-Z]{{2}}|\d{{3}} \d{{2}}|(?<=, )\d{{4}}|\d{{2}}-\d{{3}}) ({_CITY_WORD})(?: ({_CITY_WORD}))?")
_ONLY_CITY = re.compile(rf", ({_CITY_WORD})(?: ({_CITY_WORD}))?")

_TOKEN = re.compile(r"[^\W\d_]+")
#: Titles, speakers and words of form that are no names wherever they stand (fixed words).
_NO_NAMES = frozenset("the a an and or on in at to for of is as this that each our it no then now next we they he she you i who what which please dr mr mrs ms prof herr frau mme author name email phone mail tel user assistant".split())


# -- shapes --------------------------------------------------------------------------


def _local_part(text: str, end: int, pattern: re.Pattern) -> str | None:
    """The part of a mailbox that ends at ``end``, of any length."""
    size = 80
    while True:
        m = pattern.search(text[max(0, end - size) : end])
        if not m or m.start() > 0 or size >= end:
            return m and m[0]
        size *= 8  # it may begin before the window


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Start and end of each person's mailbox, and where its local part ends."""
    for m in _AT.finditer(text):
        spelt = m[0].lower() == " at "
        domain = (_SPELT_DOMAIN if spelt else _DOMAIN).match(text, m.end())
        local = domain and _local_part(text, m.start(), _DOT_LOCAL if spelt else _LOCAL)
        if not local:
            continue
        a, b = m.start() - len(local), domain.end()
        if not _TOP.search(domain[0]) or (spelt and text[b : b + 4] == " at "):
            continue
        if local.lower().partition("+")[0] in ROLE_MAILBOXES or (text[b : b + 1] in ("/", ":") and text[b + 1 : b + 2].isalnum()):
            continue
        yield a, b, m.start()


def _has_mail(text: str) -> bool:
    return "@" in text or " at " in text or "(at)" in text or "[at]" in text


def _any_of(marks: tuple[str, ...], text: str) -> bool:
    return any(mark in text for mark in marks)


def _street_lines(text: str) -> Iterator[re.Match]:
    yield from _STREET_LINE.finditer(text)
    if _any_of(_STREET_MARKS, text.lower()):
        yield from _STREET_FIRST_LINE.finditer(text)


def _addresses(text: str, places) -> Iterator[tuple[int, int]]:
    for m in _street_lines(text):
        a, b = m.span()
        tail = _CITY_CODE.match(text, b)
        if tail:
            yield a, tail.end()
            continue
        tail = _CODE_CITY.match(text, b) or _ONLY_CITY.match(text, b)
        if tail:
            both = tail[2] and f"{tail[1]} {tail[2]}"
            if both and (both in places or (tail[1] not in places and not text[tail.end() : tail.end() + 1].isalnum() and text[tail.end() : tail.end() + 1] not in (" ", "'"))):
                b = tail.end(2)
            elif tail.re is _CODE_CITY or tail[1] in places or text[tail.end(1) : tail.end(1) + 1] in ("", "\n", '"', ".", ";", "|", ")"):
                b = tail.end(1)
        # The dot of a short form belongs to the address, that of a sentence does not.
        yield a, b if b > m.end() or text[b - 1] != "." or _SHORT.search(text, a, b) else b - 1


def shaped(text: str, places) -> list[tuple[int, int, str]]:
    """Mentions that have a shape of their own, in order and without overlaps.

    ``places`` answers ``in`` for names of places.
    """
    found: list[tuple[int, int, str]] = []
    if _has_mail(text):
        found += [(a, b, "email") for a, b, _ in _emails(text)]
    found += [(a, b, "address") for a, b in _addresses(text, places)]
    if _any_of(_ID_MARKS, text.lower()):
        found += [(*m.span("id"), "id_number") for m in _ID_LABELLED.finditer(text)]
    found += [(*m.span(), "id_number") for m in _ID_ALONE.finditer(text)]
    phones = [(*m.span(), "phone") for m in _PHONE.finditer(text)]
    accounts = [m.span() for m in _IBAN.finditer(text)] if phones else []
    found += [p for p in phones if not any(a <= p[0] < b for a, b in accounts)]
    return _apart(found)


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The mentions in order, without those that overlap an earlier one of the list."""
    if len(found) < 2:
        return found
    order = sorted(range(len(found)), key=lambda i: found[i][:2])
    kept: list[int] = []
    for i in order:
        if kept and found[kept[-1]][1] > found[i][0]:
            if i > kept[-1]:
                continue
            while kept and found[kept[-1]][1] > found[i][0] and i < kept[-1]:
                kept.pop()
            if kept and found[kept[-1]][1] > found[i][0]:
                continue
        kept.append(i)
    return [found[i] for i in kept]


def _numbers_beside(text: str, people: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Numbers in the shape of an identity number directly after a person's mention."""
    out = []
    for _, b, _ in people:
        m = _NUMBER_BESIDE.match(text, b)
        if m and not any(x < m.end() and m.start("id") < y for x, y, _ in taken):
            out.append((*m.span("id"), "id_number"))
    return out


# -- what terms disclose -----------------------------------------------------------------

#: Stand for a mailbox and a street among the tokens of a text.
MAILBOX, ADDRESS = "✉", "⌂"
_UNIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_PART = re.compile(r"[^\W\d_]{2,}")
_PLAIN = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "ł": "l", "đ": "d", "œ": "oe"})


def folded(term: str) -> str:
    """``term`` as mailboxes spell it, without marks on letters."""
    if term.isascii():
        return term
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c)).translate(_PLAIN)


class _Counts:
    """What one task has counted and not yet given on."""

    def __init__(self):
        self.total: Counter[str] = Counter()
        self.upper: Counter[str] = Counter()
        self.seeds: Counter[tuple[str, str]] = Counter()
        self.before: Counter[tuple[str, str]] = Counter()
        self.after: Counter[tuple[str, str]] = Counter()
        self.pairs: Counter[tuple[str, str]] = Counter()
        self.places: Counter[str] = Counter()

    def read(self, text: str) -> None:
        marks = []
        for m in _street_lines(text):
            tail = _CITY_CODE.match(text, m.end())
            if tail:
                self.places[tail[1]] += 1
            marks.append((*m.span(), ADDRESS))
        if _has_mail(text):
            for a, b, end in _emails(text):
                parts = _PART.findall(_SPELT_DOT.sub(".", text[a:end]).lower().partition("+")[0])
                if len(parts) == 2:
                    self.seeds[parts[0], "given"] += 1
                    self.seeds[parts[1], "family"] += 1
                marks.append((a, b, MAILBOX))
        for a, b, mark in sorted(marks, reverse=True):  # mentions of their own
            text = f"{text[:a]}{mark}{text[b:]}"
        units = _UNIT.findall(text)
        low = [u.lower() for u in units]
        self.total.update(low)
        capital = [i for i, u in enumerate(units) if u[0].isupper() and len(u) > 1]
        self.upper.update([low[i] for i in capital])
        self._runs(units, low, capital)

    def _runs(self, units: list[str], low: list[str], capital: list[int]) -> None:
        n, k = len(units), 0

        def at(i: int) -> str:
            if not 0 <= i < n:
                return "^"
            u = low[i]
            return "9" if u[0].isdigit() else u if len(u) > 1 or not u.isalpha() else "x"

        while k < len(capital):
            first = last = capital[k]
            members, lead = 1, ""
            while k + 1 < len(capital):
                step = capital[k + 1] - last
                dash = step == 2 and units[last + 1] == "-"
                initial = step == 3 and units[last + 2] == "." and len(units[last + 1]) == 1 and units[last + 1].isupper()
                if not (step == 1 or dash or initial):
                    break
                k += 1
                if not dash:
                    lead = low[last]
                if lead:
                    self.pairs[lead, low[capital[k]]] += 1
                last = capital[k]
                members += 1
            k += 1
            if members <= 5:
                self.before[low[first], f"{at(first - 2)} {at(first - 1)}"] += 1
                self.after[low[last], f"{at(last + 1)} {at(last + 2)}"] += 1
            if last + 2 < n and units[last + 1] == "," and units[last + 2][0].isupper():
                self.pairs[low[last + 2], low[last]] += 1

    def __len__(self) -> int:
        return sum(map(len, (self.total, self.before, self.after, self.pairs)))

    def give(self) -> pa.RecordBatch:
        rows = [("term", t, folded(t), n, self.upper[t]) for t, n in self.total.items() if t[0].isalpha()]
        for kind, counts in (("seed", self.seeds), ("before", self.before), ("after", self.after), ("pair", self.pairs)):
            rows += [(kind, a, b, n, 0) for (a, b), n in counts.items()]
        rows += [("place", p, "", n, 0) for p, n in self.places.items()]
        self.__init__()
        c = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], names=["kind", "a", "b", "n", "m"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, seeds, contexts, pairs and places, each summed up in the task."""
    counts = _Counts()
    for batch in batches:
        for text in batch.column(0):
            counts.read(text.as_py())
            if len(counts) > 1_000_000:
                yield counts.give()
    yield counts.give()


def disclosure(share: float, prior: float) -> float:
    """Bits by which a term raises the odds that a person is named."""
    return math.log2(share / prior) if share > 0 else -math.inf


def _once(texts: DataFrame) -> DataFrame:
    """Each distinct text of the three columns; those inside the full text of their row are in it."""
    full = F.coalesce("full_text", F.lit(""))
    fields = [F.col(f) if f == "full_text" else F.when(~F.contains(full, F.col(f)), F.col(f)) for f in FIELDS]
    return texts.select(F.explode(F.array(*fields)).alias("text")).where(F.col("text") != "").dropDuplicates(["text"])


def _disclosing(terms: DataFrame, contexts: DataFrame, pairs: DataFrame, names: DataFrame, options: Options, cues: DataFrame | None = None) -> DataFrame:
    """Terms with the share of their occurrences at a cue or beside a name: ``term, share``."""
    if cues is None:
        known = names.select(F.col("term").alias("a"), F.lit(1).alias("known"))
        inside = contexts.join(known, "a", "left")
        cues = (
            inside.groupBy("kind", "b")
            .agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("named"), F.sum("known").alias("names"))
            .where((F.col("named") >= options.least_cue * F.col("all")) & (F.col("names") >= options.least_names) & F.col("b").rlike(r"\p{L}{2}|" + MAILBOX))
        )
    at = contexts.join(cues.select("kind", "b"), ["kind", "b"], "left_semi").groupBy("a").agg(
        F.sum(F.when(F.col("kind") == "before", F.col("n"))).alias("before"), F.sum(F.when(F.col("kind") == "after", F.col("n"))).alias("after")
    )
    # A given name stands before family names, a family name after given ones. What also
    # stands before given names is a label or a title.
    role = names.select(F.col("term").alias("known"), "kind")
    first = pairs.join(role, pairs["b"] == role["known"]).select("a", F.when(F.col("kind") == "family", F.col("n")).otherwise(-F.col("n")).alias("ahead"), F.lit(0).alias("behind"))
    second = pairs.join(role, pairs["a"] == role["known"]).where(F.col("kind") == "given").select(F.col("b").alias("a"), F.lit(0).alias("ahead"), F.col("n").alias("behind"))
    beside = first.unionByName(second).groupBy("a").agg((F.greatest(F.sum("ahead"), F.lit(0)) + F.sum("behind")).alias("beside"))
    best = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)), F.coalesce("beside", F.lit(0)))
    found = at.join(beside, "a", "full_outer").select(F.col("a").alias("term"), best.alias("best"))
    return terms.join(found, "term").select("term", F.least(F.col("best") / F.col("total"), F.lit(1.0)).alias("share"))


def _with_roles(found: DataFrame, before: DataFrame, pairs: DataFrame) -> DataFrame:
    """``term, share, kind`` of new and earlier names; a kind that is known already stays.

    New names are ``given`` if they stand first in more pairs of names than they stand last.
    """
    share = F.col("share") if "share" in before.columns else F.lit(None).cast("double")
    names = found.select("term", "share", F.lit(None).cast("string").alias("kind")).unionByName(before.select("term", share.alias("share"), "kind"))
    names = names.groupBy("term").agg(F.max("share").alias("share"), F.max("kind").alias("kind"))
    known = names.select(F.col("term").alias("known"))
    inside = pairs.join(known, pairs["a"] == known["known"], "left_semi").join(known, pairs["b"] == known["known"], "left_semi")
    place = inside.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("n").alias("v")), F.struct(F.col("b").alias("term"), (-F.col("n")).alias("v")))).alias("e"))
    place = place.groupBy("e.term").agg(F.sum("e.v").alias("v"))
    return names.join(place, "term", "left").select("term", "share", F.coalesce("kind", F.when(F.col("v") > 0, "given").otherwise("family")).alias("kind"))


def lexicon(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """Terms that disclose persons, and places: ``kind, term, bits``.

    ``kind`` is ``given`` or ``family`` (by the place a term mostly has in names) or
    ``place``. A term must be capitalised in half of its occurrences. Counts are summed
    in each task before they are shuffled; a text that comes several times, or inside
    the full text of its own row, counts once. All thresholds are shares: how many
    other texts there are plays no part. The result is a table in the shared folder, so
    it can be passed to :func:`mentions` and :func:`redacted` without being made again.
    """
    counts = cut_lineage(_once(texts).mapInArrow(_tally, "kind string, a string, b string, n long, m long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    of = lambda kind: counts.where(F.col("kind") == kind)
    terms = of("term").select(F.col("a").alias("term"), F.col("b").alias("plain"), F.col("n").alias("total"), F.col("m").alias("upper"))
    terms = terms.where((F.col("upper") * 2 >= F.col("total")) & (F.length("term") > 1) & ~F.col("term").isin(*sorted(_NO_NAMES)))
    contexts, pairs = counts.where(F.col("kind").isin("before", "after")).select("kind", "a", "b", "n"), of("pair").select("a", "b", "n")
    least = options.prior * 2.0**options.least_bits
    mail = of("seed").groupBy(F.col("a").alias("plain")).agg(F.sum(F.when(F.col("b") == "given", F.col("n")).otherwise(-F.col("n"))).alias("v"))
    mailed = terms.where(F.length("plain") > 2).join(mail, "plain").select("term", F.when(F.col("v") > 0, "given").otherwise("family").alias("kind"))
    at_mail = contexts.where(F.array_contains(F.split("b", " "), MAILBOX)).select("kind", "b").distinct()
    beside_mail = _disclosing(terms, contexts, pairs, mailed.where(F.lit(False)), options, at_mail).where(F.col("share") >= least)
    seeds = cut_lineage(_with_roles(beside_mail, mailed, pairs), "names")
    names = seeds
    for _ in range(2):
        found = _disclosing(terms, contexts, pairs, names, options).where(F.col("share") >= least)
        # Seeds stay names even where the corpus has no cue for them.
        names = cut_lineage(_with_roles(found, seeds, pairs), "names")
    people = names.select("kind", "term", F.log2(F.col("share") / options.prior).alias("bits"))
    # A place discloses an address in the share of its occurrences that end one.
    inside = of("place").select(F.col("a").alias("term"), F.col("n").alias("inside"), F.split(F.lower("a"), "[ '’-]+").alias("w"))
    one = inside.where(F.size("w") == 1).join(of("term").select(F.col("a").alias("t"), F.col("m").alias("all")), F.col("w")[0] == F.col("t"), "left")
    two = inside.where(F.size("w") > 1).join(pairs.select(F.col("a").alias("t"), F.col("b").alias("u"), F.col("n").alias("all")), (F.col("w")[0] == F.col("t")) & (F.col("w")[1] == F.col("u")), "left")
    share = F.least(F.col("inside") / F.greatest(F.coalesce("all", F.lit(1)), F.col("inside")), F.lit(1.0))
    places = one.select("term", share.alias("share")).unionByName(two.select("term", share.alias("share"))).select(F.lit("place").alias("kind"), "term", F.log2(F.col("share") / options.prior).alias("bits"))
    return cut_lineage(people.unionByName(places), "lexicon")


# -- names ---------------------------------------------------------------------------


_INITIAL_BEFORE = re.compile(r"(?<![^\W_])[^\W\d_]\. ?$")
_MIDDLE = re.compile(r" [^\W\d_]\. ?")


def named(text: str, roles: dict[str, str], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Names built of terms that disclose persons, outside the mentions ``taken``."""
    hits = []
    for m in _TOKEN.finditer(text):
        role = roles.get(m[0].lower())
        if role:
            hits.append((m.start(), m.end(), role))
    out: list[list] = []  # start, end, last role, has a given name, is one family name so far
    k = 0
    for a, b, role in hits:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        if out:
            last = out[-1]
            gap = text[last[1] : a]
            joined = (
                gap == "-"
                or (gap in (" ", " ") or _MIDDLE.fullmatch(gap)) and last[2] == "given" and role == "family"
                or gap == ", " and last[4] and role == "given"
            )
            if joined:
                only_family = last[4] and gap == "-" and role == "family"
                last[1], last[2], last[3], last[4] = b, ("done" if gap == ", " else role), last[3] or role == "given", only_family
                continue
        start = a
        if role == "family":
            initial = _INITIAL_BEFORE.search(text[max(0, a - 4) : a])
            if initial:
                start = a - len(initial[0])
        out.append([start, b, role, role == "given", role == "family"])
    return [(a, b) for a, b, *_ in out]


#: Words that only a person's name follows: labels of authors, and titles (fixed words).
_LABEL = r"(?:Author|[Aa]uthored-by|Signed-off-by|Reviewed-by|Reported-by|Acked-by): ?"
_TITLE = r"(?<![^\W\d_] )(?:Dr|Mr|Mrs|Ms|Prof)\. |(?<=[a-zß-öø-ÿ] )(?:Dr|Mr|Mrs|Ms|Prof)\. "
_GIVEN = r"(?=[^\W\d_a-zß-öø-ÿ])[^\W\d_]{2,}(?:-[^\W\d_]{2,})*(?![\w@(/.:+]\w|[@_])"
_STRONG = re.compile(rf"(?:(?P<label>\b{_LABEL})|{_TITLE})(?P<run>{_GIVEN}(?: (?:[^\W\d_]\. )?{_GIVEN})?)")


def _at_strong_cues(text: str, names: list[tuple[int, int]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """``names`` with the capitalised runs at strong cues, whatever the corpus says of their terms.

    A title's run is added where no name was found, an author's also takes up its parts.
    """
    for m in _STRONG.finditer(text) if _any_of(_STRONG_MARKS, text) else ():
        a, b = m.span("run")
        while b > a and (words := _TOKEN.findall(text[a:b])) and words[-1].lower() in _NO_NAMES:
            b = a + len(text[a:b][: -len(words[-1])].rstrip(" .-"))
        over = [(x, y) for x, y in names if x < b and a < y]
        if b <= a or any(x < b and m.start() < y for x, y, _ in taken) or any(x < a or y > b for x, y in over) or (over and not m["label"]):
            continue
        names = [n for n in names if n not in over] + [(a, b)]
    return names


def mentions_of(text: str, roles: dict[str, str], places) -> list[tuple[int, int, str]]:
    """All mentions in a text: character offsets, the end exclusive, and the kind."""
    taken = shaped(text, places)
    names = [(a, b, "name") for a, b in _at_strong_cues(text, named(text, roles, taken), taken)]
    people = names + [t for t in taken if t[2] == "email"]
    numbers = _numbers_beside(text, people, taken) if people else []
    return sorted(_apart(numbers + taken + names))


def generalised(text: str, found: list[tuple[int, int, str]], places) -> list[tuple[int, int, str]]:
    """Places that stand outside the mentions ``found``, as mentions of the kind ``place``."""
    out = []
    for m in _PLACE_START.finditer(text):
        words = m[0].split(" ")
        for i in range(len(words)):
            start = m.start() + len(" ".join(words[:i])) + (i > 0)
            hit = next((w for n in (3, 2, 1) if (w := " ".join(words[i : i + n])) in places), None)
            if hit and not any(x < start + len(hit) and start < y for x, y, _ in (*found, *out)):
                out.append((start, start + len(hit), "place"))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with a placeholder such as ``[EMAIL]`` for each mention."""
    out, at = [], 0
    for a, b, kind in found:
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    out.append(text[at:])
    return "".join(out)


# -- over tables ---------------------------------------------------------------------


_FOUND = "entry_id long, field_name string, char_start int, char_end int, pii_kind string"


def _words(terms) -> tuple[dict[str, str], set[str]]:
    roles, places = {}, set()
    for r in terms:
        if r["kind"] == "place":
            places.add(r["term"])
        else:
            roles[r["term"]] = r["kind"]
    return roles, places


def _rows(batch: pa.RecordBatch, shared) -> Iterator[tuple[int, str, str, dict, set]]:
    """Row number, field, text and its lexicon, for every text that is not empty."""
    names = batch.schema.names
    own = batch.column(names.index("terms")).to_pylist() if "terms" in names else None
    lists = None if own is None else [_words(t or ()) for t in own]
    for field in FIELDS:
        for i, text in enumerate(batch.column(names.index(field))):
            text = text.as_py()
            if text:
                yield i, field, text, *(shared.value if lists is None else lists[i])


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column(0).to_pylist()
            rows = [(entries[i], field, a, b, kind) for i, field, text, roles, places in _rows(batch, shared) for a, b, kind in mentions_of(text, roles, places)]
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())],
                names=["entry_id", "field_name", "char_start", "char_end", "pii_kind"],
            )

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {f: batch.column(batch.schema.names.index(f)).to_pylist() for f in FIELDS}
            counts = [0] * batch.num_rows
            for i, field, text, roles, places in _rows(batch, shared):
                found = mentions_of(text, roles, places)
                counts[i] += len(found)
                texts[field][i] = redact(text, sorted(found + generalised(text, found, places)))
            columns = [batch.column(0), *[pa.array(texts[f], pa.string()) for f in FIELDS], pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["entry_id", *FIELDS, "mentions"])

    return run


_PLACE_START = re.compile(rf"{_CITY_WORD}(?: {_CITY_WORD})*")


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text that a lexicon may hold: all words, and capitalised runs."""
    for batch in batches:
        ids, terms = [], []
        for i in range(batch.num_rows):
            own: set[str] = set()
            for column in batch.columns[1:]:
                text = column[i].as_py()
                if text:
                    own.update(w.lower() for w in _TOKEN.findall(text))
                    for m in _PLACE_START.finditer(text):
                        words = m[0].split(" ")
                        own.update(" ".join(words[a : a + n]) for a in range(len(words)) for n in (1, 2, 3))
            ids += [batch.column(0)[i].as_py()] * len(own)
            terms += own
            if len(ids) > 200_000:
                yield pa.RecordBatch.from_pydict({"row_key": pa.array(ids, pa.string()), "term": terms})
                ids, terms = [], []
        yield pa.RecordBatch.from_pydict({"row_key": pa.array(ids, pa.string()), "term": pa.array(terms, pa.string())})


def _prepared(entries: DataFrame, options: Options, terms: DataFrame | None):
    """The texts, joined with their own terms if the lexicon is too large to send.

    Texts meet their terms by a digest of the texts, so ids may be null or repeated.
    """
    texts = entries.select(F.col("entry_id").cast("long").alias("entry_id"), *FIELDS)
    terms = lexicon(texts, options) if terms is None else terms
    size = terms.limit(options.broadcast_terms + 1).count()
    if size <= options.broadcast_terms:
        return texts, entries.sparkSession.sparkContext.broadcast(_words(terms.select("kind", "term").collect()))
    key = F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)
    keyed = texts.withColumn("row_key", key)
    met = keyed.select("row_key", *FIELDS).dropDuplicates(["row_key"]).mapInArrow(_own_terms, "row_key string, term string").join(terms.select("kind", "term"), "term")
    lists = met.groupBy("row_key").agg(F.collect_set(F.struct("kind", "term")).alias("terms"))
    return keyed.join(lists, "row_key", "left").select("entry_id", *FIELDS, "terms"), None


def mentions(entries: DataFrame, options: Options = Options(), terms: DataFrame | None = None) -> DataFrame:
    """Every mention: ``entry_id, field_name, char_start, char_end, pii_kind``.

    Offsets count Unicode characters from 0, the end is exclusive. Mentions do not
    overlap. ``terms`` is a lexicon made before; by default it is made of ``entries``.

    Defined results: null and empty texts have none; texts are read whole, of any
    length; rows that come twice are read twice; rows without an id keep a null id; an
    empty table has no mentions; other columns may have any name.
    """
    texts, shared = _prepared(entries, options, terms)
    return texts.mapInArrow(_find(shared), _FOUND)


def redacted(entries: DataFrame, options: Options = Options(), terms: DataFrame | None = None) -> DataFrame:
    """The three texts with placeholders for all mentions, and how many there were.

    Places that stand alone are generalised to ``[PLACE]``; they do not count as mentions.
    """
    texts, shared = _prepared(entries, options, terms)
    return texts.mapInArrow(_clean(shared), "entry_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", mentions int")
