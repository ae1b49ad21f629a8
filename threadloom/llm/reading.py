"""Estimate how demanding the prose of a document is to read.

A familiar-word formula: the share of words outside a list of familiar words and the
mean length of sentences. The list is not given but derived: a word is familiar if it
stands in at least a given share of the corpus' documents. At most (mean number of
distinct words per document) / share words can reach it, so the list stays small
however large the corpus is. Weights and cut points are fitted to labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import blank_to_null
from threadloom.session import cut_lineage


@dataclass(frozen=True)
class Options:
    """``shares``: document shares tried for the familiar list, rising; the one that
    fits the labels best is taken. ``own_language``: the share of the words that tell the
    language; lines in which fewer than ``own_share`` of the words reach it are in another
    language and no part of the document's prose. ``label_limit``: labelled documents used
    for fitting, chosen by hash. ``prior``: what the published formula weighs, in labels.
    ``least_words``: shorter prose gets no level."""

    shares: tuple[float, ...] = (0.01, 0.03, 0.1, 0.25, 0.3, 0.35)
    own_language: float = 0.25
    label_limit: int = 20_000
    prior: float = 5.0
    least_words: int = 5
    own_share: float = 0.1


_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOP = re.compile(r"[.!?…]+(?=[\s\"'”’)]|$)")
#: Lines that are no prose: stamped logs, headings, tables, JSON, settings, paths.
_NO_PROSE = re.compile(
    r"\d{4}-\d\d-\d\d[T ]\d\d:|#|\||[{}\[\]<]|[\w.-]+\s*[:=]\s*\S+$|\S*[/\\]\S*$|\s{4,}|.*[;{}]\s*$"
)
_LEAD = re.compile(r"(?:>\s*)*(?:(?:[-*+•]|\d+[.)])\s+)?(?:[A-Z]\w{2,15}:\s+)?")
_CODE = re.compile(r"`[^`\n]*`")
_PATH = re.compile(r"\S*[/\\]\S*")
#: Marks inside words that readers do not see.
_UNSEEN = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff*_"))


def prose_lines(text: str) -> list[str]:
    """Lines of running text, without code, logs, tables, list marks and speaker labels."""
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _CODE.sub(" ", text)
    out = []
    for line in text.splitlines():
        if len(line) < 3 or _NO_PROSE.match(line):
            continue
        line = line[_LEAD.match(line).end() :]
        if "/" in line or "\\" in line:
            line = _PATH.sub(" ", line)
        if line:
            out.append(line if line.isascii() and "*" not in line and "_" not in line else line.translate(_UNSEEN))
    return out


def is_english(lang: Column | str) -> Column:
    """True where the language tag is English, whatever its case or region."""
    tag = F.lower(blank_to_null(lang))
    return F.coalesce(tag.rlike(r"^en(g|glish)?([-_].*)?$"), F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and documents in all (the empty word), batch by batch."""
    seen: Counter[str] = Counter()
    docs = 0

    def give():
        return pa.RecordBatch.from_pydict({"word": ["", *seen], "docs": pa.array([docs, *seen.values()], pa.int64())})

    for batch in batches:
        for text in batch.column(0):
            words = set(_WORD.findall("\n".join(prose_lines(text.as_py())).lower()))
            if words:
                docs += 1
                seen.update(words)
        if len(seen) > 500_000:
            yield give()
            seen.clear()
            docs = 0
    yield give()


def familiar_words(texts: DataFrame, options: Options = Options()) -> dict[str, int]:
    """Familiar words with the number of ``options.shares`` they reach.

    ``texts`` has one column. Counts are summed per partition before the shuffle and
    only words above the least share come to the driver.
    """
    counts = texts.mapInArrow(_count_words, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).persist()
    total = counts.where(F.col("word") == "").agg(F.sum("docs")).first()[0] or 0
    rows = counts.where((F.col("word") != "") & (F.col("docs") >= max(1, min(options.shares) * total))).collect() if total else []
    counts.unpersist()
    return {r["word"]: sum(r["docs"] >= s * total for s in options.shares) for r in rows}


def _measure(shared, n_shares: int, own_from: int, own_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.get
        for batch in batches:
            n = batch.num_rows
            words = np.zeros(n, np.int64)
            sentences = np.zeros(n, np.int64)
            strange = np.zeros((n_shares, n), np.int64)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                reached: Counter = Counter()
                for line in prose_lines(text):
                    got = Counter(map(level, _WORD.findall(line.lower())))
                    total = got.total()
                    if not total or sum(n for at, n in got.items() if at is not None and at > own_from) < own_share * total:
                        continue
                    reached.update(got)
                    words[i] += total
                    stops = _STOP.findall(line)
                    sentences[i] += len(stops) + (line.rstrip()[-1:] not in ".!?…\"'”’)")
                    if not stops and line.rstrip()[-1:] in "\"'”’)":
                        sentences[i] += 1
                for k in range(n_shares):
                    strange[k, i] = words[i] - sum(c for at, c in reached.items() if at is not None and at > k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(np.maximum(sentences, 1)), *[pa.array(s) for s in strange]],
                names=["doc_id", "words", "sentences", *[f"strange_{k}" for k in range(n_shares)]],
            )

    return run


def measures(documents: DataFrame, familiar: dict[str, int], options: Options = Options()) -> DataFrame:
    """``doc_id, words, sentences, strange_0..``: counts over the prose of each document."""
    columns = "".join(f", strange_{k} long" for k in range(len(options.shares)))
    shared = documents.sparkSession.sparkContext.broadcast(familiar)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _measure(shared, len(options.shares), sum(x < options.own_language for x in options.shares), options.own_share), f"doc_id long, words long, sentences long{columns}"
    )


@dataclass(frozen=True)
class Formula:
    """``score`` = weights over (1, u, u^2, log s, u log s) for the unfamiliar share u
    and the mean sentence length s; the level is 1 plus the cuts it reaches."""

    share: int
    weights: tuple[float, ...]
    cuts: tuple[float, ...]
    agreement: float | None = None

    def score(self) -> Column:
        u = F.col(f"strange_{self.share}") / F.col("words")
        s = F.log(F.col("words") / F.col("sentences"))
        return sum((F.lit(float(w)) * t for w, t in zip(self.weights, (F.lit(1.0), u, u * u, s, u * s))), F.lit(0.0))

    def level(self, score: Column) -> Column:
        return sum(((score >= c).cast("int") for c in self.cuts), F.lit(1)).cast("int")


def default_formula(options: Options) -> Formula:
    """Dale and Chall's published weights, which labels are weighed against.

    15.79 u + 0.0496 s is taken at s = e^(log s) near 15 words; the cuts are the
    formula's grade bands 5, 6, 7 and 9.
    """
    return Formula(sum(x < options.own_language for x in options.shares), (3.6365, 15.79, 0.0, 0.0496 * 15 / 2.7, 0.0), (5.0, 6.0, 7.0, 9.0))


def _cuts(score: np.ndarray, level: np.ndarray, weight: np.ndarray) -> list[float]:
    """For each step between levels the cut with the least weight on the wrong side.

    Among equals it is the middle one, and a cut never lies below the one before.
    """
    order = np.argsort(score, kind="stable")
    z, y, w = score[order], level[order], weight[order]
    edges = np.concatenate([[z[0] - 1e-6], (z[1:] + z[:-1]) / 2, [z[-1] + 1e-6]])
    out: list[float] = []
    for step in range(2, 6):
        above = np.concatenate([[0], np.cumsum(w * (y >= step))])
        below = np.concatenate([[0], np.cumsum(w * (y < step))])
        wrong = above + below[-1] - below
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        cut = float(edges[best[len(best) // 2]])
        out.append(max(cut, out[-1]) if out else cut)
    return out


def _published(options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The published formula as labels: unfamiliar share, log of sentence length, level."""
    formula = default_formula(options)
    u, s = (g.ravel() for g in np.meshgrid(np.linspace(0.0, 0.5, 21), np.log(np.linspace(6, 40, 18))))
    w = formula.weights
    score = w[0] + w[1] * u + w[2] * u * u + w[3] * s + w[4] * u * s
    # Between two grade bands the level is a fraction.
    return u, s, np.interp(score, (4.0, *formula.cuts), (1.0, 1.5, 2.5, 3.5, 4.5), right=5.0)


def fit(measured: DataFrame, labels: DataFrame, options: Options = Options()) -> Formula:
    """Weights by least squares on labelled documents, cuts by fewest errors.

    Several labels of one document are averaged. The published formula counts as
    ``prior`` labels spread over all shares and lengths: few labels shift it, many
    outweigh it, and without any it stands.
    """
    chosen = (
        labels.where(F.col("reading_level").between(1, 5) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("reading_level").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.label_limit)
    )
    rows = measured.join(chosen, "doc_id").where(F.col("words") >= options.least_words).toPandas()
    pu, ps, py = _published(options)
    own = default_formula(options).share
    real = np.concatenate([np.ones(len(rows), bool), np.zeros(len(pu), bool)])
    weight = np.where(real, 1.0, options.prior / len(pu))
    y = np.concatenate([rows.level.to_numpy(float), py])
    s = np.concatenate([np.log((rows.words / rows.sentences).to_numpy(float)), ps])
    best = None
    # The published list first, so that it stays where labels prefer none.
    for k in sorted(range(len(options.shares)), key=lambda k: k != own):
        u = np.concatenate([(rows[f"strange_{k}"] / rows.words).to_numpy(float), pu])
        x = np.column_stack([np.ones(len(u)), u, u * u, s, u * s])

        def solve(weight):
            root = np.sqrt(weight)
            return np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]

        w = solve(weight)
        # Labels far off the first fit are mistakes of a rater; the second leaves them out.
        off = np.abs(x @ w - y)
        near = ~real | (off <= max(1.0, float(np.quantile(off[real], 0.9)) if real.any() else 1.0))
        w = solve(weight * near)
        z = x @ w
        cuts = _cuts(z, np.floor(y + 0.5), weight)
        right = float(np.mean((z[real] >= cuts[2]) == (y[real] >= 3.5))) if real.any() else None
        if best is None or (right is not None and right > best.agreement + 1e-9):
            best = Formula(k, tuple(map(float, w)), tuple(cuts), right)
    return best


def reading_levels(documents: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """Reading level, 1 (easy) to 5 (demanding), of every English document.

    ``doc_id, lang, words, sentences, unfamiliar_share, sentence_length, score,
    level``. Document frequencies are counted over all English documents.

    Defined results: null and blank texts, and documents with fewer than
    ``least_words`` words of prose, have null scores and levels; other languages are
    left out; a document that comes twice is measured twice; without labels the
    published formula stands; no documents give no rows; other columns may have any
    name.
    """
    english = documents.where(is_english("lang"))
    texts = english.where(F.col("text").isNotNull()).select("text")
    familiar = familiar_words(texts, options)
    measured = cut_lineage(measures(english, familiar, options), "measures")
    formula = fit(measured, labels, options)
    enough = F.col("words") >= options.least_words
    score = F.when(enough, formula.score())
    return measured.select(
        "doc_id",
        "words",
        "sentences",
        F.when(enough, F.col(f"strange_{formula.share}") / F.col("words")).alias("unfamiliar_share"),
        F.when(enough, F.col("words") / F.col("sentences")).alias("sentence_length"),
        score.alias("score"),
        F.when(enough, formula.level(score)).alias("level"),
    )
