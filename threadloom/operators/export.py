"""Conversations as text files: plain, markdown and ledger."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.functions.labels import short_id
from threadloom.functions.text import blank_to_null
from threadloom.operators.protocol import View, rendered

#: Width of a ledger line and of its name column (fixed values).
WIDTH, NAME = 90, 9
FORMATS = ("plain", "markdown", "ledger")
_SPEAKERS = {"user": "You", "assistant": "Assistant"}


def _paragraph(style: str, role: str, sub: str | None, body: str) -> str:
    who = (f"[↳{sub}] " if sub else "") + _SPEAKERS.get(role, role or "?")
    if style == "plain":
        return f"{who}: {body}\n\n"
    if style == "markdown":
        return f"## {who}\n\n{body}\n\n"
    lines = []
    for raw in body.split("\n"):
        lines += textwrap.wrap(raw, WIDTH - NAME - 3, drop_whitespace=True) or [""]
    return "".join(f"{(who if i == 0 else '')[:NAME]:>{NAME}} │ {line}\n" for i, line in enumerate(lines)) + "\n"


def paragraphs(rows: DataFrame, style: str = "plain", view: View = View()) -> DataFrame:
    """One paragraph of text per shown message: ``conv_ref, ordinal, text``.

    Writing it partitioned by conversation and sorted by ordinal gives a file each;
    no conversation is gathered in memory.
    """
    if style not in FORMATS:
        raise ValueError(f"unknown format {style!r}")
    shown = rendered(rows, view).join(rows.select("conv_ref", "ordinal", short_id(blank_to_null("parent_tool_use_id")).alias("sub")), ["conv_ref", "ordinal"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [_paragraph(style, r, s, t) for r, s, t in zip(b["role"], b["sub"], b["body"])]
            yield pd.DataFrame({"conv_ref": b["conv_ref"], "ordinal": b["ordinal"], "text": text})

    return shown.mapInPandas(write, "conv_ref string, ordinal int, text string")


def write_text(rows: DataFrame, path: str, style: str = "plain", view: View = View()) -> None:
    """One folder of text per conversation below ``path``."""
    out = paragraphs(rows, style, view)
    out.repartition("conv_ref").sortWithinPartitions("conv_ref", "ordinal").select("conv_ref", F.col("text").alias("value")).write.partitionBy("conv_ref").mode("overwrite").text(path)
