"""Fragments of stored text with the words of a query marked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def patterns(words: list[str], phrases: list[list[str]]) -> list[str]:
    """Phrases first, then single words; matched without regard to case."""
    out = [r"\b" + r"\W+".join(map(re.escape, p)) + r"\b" for p in phrases if p]
    return out + [rf"\b{re.escape(w)}\b" for w in dict.fromkeys(words) if w]


def fragments(text: str, pattern: re.Pattern, before: str, after: str, size: int, number: int) -> list[str]:
    """Each begins half its size before a match; the next match is looked for behind it."""
    out, at = [], 0
    while len(out) < number and (m := pattern.search(text, at)):
        start = max(0, m.start() - size // 2)
        end = min(len(text), max(start + size, m.end()))
        out.append(pattern.sub(lambda x: before + x.group(0) + after, text[start:end]))
        at = max(end, m.end())
    return out


def highlighted(text: Column, words: list[str], phrases: list[list[str]], before: str = "<em>", after: str = "</em>", size: int = 160, number: int = 1) -> Column:
    """array<string>; empty where nothing matches. Runs over the final hits only."""
    alternatives = "|".join(patterns(words, phrases))
    if not alternatives or number < 1:
        return F.array().cast("array<string>")
    compiled = re.compile(alternatives, re.IGNORECASE)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else fragments(t, compiled, before, after, size, number))

    return run(text)
