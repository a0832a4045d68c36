"""Text functions: normal forms, digests, similarity."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def squeeze(text: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, white space to single blanks, trimmed; case kept. ascii_only: the text is known to be ASCII, no Python needed."""
    return squeeze(F.coalesce(text if ascii_only else _nfkc(text), F.lit("")))


def casefold(text: Column, ascii_only: bool = False) -> Column:
    return F.lower(text) if ascii_only else _casefold(text)


def digest(*parts: Column, length: int = 20) -> Column:
    """First hex digits of SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of case-folded strings; the order of the arguments matters in rare cases."""
    if a == b:
        return 1.0
    return SequenceMatcher(None, a.casefold(), b.casefold(), autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def text_similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(first.fillna(""), second.fillna(""), strict=True):
        if pair not in memo:
            memo[pair] = ratio(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StringType())
def python_repr(text: pd.Series) -> pd.Series:
    """Quoted and escaped as change details show texts."""
    return text.map(lambda t: repr(t))


@lru_cache(20_000)
def clean(text: str) -> str:
    """One minus and one diameter sign; an unmapped glyph between digits is a plus-minus sign; single blanks."""
    text = text.replace("−", "-").replace("⌀", "Ø")
    return " ".join(re.sub("(?<=\\d)\N{REPLACEMENT CHARACTER}(?=\\s*[.,]?\\d)", " ±", text).split())

