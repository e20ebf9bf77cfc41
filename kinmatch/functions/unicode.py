"""Unicode normal forms, for which Spark has no built-in function: Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def folded(text: str) -> str:
    """Decomposed (NFKD), without the combining marks that follow a Latin letter; other scripts keep theirs."""
    if text.isascii():
        return text
    out, latin = [], False
    for ch in unicodedata.normalize("NFKD", text):
        if unicodedata.combining(ch):
            if not latin:
                out.append(ch)
            continue
        latin = "A" <= ch <= "z" or "À" <= ch <= "ɏ"
        out.append(ch)
    return "".join(out)


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(folded, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_latin_accents(s: Column) -> Column:
    return _fold(s)


def nfkc(s: Column) -> Column:
    """The compatibility form NFKC. ASCII strings are in it already and stay on the JVM's side."""
    return F.coalesce(_nfkc(F.when(s.rlike("[^\\x00-\\x7F]"), s)), s)
