"""Bilingual text functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# --- fixed values: folding tables -------------------------------------------
ARABIC_MARKS = "[\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06ed\\u0640]"
FOLD_FROM, FOLD_TO = "أإآىة", "ااايه"
ARABIC_LETTERS = "[\\u0600-\\u06FF]"
LATIN_LETTERS = "[A-Za-z]"
SHEET_TRIGGERS = "^[=+\\-@]"
# Characters that stay as they are in compatibility normal form, whatever stands beside them. Not all of them: others only cost a call.
NORMAL_RANGES = (
    (0x00, 0x7F), (0xC0, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0xA1, 0xA7), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7),
    (0xBB, 0xBB), (0xBF, 0xBF), (0x2012, 0x2016), (0x2018, 0x2023), (0x20A0, 0x20A7),
    (0x38E, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x482), (0x48A, 0x52F),
    (0x5D0, 0x5EA), (0x60C, 0x60F), (0x61F, 0x64A), (0x660, 0x66F), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3), (0x1F300, 0x1F64F),
)
# -----------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_OTHERS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in NORMAL_RANGES[1:])
#: Runs of such characters are passed over, ASCII first, and never tried again; a match means that something else follows them.
_MAY_CHANGE = f"^(?:[\\x00-\\x7F]++|[{_OTHERS}]++)*+(?s:.)"


def nfkc(text: Column) -> Column:
    """Compatibility normal form; only texts with a character that it may change leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(_MAY_CHANGE), text)), text)


def fold(text: Column) -> Column:
    """Lower case, no Arabic marks or tatweel, folded letters, single spaces, trimmed.

    Rows without any Arabic letter skip the Arabic steps.
    """
    low = F.lower(text)
    arabic = F.translate(F.regexp_replace(low, ARABIC_MARKS, ""), FOLD_FROM, FOLD_TO)
    folded = F.when(low.rlike(ARABIC_LETTERS), arabic).otherwise(low)
    return F.trim(F.regexp_replace(folded, "(?U)\\s+", " "))


def normalize_text(text: Column) -> Column:
    """The comparison form of a review or listing text; null becomes ''."""
    return F.coalesce(fold(nfkc(text)), F.lit(""))


def normalize_term(term: str) -> str:
    """Driver-side twin of :func:`normalize_text` for the few configured terms."""
    bare = re.sub(ARABIC_MARKS, "", unicodedata.normalize("NFKC", term).lower())
    return " ".join(bare.translate(str.maketrans(FOLD_FROM, FOLD_TO)).split())


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any term is a substring; one pass of native searches per row."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def keyword_signal(text: Column, terms: Iterable[str]) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), terms)


def language_tag(text: Column) -> Column:
    """arabic / english / mixed / other by script."""
    arabic, latin = text.rlike(ARABIC_LETTERS), text.rlike(LATIN_LETTERS)
    return (
        F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "english").otherwise("other")
    )


def sheet_safe(text: Column) -> Column:
    """Keep a spreadsheet from running a cell that looks like a formula."""
    return F.when(text.rlike(SHEET_TRIGGERS), F.concat(F.lit("'"), text)).otherwise(text)


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))
