"""Repairs and tokens of metadata texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def repair(value: str | None) -> str | None:
    """Text that was decoded with the wrong table: Latin-1 for UTF-8 or EUC-KR. The reading with most letters wins; ties keep the text."""
    if not value or value.isascii():
        return value

    def letters(t: str) -> int:
        return sum(c.isalpha() and ord(c) > 0x2FF for c in t) - 3 * t.count("�")

    options = [value]
    for wrong, right in (("latin-1", "utf-8"), ("cp1252", "utf-8"), ("latin-1", "euc-kr"), ("cp1252", "cp949")):
        try:
            options.append(value.encode(wrong).decode(right))
        except UnicodeError:
            continue
    return max(options, key=letters)


@F.pandas_udf(StringType())
def repair_text(values: pd.Series) -> pd.Series:
    return values.map(repair, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(nfkc(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def optional_positive(text: Column) -> Column:
    """A number above zero, or null."""
    n = F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("double")
    return F.when(n > 0, n)


def meter(text: Column) -> Column:
    """``3+2/8`` as a struct of count and unit; 4/4 if it says nothing."""
    top, bottom = F.regexp_extract(text, r"^([0-9+]+)/(\d+)$", 1), F.regexp_extract(text, r"^([0-9+]+)/(\d+)$", 2)
    count = F.aggregate(F.split(top, r"\+"), F.lit(0), lambda s, x: s + F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.struct(F.when(top == "", 4).otherwise(count).alias("count"), F.when(bottom == "", 4).otherwise(bottom.try_cast("int")).alias("unit"))


def spelled_pitch(text: Column) -> Column:
    """``C#4`` as a MIDI number."""
    step = F.element_at(F.create_map(*(F.lit(x) for kv in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in kv)), F.upper(F.left(text, F.lit(1))))
    sharps = F.length(F.regexp_replace(text, "[^#]", "")) - F.length(F.regexp_replace(F.substring(text, 2, 8), "[^b]", ""))
    return step + sharps + 12 * (F.regexp_extract(text, r"(-?\d+)$", 1).try_cast("int") + 1)


def frequency(p: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (p - 69) / 12)
