"""Tokens of texts, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: A word character that is a letter, a number or an underscore; combining marks are none.
WORD = r"[\p{L}\p{N}_]"
DANDA = "।"


def tokens(text: Column) -> Column:
    """White-space separated tokens; empty for null."""
    return F.coalesce(F.filter(F.split(text, SPACE + "+"), lambda t: t != ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join(words: Column) -> Column:
    """Tokens with one space between."""
    return F.array_join(words, " ")


def strip(text: Column, chars: str) -> Column:
    """Without the given characters at both ends."""
    return F.btrim(text, F.lit(chars))


def literal_map(values: dict[str, object], kind: str = "string") -> Column:
    """A literal map, so that a lookup stays in the row's projection."""
    parts = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.create_map(*parts).cast(f"map<string,{kind}>")


def within(value: Column, words: list[str]) -> Column:
    """Whether a value is one of a fixed list."""
    return F.coalesce(value.isin(*words), F.lit(False))


def nfc(text: Column) -> Column:
    """Unicode's composed form; ASCII texts pass unchanged."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    # A UDF runs for every row, whatever is around it, so it is given nothing where there is nothing to compose:
    # in Latin text, only letters from U+0300 on.
    loose = text.rlike(r"[^\x00-\x{02FF}]")
    return F.coalesce(composed(F.when(loose, text)), text)
