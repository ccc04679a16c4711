"""Character classes and text folding shared by the operators.

Python's Unicode rules are the contract; each constant is written so that
Java's and RE2's regular expressions read it alike.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, as the inside of a regex class.
WS = "\\x09-\\x0D\\x1C-\\x20\x85\xa0  -     　"

#: The same set, character by character.
WS_CHARS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# The token patterns.
WORD = "[\\p{L}\\p{Nl}\\p{No}]+(?:['’\\-‐-‒–—−][\\p{L}\\p{Nl}\\p{No}]+)*"
NUMBER = "\\p{Nd}+(?:[.,:/\\-]\\p{Nd}+)*"
TOKEN = f"{WORD}|{NUMBER}"
ASCII_TOKEN = "[A-Za-z]+(?:['’\\-][A-Za-z]+)*"

# Characters folded to the plain apostrophe and hyphen. U+2011 is left
# out on purpose: compatibility normalization turns it into U+2010 first.
APOSTROPHES = "’‘‛ʼ"
HYPHENS = "‐‒–—−"


def strip_ws(col: Column) -> Column:
    """str.strip() with Python's white space."""
    return F.btrim(col, F.lit(WS_CHARS))


def rstrip_ws(col: Column) -> Column:
    """str.rstrip() with Python's white space."""
    return F.rtrim(col, F.lit(WS_CHARS))


def collapse_ws(col: Column) -> Column:
    """Runs of white space become one space; both ends are stripped."""
    return F.trim(F.regexp_replace(col, f"[{WS}]+", " "))


def is_ascii(col: Column) -> Column:
    return col.rlike(r"^[\x00-\x7F]*$")


def _arrow_fold(form: str, casefold: bool):
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            text = unicodedata.normalize(form, text) if form else text
            return text.casefold() if casefold else text

        return texts.map(one, na_action="ignore") if len(texts) else texts

    return fold


def fold_text(col: Column, form: str = "NFKC", casefold: bool = True) -> Column:
    """Unicode normalization and full case folding.

    ASCII needs neither Python nor tables: it is lowered in the JVM, and the
    Arrow function gets a null in its place. Null stays null.
    """
    plain = is_ascii(col)
    other = _arrow_fold(form, casefold)(F.when(~plain, col))
    return F.when(plain, F.lower(col) if casefold else col).otherwise(other)
