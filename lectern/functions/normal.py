"""Forms of text for comparison.  Compatibility forms and case folding have no built-in; text of plain letters stays in generated code,
only other text goes through an Arrow function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes of all kinds, and the minus sign.
DASHES = "-‐‑‒–—―−"
#: Typographic signs and the plain ones that stand for them.
PLAIN = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "′": "'", "″": '"',
    "–": "-", "—": "-", "−": "-", " ": " ",
}
_BLANKS = r"[\s\x1c-\x1f]+"
_TO_SPACE = str.maketrans(dict.fromkeys(DASHES, " ") | {"­": None})
_TO_HYPHEN = str.maketrans(dict.fromkeys(DASHES.replace("―", ""), "-"))
_TO_PLAIN = str.maketrans(PLAIN)


def for_search(text: str) -> str:
    """Case and compatibility forms folded, dashes as spaces, without soft hyphens, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(_TO_SPACE).casefold().split())


def for_quotes(text: str) -> str:
    """Case and compatibility forms folded, one kind of hyphen, without any blanks."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).translate(_TO_HYPHEN).casefold())


def for_reading(text: str) -> str:
    """Compatibility forms folded, plain quotes and dashes."""
    return unicodedata.normalize("NFKC", text).translate(_TO_PLAIN)


def _mapped(text: Column, plain: Column, form: Callable[[str], str]) -> Column:
    """``plain`` where the text is ASCII, else ``form`` of it."""

    def f(s: pd.Series) -> pd.Series:
        return s.map(form, na_action="ignore")

    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, plain).otherwise(F.pandas_udf(f, "string")(F.when(~ascii_only, text)))


def search_form(text: Column) -> Column:
    return _mapped(text, F.btrim(F.regexp_replace(F.lower(F.translate(text, "-", " ")), _BLANKS, " ")), for_search)


def quote_form(text: Column) -> Column:
    return _mapped(text, F.regexp_replace(F.lower(text), _BLANKS, ""), for_quotes)


def reading_form(text: Column) -> Column:
    return _mapped(text, text, for_reading)


def normalized(text: Column, fallback: str = "") -> Column:
    """Reading form without markdown, single spaces; ``fallback`` for null or nothing."""
    from lectern.functions.text import strip_markdown

    t = F.btrim(F.regexp_replace(strip_markdown(reading_form(text)), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)
