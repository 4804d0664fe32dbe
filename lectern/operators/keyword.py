"""Keyword search: words of passages by stem, without stop words, ranked by how often they stand."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: English words that no search looks for.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WEIGHT = 0.1
_V = "[aeiouy]"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Endings of the English stemmer and what they become, by step; the longest that fits is taken.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(w: str, start: int = 0) -> int:
    """Where what follows the first consonant after a vowel begins."""
    m = re.search(f"{_V}[^aeiouy]", w[start:])
    return start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of an English word in small letters; other words stay."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), _region(w))
    r2 = _region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"{_V}.*.s$", w[:-1] + "s") and re.search(_V, w[:-2]):
        w = w[:-1]
    # past and progressive forms
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(_V, w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not re.match("[aeiou]", w[-2]):
        w = w[:-1] + "i"
    # derived forms
    e = _longest(w, (*STEP_2, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if re.search("[cdeghkmnrt]li$", w) else w
        else:
            w = w[: -len(e)] + STEP_2[e]
    e = _longest(w, (*STEP_3, "ative"))
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP_3.get(e, "")
    e = _longest(w, (*STEP_4, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(word: Column) -> Column:
    return F.pandas_udf(_stems, "string")(word)


def postings(passages: DataFrame, stems: bool = True) -> DataFrame:
    """chunk_id, word, n: how often each word stands in passages(chunk_id, text); by stem and without stop words unless ``stems`` is off."""
    words = passages.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORDS), F.lit(0))).alias("word"))
    n = words.groupBy("chunk_id", "word").agg(F.count("*").alias("n"))
    if not stems:
        return n
    return n.where(~F.col("word").isin(*STOP_WORDS)).select("chunk_id", stemmed(F.col("word")).alias("word"), "n").groupBy("chunk_id", "word").agg(F.sum("n").alias("n"))


def terms(queries: DataFrame, stems: bool = True, most: int = 64) -> DataFrame:
    """query_id, word: the different words of queries(query_id, query), the first ``most``."""
    t = queries.select("query_id", F.explode(T.query_terms(F.col("query"), most)).alias("word"))
    return t.where(~F.col("word").isin(*STOP_WORDS)).select("query_id", stemmed(F.col("word")).alias("word")).distinct() if stems else t.distinct()


def search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, limit: int = 20, stems: bool = True) -> DataFrame:
    """query_id, chunk_id, rank_score, rank: passages of a user's own document with any of a question's words, best first.

    chunks(chunk_id, document_id, sequence_index, text), documents(document_id, user_id), queries(query_id, user_id, document_id,
    query).  A foreign document gives nothing, just as a missing one; ties go by sequence_index.  Only passages of asked documents
    are read for words, and the words are counted before they are joined.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    asked = queries.join(documents.select("document_id", "user_id").distinct(), ["document_id", "user_id"], "left_semi")
    scoped = chunks.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    words = postings(scoped, stems).join(scoped.select("chunk_id", "document_id", "sequence_index"), "chunk_id")
    sought = terms(asked, stems).join(asked.select("query_id", "document_id"), "query_id")
    hits = words.join(sought, ["document_id", "word"]).groupBy("query_id", "chunk_id", "sequence_index").agg(F.sum("n").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "sequence_index", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "chunk_id", F.round(F.col("hits") * WEIGHT, 6).alias("rank_score"), "rank")
