"""Visually identical text with different characters (problem 4).

Method: look-alike classes are the transitive closure (union-find) of pairs of strings and code points that look the
same: compatibility forms, letters stored apart from their marks, blanks, characters without width, and letters
that two scripts share.  A class of characters has one ordinary form in each script, which represents it.  Strings of
shared letters form classes, too (``cases`` in Latin and in Cyrillic letters): the one that the corpus uses most
represents them.  A text is rewritten greedily, longest match first, with an Aho-Corasick automaton over all members.
For letters that scripts share, the word decides: a word takes the script of its letters that no other script has; a
word made only of shared letters is rewritten when the text around it is of another script and its other form is the
representative.

Kept as they are: a language's punctuation, dashes, curly quotes, superscripts, symbols, foreign words.

Behaviour in corner cases: null texts give no row; an empty text stays empty; repeated rows give their result
once; extra columns are ignored; an empty table gives an empty result; ties between members go to the lower code point.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import spread

#: Letters of Cyrillic and Greek that look like the Latin letter before them.
SHARED = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "o": "оο",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у", "A": "АΑ", "B": "ВΒ",
    "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
KINDS = ("form", "composition", "invisible", "space", "lookalike")
_FORM_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")


def invisible(c: str) -> bool:
    """Characters of format category and others without width."""
    return unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) <= 0x605 and c not in "۝܏࣢" or c in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F


def blank(c: str) -> bool:
    return c.isspace() and c not in " \n"


def joined_form(c: str) -> str | None:
    """The ordinary form of a full-width, half-width or joined form of letters or digits."""
    d = unicodedata.decomposition(c)
    if not d.startswith(_FORM_TAGS):
        return None
    plain = unicodedata.normalize("NFKC", c)
    if d.startswith("<compat>") and not (len(plain) > 1 and plain.isalpha() and unicodedata.category(c)[0] == "L" and not 0xE00 <= ord(c) <= 0xEFF):
        return None
    if c in "ﾞﾟ":
        return {"ﾞ": "゙", "ﾟ": "゚"}[c]
    # full-width punctuation belongs to its language
    return plain if all(unicodedata.category(x)[0] in "LMN" for x in plain) else None


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values()]


@lru_cache(20_000)
def script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]




@lru_cache(1)
def class_of() -> tuple[dict[str, list[str]], dict[str, str]]:
    """The classes of strings that look the same, by member; and the kind of variation of each member that is never
    the ordinary form."""
    sets = UnionFind()
    kind: dict[str, str] = {}
    for i in range(0x80, 0x2FA20):
        if 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xE000 or 0x20000 <= i < 0x2F800:
            continue
        c = chr(i)
        if invisible(c):
            sets.join(c, "")
            kind[c] = "invisible"
        elif blank(c):
            sets.join(c, " ")
            kind[c] = "space"
        elif plain := joined_form(c):
            sets.join(c, plain)
            kind[c] = "form"
        elif (d := unicodedata.normalize("NFD", c)) != c and unicodedata.normalize("NFC", d) == c:
            sets.join(c, d)
            kind[d] = "composition"
            if len(d) > 2:
                # marks may stand apart from a letter that already has one
                for k in range(1, len(d)):
                    half = unicodedata.normalize("NFC", d[:k]) + d[k:]
                    if half != c and unicodedata.normalize("NFC", half) == c:
                        sets.join(c, half)
                        kind[half] = "composition"
    for c in "\t\r\v\f\x1c\x1d\x1e\x1f":
        sets.join(c, " ")
        kind[c] = "space"
    for latin, others in SHARED.items():
        for c in others:
            sets.join(latin, c)
    members = {x: group for group in sets.classes() for x in group}
    return members, kind


def representatives() -> dict[tuple[str, str], str]:
    """(member, script) -> the ordinary form of its class in that script; by the kinds there is one at most, so counts decide nothing here."""
    members, kind = class_of()
    best: dict[tuple[str, str], str] = {}
    for m, group in members.items():
        for x in sorted(group, key=lambda x: (-len(x), x), reverse=True):
            if x and x not in kind:
                best.setdefault((m, script(x[0])), x)
    return best


@lru_cache(1)
def _tools():
    """The automaton over all members, each with its representative, and the characters of which any member has one."""
    members, kind = class_of()
    best = representatives()
    auto = ahocorasick.Automaton()
    for m in kind:
        plain = [x for x in members[m] if x not in kind]
        scripts = {script(x[0]) if x else "" for x in plain}
        # a form keeps its script: a full-width Latin letter becomes a Latin one
        own = script((unicodedata.normalize("NFKC", m) or m)[0])
        to = "" if "" in scripts else best.get((m, own) if own in scripts else (m, min(scripts)), plain[0] if plain else "")
        auto.add_word(m, (m, to, kind[m]))
    auto.make_automaton()
    odd = frozenset(c for m in kind for c in m if len(m) == 1 or unicodedata.combining(c))
    return auto, odd


_TRIPLE = ("LATIN", "CYRILLIC", "GREEK")
_TO = {}
for _l, _o in SHARED.items():
    for _c in _o:
        _s = "CYRILLIC" if "Ѐ" <= _c <= "ԯ" else "GREEK"
        _TO[_c, "LATIN"] = _l
        _TO.setdefault((_l, _s), _c)
for _l, _o in SHARED.items():  # a class is transitive: Cyrillic and Greek letters of one class
    for _c in _o:
        for _d in _o:
            _s = "CYRILLIC" if "Ѐ" <= _d <= "ԯ" else "GREEK"
            if _c != _d:
                _TO.setdefault((_c, _s), _d)
_CYRGRK = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_SHARED_LATIN = re.compile(rf"(?<![^\W_])[{''.join(SHARED)}]+(?![^\W_])")


def _word_script(w: str) -> tuple[str | None, bool]:
    """The script a word ought to have, and whether letters of another script stand in it."""
    n: Counter = Counter()
    sure: Counter = Counter()
    for c in unicodedata.normalize("NFD", w):
        s = script(c)
        if s in _TRIPLE:
            n[s] += 1
            if not any((c, t) in _TO for t in _TRIPLE):
                sure[s] += 1
    if len(n) < 2:
        return (next(iter(n)) if n else None), False
    for s, _ in sorted(n.items(), key=lambda x: (-sure[x[0]], -x[1], x[0])):
        if all((c, s) in _TO or script(c) in (s,) or script(c) not in _TRIPLE for c in unicodedata.normalize("NFD", w)):
            return s, True
    return None, False


def _turn(w: str, to: str) -> str:
    d = unicodedata.normalize("NFD", w)
    return unicodedata.normalize("NFC", "".join([_TO.get((c, to), c) if script(c) in _TRIPLE and script(c) != to else c for c in d]))


def _main_script(text: str) -> str | None:
    n = {"LATIN": len(_LATIN.findall(text)), "CYRILLIC": len(re.findall("[Ѐ-ԯ]", text)), "GREEK": len(re.findall("[Ͱ-Ͽἀ-῿]", text))}
    best = max(n, key=lambda k: (n[k], k))
    return best if n[best] else None


_LETTERS = {"LATIN": "A-Za-zÀ-ɏ", "GREEK": "Ͱ-Ͽἀ-῿", "CYRILLIC": "Ѐ-ԯ"}
#: Where letters of two scripts meet in a word.
_MEET = re.compile("|".join(f"[{a}][̀-ͯ]*[{b}]" for s, a in _LETTERS.items() for t, b in _LETTERS.items() if s != t))
_ALL_SHARED = re.compile(rf"(?<![^\W\d_])(?<![̀-ͯ])[{''.join(SHARED)}{''.join(SHARED.values())}]+(?![^\W\d_]|[̀-ͯ])")


def _whole(text: str) -> list[tuple[re.Match, str]]:
    """Words made only of shared letters of a script that is not the text's, with their form in the text's script."""
    main = _main_script(text)
    out = []
    for m in _ALL_SHARED.finditer(text):
        w = m.group()
        s = {script(c) for c in w}
        if len(s) == 1 and main not in s and all((c, main) in _TO for c in w) and (len(w) > 1 or "CYRILLIC" in s):
            out.append((m, _turn(w, main)))
    return out


def unify(text: str, whole: frozenset[str] | None = frozenset()) -> tuple[str, set[str]]:
    """The text in its one form, and the kinds of variation it had.

    whole: words of shared letters that may be turned (None: all that the text around them suggests).
    """
    if text.isascii() and "\t" not in text and "\r" not in text and "\v" not in text and "\f" not in text:
        return text, set()
    kinds: set[str] = set()
    auto, odd = _tools()
    if not odd.isdisjoint(text):
        out: list[str] = []
        at = 0
        for end, (m, plain, k) in auto.iter_long(text):
            start = end - len(m) + 1
            if start < at:
                continue
            out += [text[at:start], plain]
            kinds.add(k)
            at = end + 1
        out.append(text[at:])
        # what was apart may meet now; marks of other languages stay as they were
        text = unicodedata.normalize("NFC", "".join(out)) if kinds & {"form", "invisible", "composition"} else "".join(out)
    if _CYRGRK.search(text) and (whole is None or _LATIN.search(text)):
        turned = [(m.start(), m.end(), t) for m, t in (_whole(text) if whole is None or whole else ()) if whole is None or m.group() in whole]
        if _MEET.search(text):
            at = {a for a, _, _ in turned}
            for m in _WORD.finditer(text):
                if m.start() not in at and not m.group().isascii():
                    s, mixed = _word_script(m.group())
                    if mixed and (to := _turn(m.group(), s)) != m.group():
                        turned.append((m.start(), m.end(), to))
            turned.sort()
        if turned:
            kinds.add("lookalike")
            out, at = [], 0
            for a, b, to in turned:
                out += [text[at:a], to]
                at = b
            text = "".join(out) + text[at:]
    return text, kinds


def fold(text: str) -> str:
    """One consistent form without corpus evidence: words of shared letters follow the text around them."""
    return unify(text, None)[0]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Variants of each record, its words of shared letters, and how often the corpus has such words (per task)."""
    seen: Counter = Counter()
    columns = ["field_name", "record_id", "kind", "word", "turned", "n"]
    for b in batches:
        rows = []
        for f, i, text in zip(b["field_name"], b["record_id"], b["text"]):
            if not text:
                continue
            seen.update(_SHARED_LATIN.findall(text))
            if text.isascii() and "\t" not in text and "\r" not in text and "\v" not in text and "\f" not in text:
                continue
            plain, kinds = unify(text)
            rows += [(f, i, k, None, None, 1) for k in sorted(kinds)]
            if _CYRGRK.search(plain):
                whole = {(m.group(), t) for m, t in _whole(plain)}
                rows += [(f, i, "whole", w, t, 1) for w, t in sorted(whole)]
                strange = {w for w, _ in whole}
                seen.update(w for w in _ALL_SHARED.findall(plain) if w not in strange and not w.isascii())
        if len(seen) > 200_000:
            rows += [(None, None, "count", w, None, n) for w, n in seen.items()]
            seen.clear()
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame([(None, None, "count", w, None, n) for w, n in seen.items()], columns=columns)


SCAN = "field_name string, record_id string, kind string, word string, turned string, n long"


def _records(records: DataFrame) -> DataFrame:
    return records.select(F.col("field_name").cast("string").alias("field_name"), F.col("record_id").cast("string").alias("record_id"), "text").where(F.col("text").isNotNull())


def _accepted(scan: DataFrame) -> DataFrame:
    """field_name, record_id, word of the words of shared letters that the corpus uses more in the other script: that form represents their class."""
    known = scan.where("kind = 'count'").groupBy("word").agg(F.sum("n").alias("n"))
    return (
        scan.where("kind = 'whole'")
        .select("field_name", "record_id", "word", "turned")
        .join(known.withColumnRenamed("word", "turned").withColumnRenamed("n", "there"), "turned")
        .join(known.withColumnRenamed("n", "here"), "word", "left")
        .where(F.col("there") > F.coalesce("here", F.lit(0)))
        .select("field_name", "record_id", "word")
    )


def variants(records: DataFrame) -> DataFrame:
    """field_name, record_id, variant_kind of ``records(field_name, record_id, text)``, each once."""
    scan = spread(_records(records)).mapInPandas(_scan, SCAN).persist(StorageLevel.MEMORY_AND_DISK)
    plain = scan.where(F.col("kind").isin(*KINDS)).select("field_name", "record_id", F.col("kind").alias("variant_kind"))
    return plain.unionByName(_accepted(scan).select("field_name", "record_id", F.lit("lookalike").alias("variant_kind"))).distinct()


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, i, unify(t, frozenset(w))[0]) for f, i, texts, w in zip(b["field_name"], b["record_id"], b["texts"], b["words"]) for t in texts]
        yield pd.DataFrame(rows, columns=["field_name", "record_id", "text"])


def unified(records: DataFrame) -> DataFrame:
    """Every record with its text in the one form: field_name, record_id, text."""
    records = _records(records)
    scan = spread(records).mapInPandas(_scan, SCAN).persist(StorageLevel.MEMORY_AND_DISK)
    null = F.lit(None).cast("string")
    rows = records.withColumn("word", null).unionByName(_accepted(scan).withColumn("text", null))
    return rows.groupBy("field_name", "record_id").agg(F.collect_set("text").alias("texts"), F.collect_set("word").alias("words")).mapInPandas(_rewrite, "field_name string, record_id string, text string").distinct()
