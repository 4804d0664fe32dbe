"""Sentence boundaries across languages and scripts (problem 1).

Method: document-centred disambiguation.  A period after a token is ambiguous.  It is decided
from the *unambiguous* occurrences of the token and of the word after it:

* a token followed by a period and then by a lower-case word, digit or comma is an abbreviation there;
* a word written in lower case elsewhere is a common word, one that is capitalised in the middle of
  a sentence is a proper name.

Evidence of the same document counts first, evidence of the whole corpus is the fallback.  How often a document
has a token with and without its period is counted in all of its texts.  Terminators
depend on the script: the danda ends Devanagari sentences and a period does not, ``;`` ends a Greek
question, a space ends a Thai or Lao unit, full-width marks end CJK sentences.

Behaviour in corner cases: a null, empty or blank text has no unit; repeated rows give their units once;
two rows with one id and different texts each give theirs; a line feed always ends a unit; characters
without width never end or start one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tasks import spread

#: Characters without width, which are skipped when contexts are read.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Months before which a German ordinal stands (``18. März``).
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: Abbreviations that are known in advance, for corpora too small to show them.
SEEDS = frozenset(
    "dr prof mr mrs ms st fig figs eq eqs sec no nr nos vol pp cf vs approx e.g i.e etc al ca usw bzw z b "
    "env ex ej sr sra m aprox núm проф т г стр рис π.χ κ.λπ u.s a.m p.m".split()
)

_DROP = re.compile(f"[{INVISIBLE}̀-ͯ]")
_SAME_LENGTH = {0xFF01 + i: 0x21 + i for i in range(94)} | {c: 32 for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F)}
for _c in "！？，：；（）":  # these stay: they are the CJK forms
    _SAME_LENGTH.pop(ord(_c), None)
_ODD = re.compile(f"[{INVISIBLE}̀-ͯ{''.join(map(chr, _SAME_LENGTH))}]")

_HARD = "。！？｡।॥؟۔።"
_TERM = re.compile(r"[.!?…。！？｡।॥؟۔።;;]+")
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‘": "’"}
_CLOSE = frozenset("”“»」』)）]】’\"'")
_QUOTE = re.compile(r"[“”„«»「」『』()（）\[\]【】‘’\"']")
_NEXT = re.compile(r"[)\]\"”»’]*\s+[\"“„«(\[¿¡‘']*(\d|[^\W\d_]+)")
_CAPITAL = re.compile(" ([A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я][^\\W\\d_]*)")
_CITE = re.compile(r"(?:\[\d[\d,;\s–-]*\]|[⁰¹²³⁴-⁹])+")
_WORD_AT = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(r"\d{1,3}[.)]\s+[^\W\d_]")
_THAI = re.compile("[ก-๛ກ-ໟ]")
_THAI_GAP = re.compile(r"(?<=[ก-๛ກ-ໟ])[^\S\n]+(?=[ก-ฮะ-ๅກ-ຮະ-ໄ])")
_LIST_ONLY = re.compile(r"\s*(?:\w+\s+)?\d{1,3}$")
_SPEECH = re.compile(r"と|って|[^。！？，\n]{0,6}[说道问喊答叫讲]")
_ALL_WORDS = re.compile(r"[^\W\d_]+")



def _part(s: str, p: int) -> tuple[int, bool]:
    """Where the letters before place p start, and whether the token goes on before them: of "e.g" the "g" does; of "end.Dr",
    where a blank is missing, "Dr" doesn't."""
    blank = s.rfind(" ", max(0, p - 24), p)
    if blank >= 0 and s[blank + 1 : p].isalpha():  # most tokens
        return blank + 1, False
    j = p
    while j and s[j - 1].isalpha():
        j -= 1
    k = j
    while k and s[k - 1] == ".":
        k -= 1
    return j, k < j < p and s[k - 1 : k].isalpha() and not (k == j - 1 and s[j].isupper() and s[k - 1].islower())


def _token(s: str, p: int) -> str:
    """The token that ends at place p, with its inner periods."""
    j, inner = _part(s, p)
    while inner and j and (s[j - 1].isalpha() or s[j - 1] == "."):
        j -= 1
    return s[j:p].lstrip(".")


def _dots(s: str) -> Iterator[tuple[str, int]]:
    """Each token that has a period, and the place after that period.  Within a longer token only its first part is given,
    so that a chain of many periods takes no longer than its length."""
    p = s.find(".")
    while p >= 0:
        q = p + 1
        if s[p - 1 : p].isalpha():
            j, inner = _part(s, p)
            if not inner:
                yield s[j:p], q
            elif not (s[q : q + 1].isalpha() or s[q : q + 1] == "."):
                yield _token(s, p), q
        p = s.find(".", q)


SCAN = "doc string, word string, kind string, n long"
LOOK = "field_name string, record_id long, doc string, word string, next string, dot long, n long"
UNITS = "field_name string, record_id long, start_char int, end_char int"


def clean(text: str) -> tuple[str, list[int] | None]:
    """``text`` without characters of no width and with plain blanks; the place of each character, if any went."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    text = text.translate(_SAME_LENGTH)
    if not _DROP.search(text):
        return text, None
    at = [i for i, c in enumerate(text) if not _DROP.match(c)]
    return "".join([text[i] for i in at]), at


def _mixed(word: str) -> bool:
    """Whether a word such as pH or mRNA has capitals after small letters: it may start a sentence."""
    return word[:1].islower() and word != word.lower()


def _spans(s: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets of a line, outermost only.  What has no partner is ignored."""
    if not _QUOTE.search(s):
        return []
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _QUOTE.finditer(s):
        c, i = m.group(), m.start()
        before, after = s[i - 1 : i], s[i + 1 : i + 2]
        if c in "\"'" or c == "’":
            if c != '"' and before.isalnum() and after.isalnum():
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == c if c != "’" else stack[k][0] == "‘")), -1)
            if k >= 0 and not (c == "'" and before.isspace()):
                found.append((stack[k][1], i))
                del stack[k:]
            elif c == '"' or c == "'" and not before.isalnum() and after.isalnum():
                stack.append((c, i))
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in _OPEN.get(stack[k][0], "")), -1)
        if k >= 0:
            found.append((stack[k][1], i))
            del stack[k:]
        elif c in _OPEN:
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _line(s: str, keep: frozenset[str]) -> list[int]:
    """Places within a line where a unit ends and another begins.

    keep: ``word + tab + next`` of the periods that don't end a sentence.
    """
    ends: list[int] = []
    spans = _spans(s)
    k, start, n = 0, 0, len(s)
    done = 0
    for m in _TERM.finditer(s):
        p, q = m.span()
        if p < done:
            continue
        run = m.group()
        while k < len(spans) and spans[k][1] < p:
            k += 1
        opener = -1
        e = q
        if k < len(spans) and spans[k][0] < p:
            if s[q : spans[k][1]].strip(" ") and not all(c in _CLOSE for c in s[q : spans[k][1]].strip(" ")):
                continue
            opener, e = spans[k][0], spans[k][1] + 1
        if e < n and s[e] != " ":
            if (c := _CITE.match(s, e)):
                e = c.end()
            while e < n and s[e] in _CLOSE and not any(a == e for a, _ in spans[k : k + 2]):
                e += 1
            if (c := _CITE.match(s, e)):
                e = c.end()
        done = e
        g = e
        while g < n and s[g].isspace():
            g += 1
        if g >= n:
            break
        # most periods stand between a word and a capital after a blank; where none is kept, they end a unit
        plain = run == "." and not keep and opener < 0 and g > e and s[g].isupper() and p > 1 and s[p - 2 : p].isalpha() and not "\u0900" <= s[p - 1] <= "\u097f"
        if plain or _ends(s, p, q, e, g, run, opener, start, keep):
            ends.append(e)
            start = g
    if not s.isascii() and _THAI.search(s):
        for m in _THAI_GAP.finditer(s):
            if not any(a < m.start() < b for a, b in spans):
                ends.append(m.start())
        ends = sorted(set(ends))
    return ends


def _ends(s: str, p: int, q: int, e: int, g: int, run: str, opener: int, start: int, keep: frozenset[str]) -> bool:
    nxt, gap = s[g], g > e
    before = s[p - 1 : p]
    while g + 1 < len(s) and (nxt in _OPEN or nxt in "\"'¿¡"):
        g += 1
        nxt = s[g]
    opened = s[g - 1] in _OPEN or s[g - 1] in "\"'¿¡"
    if nxt in ",;:，、；：)]" or (nxt in "—–" and opener >= 0):
        return False
    word = m.group() if (m := _WORD_AT.match(s, g)) else ""
    lower = nxt.islower() and not _mixed(word)
    upper = nxt.isupper() or _mixed(word)
    letter = nxt.isalpha() or bool(word)
    if ";" in run or "\u037e" in run:
        return run in ";\u037e" and "\u0370" <= before <= "\u03ff" and not lower
    if opener >= 0:
        if lower:
            return False
        if upper or opened:
            return True
        whole = not s[start:opener].strip(" -•")
        if letter:
            if s[opener] in "(（[【":
                return whole
            return whole and not _SPEECH.match(s, g)
        return nxt.isdigit() and bool(_NUMBERED.match(s, g)) or nxt == "•"
    if any(c in _HARD for c in run):
        return True
    if "…" in run or run.startswith(".."):
        if lower or not before or before.isspace() or not (upper or opened):
            return "?" in run or "!" in run
        return True
    if "!" in run or "?" in run:
        return not lower and (gap or upper or letter)
    if "\u0900" <= before <= "\u097f":
        return False
    if not gap:
        if e > q:
            return upper
        j, inner = _part(s, p)
        w = s[j:p]
        if nxt.isupper() and (opened or s[g + 1 : g + 2].islower() or s[g + 1 : g + 2].isspace()):
            return ((len(w) > 1 or w.islower()) and not inner and w.lower() not in SEEDS or before.isdigit() or before in _CLOSE) and not before.isupper()
        return letter and not lower and not nxt.isupper() and (inner or len(w) > 1)
    if lower:
        return False
    w = _token(s, p)
    if nxt.isdigit():
        if before.isdigit() and _LIST_ONLY.match(s[start:p]):
            return False
        return f"{w}\t#" not in keep if w else True
    if upper or opened:
        if before.isdigit():
            if word in MONTHS and re.search(r"(?<![\d.,])\d{1,2}$", s[:p]):
                return False
            return not _LIST_ONLY.match(s[start:p])
        if len(w) == 1 and w.isupper() and not opened and len(word) == 1 and s[g + 1 : g + 2] == ".":
            return False
        return f"{w}\t{word}" not in keep
    if letter:
        return len(w) != 1
    return nxt in "•"


def units(text: str | None, keep: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """The units of a text as (start, end) in code points of the text itself."""
    if not text:
        return []
    s, at = clean(text)
    out: list[tuple[int, int]] = []
    base = 0
    for line in s.split("\n"):
        if line:
            cuts = [0, *_line(line, keep), len(line)]
            for a, b in zip(cuts, cuts[1:]):
                a, b = a + base, b + base
                if at is not None:
                    # characters without width stay with the character before them
                    a = 0 if a == 0 else at[a - 1] + 1
                    b = at[b - 1] + 1 if b < len(at) else len(text)
                    while b < len(text) and _DROP.match(text[b]):
                        b += 1
                    while a < b and _DROP.match(text[a]):
                        a += 1
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
        base += len(line) + 1
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: counts by document (abbreviations, names) and counts of the corpus (doc null), summed up per task."""
    docs: Counter = Counter()
    corpus: dict[str, Counter] = {k: Counter() for k in ("all", "dot", "abbr", "eol", "mid")}
    words, dot, abbr, eol, mid = corpus.values()

    def flush() -> pd.DataFrame:
        rows = [(d, w, k, n) for (d, w, k), n in docs.items()] + [(None, w, k, n) for k, c in corpus.items() for w, n in c.items()]
        docs.clear()
        for c in corpus.values():
            c.clear()
        return pd.DataFrame(rows, columns=["doc", "word", "kind", "n"])

    for b in batches:
        chunks: Counter = Counter()
        for doc, text in zip(b["doc"], b["text"]):
            if not text:
                continue
            s = clean(text)[0]
            chunks.update(s.split())
            for w, q in _dots(s):
                dot[w] += 1
                c = s[q : q + 1]
                if not c or c == "\n":
                    eol[w] += 1
                    continue
                if c == " ":
                    c = s[q + 1 : q + 2]
                    if not (c.islower() and not _mixed(_WORD_AT.match(s, q + 1).group()) or c.isdigit() and not _NUMBERED.match(s, q + 1)):
                        continue
                elif c not in ",;:":
                    continue
                abbr[w] += 1
                if doc is not None:
                    docs[doc, w, "abbr"] += 1
            for m in _CAPITAL.finditer(s):
                if s[m.start() - 1 : m.start()].isalpha():
                    mid[w := m.group(1)] += 1
                    if doc is not None:
                        docs[doc, w, "mid"] += 1
        # no word goes over a blank: what stands between two is taken apart once a batch, however often it occurs
        for c, n in chunks.items():
            if c.isalpha():
                words[c] += n
            else:
                for w in _ALL_WORDS.findall(c):
                    words[w] += n
        if len(docs) > 200_000 or sum(map(len, corpus.values())) > 400_000:
            yield flush()
    yield flush()


def _look(wanted: frozenset[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the wanted tokens: the ambiguous periods of each record (next: the word after one), and how often each document has
    one with a period, and at all, summed up per task (next null).  A token with inner periods never stands without its own."""
    dots: Counter = Counter()
    total: Counter = Counter()
    columns = ["field_name", "record_id", "doc", "word", "next", "dot", "n"]

    def flush() -> pd.DataFrame:
        rows = [(None, None, d, w, None, dots[d, w], n) for (d, w), n in total.items()]
        dots.clear(), total.clear()
        return pd.DataFrame(rows, columns=columns).astype({"record_id": "Int64"})

    for b in batches:
        sites = []
        # what stands between two blanks, taken apart once a batch, however often it occurs; hot: with wanted tokens
        known: set[str] = set()
        hot: dict[str, tuple[list[str], list[str]]] = {}
        for f, i, doc, text in zip(b["field_name"], b["record_id"], b["doc"], b["text"]):
            s = clean(text)[0]
            chunks = s.split()
            if not known.issuperset(chunks):
                for c in {*chunks} - known:
                    found = [] if wanted.isdisjoint(words := _ALL_WORDS.findall(c)) else [w for w in words if w in wanted]
                    dotted = [w for w, _ in _dots(c) if w in wanted] if "." in c else []
                    if found or dotted:
                        hot[c] = found, dotted
                    known.add(c)
            if hot.keys().isdisjoint(chunks):
                continue
            periods = False
            for c in chunks:
                if c in hot:
                    found, dotted = hot[c]
                    periods |= bool(dotted)
                    if doc is not None:
                        for w in found:
                            total[doc, w] += 1
                        for w in dotted:
                            if "." not in w:
                                dots[doc, w] += 1
                                # numerals such as the half are no letters, so a token after one isn't among the words
                                if w not in found:
                                    total[doc, w] += 1
            if not periods:
                continue
            seen = set()
            for w, q in _dots(s):
                # a line feed ends a unit whatever stands before it
                if w in wanted and s[q : q + 1] != "\n" and (m := _NEXT.match(s, q)):
                    nxt = m.group(1)
                    if nxt[0].isdigit():
                        nxt = "#"
                    elif not (nxt[0].isupper() or _mixed(nxt)):
                        continue
                    if (w, nxt) not in seen:
                        seen.add((w, nxt))
                        sites.append((f, i, doc, w, nxt, 0, 0))
        if sites:
            yield pd.DataFrame(sites, columns=columns).astype({"record_id": "Int64"})
        if len(total) > 200_000:
            yield flush()
    yield flush()


def _looked(texts: DataFrame, possible: DataFrame, block: int) -> DataFrame:
    """What ``_look`` finds of the possible abbreviations, which are sent to the tasks in blocks."""
    words = possible.select("word").distinct().toLocalIterator()
    found = texts.sparkSession.createDataFrame([], LOOK)
    while some := frozenset(r["word"] for r in islice(words, block)):
        found = found.unionByName(texts.mapInPandas(partial(_look, some), LOOK))
    return found


def _segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units of rows that are sorted by record; a row has a text, or a period of the record that ends no sentence."""
    key, texts, keep = None, set(), set()
    fs, ids, starts, ends = [], [], [], []

    def finish() -> None:
        k = frozenset(keep)
        # two texts of one record can have a unit in common
        found = units(*texts, k) if len(texts) == 1 else {u for t in texts for u in units(t, k)}
        fs.extend([key[0]] * len(found)), ids.extend([key[1]] * len(found))
        starts.extend([a for a, _ in found]), ends.extend([z for _, z in found])
        texts.clear(), keep.clear()

    def made() -> pd.DataFrame:
        out = pd.DataFrame({"field_name": fs, "record_id": pd.Series(ids, dtype="int64"), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})
        fs.clear(), ids.clear(), starts.clear(), ends.clear()
        return out

    for b in batches:
        for f, i, text, period in zip(b["field_name"], b["record_id"], b["text"], b["keep"]):
            if (f, i) != key:
                if key:
                    finish()
                key = f, i
            if text is not None:
                texts.add(text)
            else:
                keep.add(period)
        yield made()
    if key:
        finish()
    yield made()


def sentence_units(records: DataFrame, min_ratio: float = 0.3, block: int = 200_000) -> DataFrame:
    """Units of ``records(field_name, record_id, doc, text)``: field_name, record_id, start_char, end_char.

    min_ratio: share of a token's occurrences that must be followed by a period for the corpus to call it an
    abbreviation.  Counts cover all rows.  Rows whose field, id and text are equal give their units once.
    block: how many possible abbreviations are sent to the tasks at a time when their periods are looked for; each block is a pass.
    """
    records = records.select("field_name", F.col("record_id").cast("long").alias("record_id"), F.col("doc").cast("string").alias("doc"), "text").where(F.col("text").isNotNull())
    texts = spread(records)
    # small beside the texts, and read twice
    scan = texts.mapInPandas(_scan, SCAN).persist(StorageLevel.MEMORY_AND_DISK)

    def of(*kinds: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))

    corpus = scan.where("doc is null").groupBy("word").agg(*(of(k).alias(k) for k in ("all", "dot", "abbr", "eol", "mid"))).persist(StorageLevel.MEMORY_AND_DISK)
    docs = scan.where("doc is not null").groupBy("doc", "word").agg(*(of(k).alias(k) for k in ("abbr", "mid"))).persist(StorageLevel.MEMORY_AND_DISK)

    # a dotted token such as "e.g" is never among the words, so "all" can be less than "dot"
    seed = F.lower("word").isin(*SEEDS)
    # a title such as "Dra." always stands with its period and never at the end of a line; of a longer word that is no evidence,
    # as rare spellings end sentences five times by chance: it must be shown as an abbreviation
    title = ((F.length("word") <= 6) | F.contains("word", F.lit("."))) & (F.col("dot") >= 5) & (F.col("dot") >= 0.9 * F.col("all")) & (F.col("eol") == 0)
    there = (F.col("dot") >= min_ratio * F.col("all")) & ((F.col("abbr") > 0) | seed | title | (F.length("word") == 1) & (F.col("word") != F.lower("word")))
    cased = corpus.where("`all` > 0 or mid > 0").groupBy(F.lower("word").alias("low")).agg(F.sum(F.when(F.col("word") == F.lower("word"), F.col("all")).otherwise(0)).alias("lower_n"), F.sum("mid").alias("mid_n"))
    # only tokens that the corpus calls an abbreviation or the document shows as one can be one
    possible = corpus.where(F.col("dot") > 0).where(there | (F.col("abbr") > 0)).select("word", there.alias("there"))
    looked = _looked(texts, possible, block).persist(StorageLevel.MEMORY_AND_DISK)
    sites = looked.where("next is not null").select("field_name", "record_id", "doc", "word", "next").join(possible, "word")
    sites = sites.join(docs.where("abbr > 0").select("doc", "word", "abbr"), ["doc", "word"], "left").where("there or abbr > 0")
    # the document decides where it shows the token as an abbreviation, or mostly without a period; else the corpus does
    shares = looked.where("next is null").groupBy("doc", "word").agg((F.sum("dot") >= min_ratio * F.sum("n")).alias("often"))
    sites = sites.join(shares, ["doc", "word"], "left").where(F.coalesce("often", F.lit(True))).drop("there", "abbr", "often").persist(StorageLevel.MEMORY_AND_DISK)
    names = docs.where("mid > 0").select("doc", F.col("word").alias("next"), F.col("mid").alias("doc_mid"))
    known = sites.withColumn("low", F.lower("next")).join(cased, "low", "left").withColumn("common", F.coalesce(F.col("lower_n") >= F.greatest("mid_n", F.lit(1)), F.lit(False)))
    # a token such as "etc." that common words follow ends sentences: a name after it starts one
    enders = known.where("next <> '#'").groupBy("word").agg(F.avg(F.col("common").cast("int")).alias("ends")).where("ends >= 0.7").select("word", F.lit(True).alias("ender"))
    kept = (
        known.join(names, ["doc", "next"], "left")
        .join(enders, "word", "left")
        .where((F.col("next") == "#") | F.col("ender").isNull() & (~F.col("common") | (F.coalesce("doc_mid", F.lit(0)) > 0) & (F.col("lower_n") < 9 * F.col("mid_n"))))
        .select("field_name", "record_id", F.concat_ws("\t", "word", "next").alias("keep"))
    )
    rows = records.select("field_name", "record_id", "text", F.lit(None).cast("string").alias("keep")).unionByName(kept.withColumn("text", F.lit(None).cast("string")))
    return rows.repartition("field_name", "record_id").sortWithinPartitions("record_id", "field_name").mapInPandas(_segment, UNITS)
