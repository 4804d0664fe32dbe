"""Noise in text from scanned pages (problem 2).

Method: every word's anagram hash (the sum of its code points to the fifth power) changes by a fixed difference when one
confusion of characters happens, wherever it happens.  Confusions are those that are known and those that the corpus
shows: differences by which many rare words become frequent ones, but no frequent word another.  Rare words, moved by
each difference, are joined in SQL with the hashes of frequent words; a pair that the confusion really explains is a
correction, and the most frequent word ranks first.  Words broken across lines are told from compounds by the counts of the joined word, of
the compound and of compounds with that first half.  Running heads are edge lines that a document repeats (exactly or
nearly), its title and authors among them, or that carry a page number.

Behaviour in corner cases: null and empty texts have no noise and repair to themselves; repeated rows give their
rows once; missing page numbers are allowed; code, tables, formulas, headings and list items are left alone; ties between
corrections go to the more frequent, then the alphabetically first word; extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import fold
from lectern.llm.tasks import spread

#: What is printed and what recognition makes of it.
CONFUSIONS = [
    ("e", "c"), ("a", "o"), ("t", "f"), ("s", "5"), ("n", "ri"), ("o", "0"), ("i", "1"), ("l", "1"), ("m", "rn"),
    ("d", "cl"), ("u", "ii"), ("g", "q"), ("h", "li"), ("b", "6"), ("ri", "n"), ("in", "m"), ("w", "vv"), ("li", "h"),
    ("cl", "d"), ("ll", "u"), ("c", "e"), ("o", "a"), ("f", "t"), ("q", "g"), ("rn", "m"), ("ii", "u"), ("vv", "w"),
    ("i", "l"), ("l", "i"), ("z", "2"), ("g", "9"), ("b", "8"),
]
#: Letters of the longest word that is looked at; what is longer is an address or a formula.
LONGEST = 60
RUNNING = ("paragraph", "footnote", "other", "caption")

_D = r"(?:[0-9lIOoSB|]{1,6}|[ivxlcdmIVXLCDM]{1,10})"
_NUM = re.compile(rf"\s*(?:[-–—]\s*{_D}\s*[-–—]|\[\s*{_D}\s*\]|(?:page|Page|PAGE|p\.|Seite)\s*{_D}|{_D}\s*/\s*{_D}|({_D}))\s*$")
_BOTH = re.compile(rf"\s*(?:{_D}\s{{2,}}(\S.*?)|(\S.*?)\s{{2,}}{_D})\s*$")
_SKIP = re.compile(r"\s{4}|def |\||[A-Z]_\d+ = ")
_ITEM = re.compile(r"(?:[-•*]|\d{1,3}\))\s")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_TOKEN = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"(?<![^\W\d_])([^\W\d_]++)-(?=([^\W\d_]+))")
_BROKEN = re.compile(r"(?<![^\W_])([^\W_]+)([-¬‐­])\s*$")
_SIGNS = ("-", "¬", "\u2010", "\u00ad")
_AT_END = re.compile(r"(?<![^\W_])[^\W_]++[-¬‐\u00ad][^\S\n]*\n\s*(?:[^\W_]+)?")
_FIRST = re.compile(r"\s*([^\W_]+)")

SCAN = "table_name string, record_id string, doc string, line_no int, kind string, a string, b string, page int"
COUNTS = "word string, kind string, n long"
NOISE = "table_name string, record_id string, line_no int, noise_kind string"


def _key(line: str) -> str:
    return " ".join(re.sub(r"[^\w\s]|_", " ", line.lower().translate({48: "o", 49: "l", 53: "s", 54: "b"})).split())


def _title_like(line: str, least: int = 2) -> bool:
    """Whether a line is short, without a sentence's end, and capitalised like a running head."""
    t = " ".join(line.split())
    if not 4 <= len(t) <= 100 or t[-1] in ".,;!?…。" or ". " in t:
        return False
    words = [w for w in re.findall(r"[^\W_]+", t) if len(w) >= 4]
    if len(re.findall(r"[^\W\d_]+", t)) < least or not words:
        return False
    return sum(w[0].isupper() or w[0].isdigit() for w in words) >= 0.8 * len(words) and any(c.isupper() for c in t)


def _kind_of_line(line: str) -> tuple[str, str]:
    """(``num``/``both``/``head``/``text``, key or form) of a line by its shape."""
    if len(line) > 130:
        return "text", ""
    if m := _NUM.match(line):
        return ("num", "bare" if m.group(1) else "set") if line.strip() else ("text", "")
    if "  " in line.strip() and (m := _BOTH.match(line)):
        rest = m.group(1) or m.group(2)
        if _title_like(rest, 1):
            return "both", _key(rest)
    if _title_like(line):
        return "head", _key(line)
    return "text", ""


def _paragraphs(lines: list[str]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if line.strip():
            out[-1].append(i)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _plain(text: str) -> str:
    """``text`` with look-alikes folded; soft hyphens at the end of a line stay."""
    return text if text.isascii() else fold(re.sub(r"­(?=\s*\n)", "¬", text))


def _skipped(lines: list[str], p: list[int]) -> bool:
    """Code, tables, formulas and list items of one line are not running text."""
    return bool(_SKIP.match(lines[p[0]])) or len(p) == 1 and bool(_ITEM.match(lines[p[0]])) and not _NUM.match(lines[p[0]])


def _value(number: str) -> int | None:
    """The value of an arabic or roman page number."""
    t = number.strip().lower()
    if t.isdigit():
        return int(t)
    n = [_ROMAN.get(c, 0) for c in t]
    return sum(-a if a < b else a for a, b in zip(n, n[1:] + [0])) if n and all(n) else None


def _running(text: str, page: int | None = None) -> tuple[list[str], list[tuple[int, str, str]], list[int]]:
    """Lines of the folded text, candidates for furniture as (line, kind, form or key), and lines of running text."""
    lines = _plain(text).split("\n")
    furniture: list[tuple[int, str, str]] = []
    running: list[int] = []
    for p in _paragraphs(lines):
        if _skipped(lines, p):
            continue
        kinds = [_kind_of_line(lines[i]) for i in p]
        for j, (i, (k, v)) in enumerate(zip(p, kinds)):
            near = [kinds[x][0] for x in (j - 1, j + 1) if 0 <= x < len(p)]
            if k == "num":
                if j in (0, len(p) - 1) or "head" in near:
                    sure = v == "set" or len(p) == 1 or "head" in near or page is not None and _value(lines[i]) == page
                    furniture.append((i, "num", "sure" if sure else "bare"))
                    continue
            elif k == "both":
                furniture += [(i, "num", "sure"), (i, "sure", v)]
                continue
            elif k == "head":
                furniture.append((i, "sure" if "num" in near else "head", v))
                continue
            running.append(i)
    return lines, furniture, running


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    compounds: Counter = Counter()

    def flush() -> pd.DataFrame:
        rows = [(w, "word", n) for w, n in words.items()] + [(w, "compound", n) for w, n in compounds.items()]
        words.clear(), compounds.clear()
        return pd.DataFrame(rows, columns=["word", "kind", "n"])

    for b in batches:
        for text in b["text"]:
            if text:
                t = _AT_END.sub(" ", _plain(text).lower())
                words.update(_TOKEN.findall(t))
                if "-" in t:
                    compounds.update(f"{x}-{y}" for x, y in _COMPOUND.findall(t))
        if len(words) > 200_000:
            yield flush()
    yield flush()


def _scanner(known: frozenset[str]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for table, rid, doc, page, role, text in zip(b["table_name"], b["record_id"], b["doc"], b["page"], b["role"], b["text"]):
                if not text or role == "skip":
                    continue
                page = None if page is None or page != page else int(page)
                if role == "title":
                    rows.append((table, rid, doc, 0, "title", _key(text), None, page))
                    continue
                if role == "front" and "\n" not in text and not _kind_of_line(text)[0] == "num":
                    if _kind_of_line(text)[0] == "head":
                        rows.append((table, rid, doc, 0, "title", _key(text), None, page))
                    continue
                lines, furniture, running = _running(text, page if table == "blocks" else None)
                rows += [(table, rid, doc, i, k, v, None, page) for i, k, v in furniture]
                taken: set[tuple[int, int]] = set()
                for j, i in enumerate(running):
                    m = _BROKEN.search(lines[i]) if lines[i].rstrip()[-1:] in _SIGNS else None
                    if m and not m.group(1).isdigit():
                        nxt = running[j + 1] if j + 1 < len(running) else None
                        right = _FIRST.match(lines[nxt]) if nxt is not None else None
                        if right and not right.group(1)[0].islower() and not right.group(1)[0].isdigit():
                            continue
                        left = m.group(1).lower()
                        rows.append((table, rid, doc, i, "hyphen" if m.group(2) == "-" else "sign", left, right.group(1).lower() if right else None, page))
                        taken.add((i, m.start(1)))
                        if right:
                            taken.add((nxt, right.start(1)))
                            if (w := left + right.group(1).lower()) not in known:
                                rows.append((table, rid, doc, i, "word", w, f"{len(left)}:{nxt}", page))
                for i in running:
                    for m in _TOKEN.finditer(lines[i]):
                        w = m.group().lower()
                        if len(w) > 2 and w not in known and not w.isdigit() and (i, m.start()) not in taken:
                            rows.append((table, rid, doc, i, "word", w, m.group(), page))
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "doc", "line_no", "kind", "a", "b", "page"]).astype({"page": "Int32", "line_no": "int32"})

    return scan


def anagram_hash(word: F.Column) -> F.Column:
    """Sum of the code points to the fifth power: equal for anagrams, moved by a fixed amount by a confusion."""
    points = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.ascii(F.substr(word, i, F.lit(1))).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda s, c: s + c * c * c * c * c)


def _spelt(words: DataFrame) -> DataFrame:
    """Words of letters whose fifth powers can be summed up: Latin, Greek and Cyrillic ones, and digits."""
    return words.where((F.length("word") > 2) & (F.length("word") <= LONGEST) & F.col("word").rlike("^[0-9a-zß-ԯ]+$"))


def learnt_confusions(words: DataFrame, least: int = 5, ratio: float = 10.0, support: int = 8, most: int = 200) -> list[tuple[str, str]]:
    """What is printed and what recognition makes of it, by the corpus: words(word, n).

    Words of five letters or more that differ in one place, by one or two characters, are joined by what they share.  A difference
    counts when at least ``support`` rare words become frequent ones by it and it hardly ever turns a frequent word into another
    frequent one, as inflections do.  At most ``most`` are taken, those with the most pairs.
    """
    w = _spelt(words).where(F.length("word") >= 5)
    place = lambda size: F.transform(
        F.sequence(F.lit(1), F.length("word") - size + 1),
        lambda i: F.struct(F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.lit("*"), F.substr(F.col("word"), i + size)).alias("key"), F.substr(F.col("word"), i, F.lit(size)).alias("part")),
    )
    keys = w.select("word", "n", F.explode(F.concat(place(1), place(2))).alias("k")).select("word", "n", "k.key", "k.part")
    right = keys.where((F.col("n") >= least) & ~F.col("word").rlike("[0-9]")).select("key", F.col("part").alias("true"), F.col("word").alias("right"), F.col("n").alias("right_n"))
    j = keys.join(right, "key").where((F.col("part") != F.col("true")) & (F.length("part") + F.length("true") < 4) & (F.substring("part", 1, 1) != F.substring("true", 1, 1)) & (F.substring("part", -1, 1) != F.substring("true", -1, 1)))
    rare = F.col("right_n") >= ratio * F.col("n")
    pairs = j.groupBy("true", F.col("part").alias("seen")).agg(F.count_distinct(F.when(rare, F.struct("word", "right"))).alias("rare"), F.count_distinct(F.when(~rare & (F.col("n") >= least), F.struct("word", "right"))).alias("both"))
    good = pairs.where((F.col("rare") >= support) & (F.col("rare") >= 10 * F.col("both"))).orderBy(F.desc("rare"), "true", "seen").limit(most)
    return [(r["true"], r["seen"]) for r in good.collect()]


def corrections(words: DataFrame, least: int = 5, ratio: float = 10.0, confusions: list[tuple[str, str]] | None = None) -> DataFrame:
    """word -> right, at: rare words of ``words(word, n)`` that one confusion explains by a frequent word.

    least: occurrences of a frequent word; ratio: how many times more frequent than the rare word it must be; confusions: what
    is printed and what is seen, besides the known ones.
    """
    spelt = _spelt(words)
    power = lambda s: sum(ord(c) ** 5 for c in s)
    known = list(dict.fromkeys([*CONFUSIONS, *(confusions or [])]))
    table = F.array(*(F.struct(F.lit(a).alias("true"), F.lit(x).alias("seen"), F.lit(power(a) - power(x)).cast("long").alias("delta")) for a, x in known))
    rare = (
        spelt.select("word", F.col("n").alias("rare_n"), anagram_hash(F.col("word")).alias("h"))
        .withColumn("c", F.explode(F.filter(table, lambda c: F.contains(F.col("word"), c["seen"]))))
        .select("word", "rare_n", "c.true", "c.seen", (F.col("h") + F.col("c.delta")).alias("h"))
    )
    frequent = spelt.where((F.col("n") >= least) & ~F.col("word").rlike("[0-9]")).select(F.col("word").alias("right"), F.col("n").alias("right_n"), anagram_hash(F.col("word")).alias("h"))
    w, x, a = F.col("word"), F.col("seen"), F.col("true")
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(w) - F.length(x) + 1, F.lit(1))),
        lambda i: (F.substr(w, i, F.length(x)) == x) & (F.concat(F.substr(w, F.lit(1), i - 1), a, F.substr(w, i + F.length(x))) == F.col("right")),
    )
    pairs = rare.join(frequent, "h").where(F.col("right_n") >= ratio * F.col("rare_n")).withColumn("at", F.get(places, 0)).where(F.col("at").isNotNull())
    return pairs.groupBy("word").agg(F.min_by(F.struct("right", "at"), F.struct(-F.col("right_n"), F.col("right"))).alias("best")).select("word", "best.right", "best.at")


def _inputs(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    role = (
        F.when(F.col("block_type") == "title", "title")
        .when(F.coalesce("is_document_metadata", F.lit(False)) | (F.col("ordinal") <= 2), "front")
        .when(F.col("block_type").isin(*RUNNING), "run")
        .otherwise("skip")
    )
    b = blocks.select(F.lit("blocks").alias("table_name"), F.col("block_id").cast("string").alias("record_id"), F.col("document_id").alias("doc"), F.col("page_number").cast("int").alias("page"), role.alias("role"), "text")
    c = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").cast("string").alias("record_id"), F.col("document_id").alias("doc"), F.col("page_start").cast("int").alias("page"), F.lit("run").alias("role"), "text")
    return b.unionByName(c)


def evidence(blocks: DataFrame, chunks: DataFrame, known_words: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Decided noise with what repairs it: table_name, record_id, line_no, noise_kind, a, b, right, at; and the counts.

    known_words: how many of the most frequent words without a correction the tasks get to skip (a bound of what is sent).
    """
    texts = blocks.where(F.col("text").isNotNull() & F.col("block_type").isin(*RUNNING, "list_item"))
    counts = spread(texts.select("text")).mapInPandas(_count_words, COUNTS).groupBy("word", "kind").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    words = counts.where("kind = 'word'").select("word", "n")
    fixes = corrections(words, confusions=learnt_confusions(words)).persist(StorageLevel.MEMORY_AND_DISK)
    # at most two million words have such a share of all; eight tasks then send known_words each
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") * 2_000_000 >= total).join(fixes, "word", "left_anti").repartition(8, "word")
    known = frozenset(r["word"] for r in frequent.orderBy(F.desc("n"), "word").limit(known_words).collect())
    scan = spread(_inputs(blocks, chunks)).mapInPandas(_scanner(known), SCAN).persist(StorageLevel.MEMORY_AND_DISK)
    where = ["table_name", "record_id", "line_no"]
    none = F.lit(None).cast("string")

    # running heads: sure by their page number, or keys that the document repeats, or nearly such keys
    heads = scan.where(F.col("kind").isin("head", "sure")).select(*where, "doc", "kind", "a", "page")
    repeated = heads.groupBy("doc", "a").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("n"))
    of_doc = repeated.groupBy("doc").agg(F.sum("n").alias("all"))
    # a key that others may nearly equal has a twentieth of the document's candidates: at most twenty such keys
    strong = repeated.where("pages >= 2").join(of_doc, "doc").where("n >= all / 20").select("doc", F.col("a").alias("strong"))
    strong = strong.unionByName(scan.where("kind = 'title' and length(a) > 3").select("doc", F.col("a").alias("strong")).distinct()).distinct()
    exact = repeated.where("pages >= 2").select("doc", "a")
    limit = F.greatest(F.lit(2), F.ceil(F.length("strong") * 0.2)).cast("int")
    near = heads.where("kind = 'head'").select("doc", "a").distinct().join(strong, "doc").where(F.levenshtein("a", "strong") <= limit).select("doc", "a")
    confirmed = heads.where("kind = 'head'").join(exact.unionByName(near).distinct(), ["doc", "a"], "left_semi")
    headers = heads.where("kind = 'sure'").select(*where).unionByName(confirmed.select(*where))

    numbers = scan.where("kind = 'num'").select(*where, "doc", "a", "page")
    enough = numbers.where("table_name = 'blocks'").groupBy("doc").agg(F.count("*").alias("n")).where("n >= 2").select("doc")
    numbers = numbers.where("a = 'sure'").select(*where).unionByName(numbers.where("a = 'bare'").join(enough, "doc", "left_semi").select(*where))

    # words broken for want of room
    compounds = counts.where("kind = 'compound'").select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    prefixes = compounds.groupBy(F.substring_index("compound", "-", 1).alias("a")).agg(F.sum("n_compound").alias("n_prefix"))
    broken = (
        scan.where(F.col("kind").isin("hyphen", "sign"))
        .select(*where, "kind", "a", "b")
        .withColumn("joined", F.concat("a", "b"))
        .withColumn("compound", F.concat_ws("-", "a", "b"))
        .join(words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
        .join(compounds, "compound", "left")
        .join(prefixes, "a", "left")
    )
    j, c = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    broken = broken.where(F.when((j > 0) | (c > 0), j >= c).otherwise(F.col("n_prefix").isNull() | (F.col("kind") == "sign")))

    found = (
        headers.select(*where, F.lit("header").alias("noise_kind"), none.alias("a"), none.alias("b"), none.alias("right"), F.lit(None).cast("int").alias("at"))
        .unionByName(numbers.select(*where, F.lit("page_number").alias("noise_kind"), none.alias("a"), none.alias("b"), none.alias("right"), F.lit(None).cast("int").alias("at")))
        .unionByName(broken.select(*where, F.lit("hyphenation").alias("noise_kind"), "a", "b", none.alias("right"), F.lit(None).cast("int").alias("at")))
    )
    misread = scan.where("kind = 'word'").select(*where, F.col("a").alias("word"), "b").join(fixes, "word")
    # of a broken word, the line that holds the wrong characters
    cut = F.try_to_number(F.substring_index("b", ":", 1), F.lit("999999")).cast("int")
    second = F.col("b").contains(":") & (F.col("at") > cut)
    line = F.when(second, F.substring_index("b", ":", -1).cast("int")).otherwise(F.col("line_no"))
    misread = misread.select("table_name", "record_id", line.alias("line_no"), F.lit("misread").alias("noise_kind"), F.col("word").alias("a"), "b", "right", "at")
    return found.unionByName(misread), counts


def noise(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """table_name, record_id, line_no, noise_kind of every noisy line, each once."""
    return evidence(blocks, chunks)[0].select("table_name", "record_id", "line_no", "noise_kind").distinct()


def repair_text(text: str, marks: list, running: bool = True) -> str:
    """``text`` as continuous paragraphs, given its noise as (line_no, noise_kind, a, b, right).

    Lines of a paragraph become one; list items keep lines of their own, and so do code, tables and formulas.  A text that
    isn't running text stays as it is.
    """
    if not running and not marks:
        return text
    gone = {m["line_no"] for m in marks if m["noise_kind"] in ("header", "page_number")}
    broken = {m["line_no"] for m in marks if m["noise_kind"] == "hyphenation"}
    wrong: dict[str, str] = {m["a"]: m["right"] for m in marks if m["noise_kind"] == "misread"}
    if not marks and "\n" not in text:
        return text
    lines = (_plain(text) if marks else text).split("\n")
    out: list[str] = []
    for p in _paragraphs(lines):
        if _skipped(lines, p):
            out.append("\n".join(lines[i] for i in p))
            continue
        s = ""
        glue = True
        for i in p:
            if i in gone:
                continue
            s += ("" if glue else "\n" if _ITEM.match(lines[i].lstrip()) else " ") + lines[i].strip()
            glue = False
            if i in broken and (m := _BROKEN.search(s)):
                s, glue = s[: m.end(1)], True
            elif s.endswith("-"):
                glue = True
        if wrong and s:
            s = _TOKEN.sub(lambda m: _recase(m.group(), wrong.get(m.group().lower(), m.group())), s)
        if s:
            out.append(s)
    return "\n\n".join(out)


def _recase(seen: str, right: str) -> str:
    if seen == right or seen.lower() == right:
        return seen
    if seen.isupper() and len(seen) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, r, repair_text(x["text"], list(m), x["running"])) for t, r, texts, m in zip(b["table_name"], b["record_id"], b["texts"], b["marks"]) for x in texts]
        yield pd.DataFrame(rows, columns=["table_name", "record_id", "text"])


def repaired(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every text of both tables, repaired: table_name, record_id, text."""
    found, _ = evidence(blocks, chunks)
    mark = F.struct("line_no", "noise_kind", "a", "b", "right")
    marks = found.select("table_name", "record_id", F.lit(None).cast("struct<text:string,running:boolean>").alias("text"), mark.alias("mark"))
    text = F.struct("text", (F.col("role") == "run").alias("running"))
    texts = _inputs(blocks, chunks).where(F.col("text").isNotNull()).select("table_name", "record_id", text.alias("text"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"))
    both = texts.unionByName(marks).groupBy("table_name", "record_id").agg(F.collect_set("text").alias("texts"), F.collect_set("mark").alias("marks"))
    return both.mapInPandas(_repair, "table_name string, record_id string, text string").distinct()
