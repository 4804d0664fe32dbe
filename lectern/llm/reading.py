"""Reading level of each document (problem 8).

Method: smoothed unigram language models per level (1 easiest to 5 hardest), trained on labelled texts; a text gets the level
of the highest posterior.  The units are the words and, for each word, the class of the length of its sentence, weighted by
``LENGTH_WEIGHT``.  Texts of one level may be hard in different ways (rare words, long sentences), so a level is a mixture
of ``KINDS`` unigram models, fitted by expectation maximisation.  A rater may be one level off: how often follows from the
texts that two raters labelled.  The words of one clause come together, so the likelihood counts clauses, not words: it is raised to
the power ``TEMPER``.  Where there are too few labels, texts are seeded by the Flesch-Kincaid grade formula.

A text is English when English function words outnumber those of other languages and most letters are Latin.

Behaviour in corner cases: null, blank and non-English texts get no row; null or out-of-range labels are ignored; repeated
rows count once; two texts with one id each get a row; words that the labelled texts lack say nothing; ties between levels
go to the lower; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import fold
from lectern.llm.tasks import spread

LEVELS = (1, 2, 3, 4, 5)
#: Words are hashed into so many units; the classes of sentence length follow.
BUCKETS = 1 << 14
#: The most words of a sentence of each class; longer ones form the last class.
LENGTHS = (5, 7, 9, 11, 13, 15, 18, 21, 24, 27, 30, 34, 38, 43, 50, 60)
UNITS = BUCKETS + len(LENGTHS) + 1
LENGTH_WEIGHT = 0.3
KINDS = 8
TEMPER = 0.1
ROUNDS = 25
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of in and to is that with for it on by but or from at as this which not while because after before each during are was were be has have".split(),
    "de": "der die das und ist mit von zu den dem ein eine bei nicht auf für aber nach vor während jedem ohne im des unter an".split(),
    "fr": "le la les et est avec de des un une du pour que dans sur mais après avant chaque sans toute en au aux".split(),
    "es": "el la los y es con de del un una para que en por pero según antes cada sin durante las al".split(),
    "it": "il lo gli e è con di del un una per che in ma dopo prima ogni senza nel della".split(),
    "pt": "o os e é com de do um uma para que em mas depois antes cada sem no da".split(),
    "nl": "de het een en is met van voor dat in op maar na elke zonder niet te".split(),
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_VOWELS = re.compile("[aeiouy]+")
_LINE = re.compile(r"(?m)^([ \t]*(?:[-*•]|#+)[^\n]*)\n")
# words, and what ends a sentence
_ANY = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?](?=[\s\"'”’)\]]|$)|\n(?=\s*\n|[ \t]*(?:[-*•#]|\d))")
_PLAIN = re.compile(r"[a-z]+(?:'[a-z]+)?|[.!?](?=[\s\"')\]]|$)|\n(?=\s*\n|[ \t]*(?:[-*#]|\d))")
_ENDS = frozenset(".!?\n")
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _BY_WORD.setdefault(_w, []).append(_lang)


def tokens(text: str) -> list[str]:
    return _WORD.findall((text if text.isascii() else fold(text)).lower())


def language(text: str, found: list[str] | Counter | None = None) -> str | None:
    """Latin-script language with the most function words; None when there is none or another script prevails."""
    found = Counter(tokens(text) if found is None else found)
    n: dict[str, float] = {}
    for w in _BY_WORD.keys() & found.keys():
        for lang in _BY_WORD[w]:
            n[lang] = n.get(lang, 0.0) + found[w] / len(_BY_WORD[w])
    if not n:
        return None
    best = max(n, key=lambda k: (n[k], k == "en", k))
    if not text.isascii():
        letters = len(_LETTER.findall(text))
        if len(_LATIN.findall(text)) < 0.6 * letters:
            return None
    return best if n[best] >= 0.04 * found.total() else None


def is_english(text: str, found: list[str] | Counter) -> bool:
    return language(text, found) == "en"


def grade(found: Counter, sentences: int) -> float:
    """Flesch-Kincaid grade."""
    syllables = sum(n * max(1, len(_VOWELS.findall(w))) for w, n in found.items())
    return 0.39 * found.total() / max(1, sentences) + 11.8 * syllables / max(1, found.total()) - 15.59


def counted(text: str) -> tuple[Counter, list[int]]:
    """The words of a text, and how many each sentence has; headings and list lines are sentences of their own."""
    plain = text.isascii()
    text = (text if plain else fold(text)).lower()
    if "\n" in text:
        text = _LINE.sub(r"\1\n\n", text)
    found = (_PLAIN if plain else _ANY).findall(text)
    ends = [-1, *(i for i, w in enumerate(found) if w in _ENDS), len(found)]
    words = Counter(found)
    for w in _ENDS:
        words.pop(w, None)
    return words, [b - a - 1 for a, b in zip(ends, ends[1:]) if b - a > 1]


class Units:
    """The units of a text with their weights."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: Counter, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        n: dict[int, float] = {}
        for w, c in words.items():
            u = known.get(w)
            if u is None:
                u = known[w] = zlib.crc32(w.encode()) % BUCKETS
            n[u] = n.get(u, 0) + c
        for k in lengths:
            if k > 2:
                u = BUCKETS + bisect_left(LENGTHS, k)
                n[u] = n.get(u, 0) + LENGTH_WEIGHT * k
        return np.fromiter(n.keys(), np.int32, len(n)), np.fromiter(n.values(), np.float32, len(n))


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels and units of the English texts; without labels the level of the formula."""
    units = Units()
    for b in batches:
        rows = []
        for i, text, votes in zip(b["doc_id"], b["text"], b["votes"]):
            words, lengths = counted(text)
            if not is_english(text, words):
                continue
            if votes is None:
                g = grade(words, len(lengths))
                votes = [0] * len(LEVELS)
                votes[int(g > 4) + int(g > 8) + int(g > 12) + int(g > 17)] = 1
            rows.append((i, votes, *units(words, lengths)))
        yield pd.DataFrame(rows, columns=["doc_id", "votes", "units", "weights"])


def slip(votes: np.ndarray) -> float:
    """How often a rater is off, from the texts that have several labels."""
    n = votes.sum(axis=1)
    pairs, same = (n * (n - 1)).sum(), (votes * (votes - 1)).sum()
    differ = 1 - same / pairs if pairs else 0.0
    return float(np.clip((1 - np.sqrt(max(0.0, 1 - 2 * differ))) / 2, 0.01, 0.3))


class Model:
    """Log probabilities of the units for every kind of text of every level."""

    def __init__(self, votes: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], strength: float = 5.0, seed: int = 0) -> None:
        """votes: how many raters gave a text each level.  bags: units and weights of each text."""
        self.logs = np.zeros((UNITS, len(LEVELS) * KINDS), np.float32)
        self.prior = np.zeros(len(LEVELS) * KINDS, np.float32)
        if not len(bags):
            return
        used, texts = np.unique(np.concatenate([u for u, _ in bags]), return_counts=True)
        used = used[texts > 1]
        if not len(used):
            return
        column = np.full(UNITS, -1)
        column[used] = np.arange(len(used))
        eye = lambda k: np.eye(len(LEVELS), k=k)
        off = slip(votes)
        rated = (1 - 2 * off) * eye(0) + off * (eye(1) + eye(-1)) + 1e-9
        rated = np.log(rated / rated.sum(axis=1, keepdims=True))
        # the level that raters gave is one of the kinds of that level or, seldom, of the next
        given = np.repeat(votes @ rated.T, KINDS, axis=1)
        share = np.repeat(votes / votes.sum(axis=1, keepdims=True), KINDS, axis=1)
        share = share * np.random.default_rng(seed).dirichlet(np.full(KINDS, 0.5), size=(len(bags), len(LEVELS))).reshape(len(bags), -1)
        total = np.zeros(len(used))
        for u, w in bags:
            keep = column[u] >= 0
            total[column[u[keep]]] += w[keep]
        back = (total + 0.1) / (total + 0.1).sum()
        for last in range(ROUNDS, 0, -1):
            counts = np.zeros((share.shape[1], len(used)))
            for a, x in self._blocks(bags, column, len(used)):
                counts += share[a : a + len(x)].T @ x
            logs = np.log((counts + strength * back) / (counts.sum(axis=1, keepdims=True) + strength))
            prior = np.log((share.sum(axis=0) + 0.5) / (len(bags) + 0.5 * share.shape[1]))
            if last == 1:
                break
            for a, x in self._blocks(bags, column, len(used)):
                s = TEMPER * (x @ logs.T.astype(np.float32)) + prior + given[a : a + len(x)]
                s = np.exp(s - s.max(axis=1, keepdims=True))
                share[a : a + len(x)] = s / s.sum(axis=1, keepdims=True)
        self.logs[used] = TEMPER * logs.T
        self.prior = prior.astype(np.float32)

    @staticmethod
    def _blocks(bags: list, column: np.ndarray, width: int, size: int = 512) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(bags), size):
            some = bags[a : a + size]
            x = np.zeros((len(some), width), np.float32)
            for r, (u, w) in enumerate(some):
                at = column[u]
                x[r, at[at >= 0]] = w[at >= 0]
            yield a, x

    def levels(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        s = np.stack([w @ self.logs[u] for u, w in bags]) + self.prior
        return np.array(LEVELS)[np.logaddexp.reduce(s.reshape(len(bags), len(LEVELS), KINDS), axis=2).argmax(axis=1)]


def train(documents: DataFrame, labels: DataFrame, most_labelled: int = 10_000, fewest: int = 10) -> Model:
    """The model from at most ``most_labelled`` labelled documents (chosen by a hash of their id), or, where fewer than
    ``fewest`` English texts are labelled, from as many documents seeded by formula."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "rater", F.col("reading_level").cast("int").alias("reading_level")).where(F.col("reading_level").isin(*LEVELS)).distinct()
    votes = F.array(*(F.count_if(F.col("reading_level") == v).cast("int") for v in LEVELS))
    rated = rated.groupBy("doc_id").agg(votes.alias("votes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(trim(text)) > 0")

    def collect(chosen: DataFrame) -> list:
        # at most most_labelled small rows are broadcast, and at most UNITS numbers of each text come back
        rows = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(_examples, "doc_id long, votes array<int>, units array<int>, weights array<float>").collect()
        return sorted(((r["doc_id"], r["votes"], np.array(r["units"], np.int32), np.array(r["weights"], np.float32)) for r in rows), key=lambda x: (x[0], x[1], len(x[2]), float(x[3].sum())))

    rows = collect(rated)
    if len(rows) < fewest:
        chosen = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
        rows = collect(chosen.withColumn("votes", F.lit(None).cast("array<int>")))
    return Model(np.array([r[1] for r in rows], dtype=float).reshape(-1, len(LEVELS)), [r[2:] for r in rows])


def _assigner(model: Model):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units()
        for b in batches:
            ids, bags = [], []
            for i, text in zip(b["doc_id"], b["text"]):
                words, lengths = counted(text)
                if is_english(text, words):
                    ids.append(i)
                    bags.append(units(words, lengths))
            levels = model.levels(bags) if bags else []
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "reading_level": pd.Series(levels, dtype="int32")})

    return assign


def reading_levels(documents: DataFrame, labels: DataFrame, most_labelled: int = 10_000) -> DataFrame:
    """doc_id, reading_level of the English texts of ``documents(doc_id, text)``."""
    model = train(documents, labels, most_labelled)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(trim(text)) > 0")
    return spread(texts).mapInPandas(_assigner(model), "doc_id long, reading_level int").distinct()


def profile(levels: DataFrame) -> DataFrame:
    """reading_level, documents: how many texts have each level."""
    return levels.groupBy("reading_level").agg(F.count("*").alias("documents"))
