"""Evaluation texts leaking into training text (problem 7).

Method: winnowing.  Of the hashes of every ``K`` words in a row the smallest of each ``WINDOW`` neighbours is kept, in texts and
passages alike, so every shared span of ``K + WINDOW - 1`` words or more has a fingerprint on both sides.  A text is compared
with a passage where, within a stretch at most three times as long as the passage, they share as many fingerprints as half of
the passage must at least have when it stands there in such spans.  Each hit is then extended: the text around the
fingerprints must hold half of the passage's words in their order, by number and by weight, a word's weight being its
rarity among all documents (else chance runs of common words count).  Those bounds are exact; nothing else rejects a pair.

Words are compared in one character form, without case and punctuation; characters of scripts without spaces are words.
Passages are a query set: they are compared with all texts in blocks of ``block`` characters.

Behaviour in corner cases: null and blank texts and passages leak nothing; repeated rows give a pair once; a passage too short
for a guaranteed span is sought by every run of half its words, down to one word; a passage whose words are in every
document weighs by number only; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import fold
from lectern.llm.tasks import spread

_WORDS = re.compile(r"[฀-๿⺀-〿぀-ヿ㐀-鿿豈-﫿]|[^\W_฀-๿⺀-〿぀-ヿ㐀-鿿豈-﫿]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = re.compile("[a-z0-9]+")
STRETCH = 3
K, WINDOW = 7, 2


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return _PLAIN.findall(text.lower()) if text.isascii() else _WORDS.findall(fold(text).casefold())


def winnow(numbers: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of a sequence of word numbers."""
    if len(numbers) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(numbers) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = (h ^ numbers[i : i + len(h)].astype(np.uint64)) * _BASE
            h ^= h >> np.uint64(29)
    if window == 1:
        return np.arange(len(h)), h
    if len(h) <= window:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
        return at, h[at]
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    # the rightmost minimum never moves back, so equal places stand together
    at = np.arange(len(views)) + window - 1 - views.argmin(axis=1)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def least_prints(needed: float, k: int, window: int) -> int:
    """How many fingerprints ``needed`` words have at least when they stand in spans of ``k + window - 1`` words or more."""
    return max(1, math.ceil(needed / (k + 2 * window - 2)))


def bits(a: list) -> dict:
    """The places of each member of a list as bits of one long number."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    return place


def lcs(a: list, b: list, place: dict | None = None) -> int:
    """Length of the longest common subsequence, by bits of one long number."""
    place = bits(a) if place is None else place
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & place.get(y, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def heaviest(a: list, b: list, weight: dict) -> float:
    """Largest weight of a common subsequence."""
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    places = {x: np.array(at) for x, at in places.items()}
    row = np.zeros(len(b) + 1)
    for x in a:
        if (at := places.get(x)) is not None:
            more = row[at] + weight[x]
            at = at + 1
            row[at] = np.maximum(row[at], more)
            np.maximum.accumulate(row, out=row)
    return float(row[-1])


class Passages:
    """Different passages, their words numbered, with each word's weight and their fingerprints."""

    def __init__(self, items: list[tuple[int, list[str]]], weight: dict[str, float], share: float = 0.5, k: int = K, window: int = WINDOW) -> None:
        same: dict[tuple[str, ...], list[int]] = {}
        for i, found in items:
            same.setdefault(tuple(found), []).append(i)
        self.names = list(same.values())
        words_of = list(same)
        self.number = {w: n for n, w in enumerate(sorted({w for p in words_of for w in p}))}
        self.rows = [[self.number[w] for w in p] for p in words_of]
        self.places = [bits(r) for r in self.rows]
        self.each = np.array([weight[w] for w in self.number] + [0.0])
        self.least_n = [share * len(r) for r in self.rows]
        self.least_w = [share * float(self.each[r].sum()) - 1e-9 for r in self.rows]
        self.bags, self.worth = [], []
        for r in self.rows:
            bag, first = Counter(r), Counter(r[: len(r) // 2])
            self.worth.append({w: n * float(self.each[w]) for w, n in bag.items()})
            self.bags.append(tuple(np.array(x, dtype=np.int64) for x in ([*bag], [first[w] for w in bag], [n - first[w] for w, n in bag.items()])))
        self.cap = np.zeros(len(self.number) + 1, dtype=np.int64)
        # passages by how they are sought: the words of a fingerprint, the window, the least number to share
        self.bar = np.ones(len(self.rows), dtype=np.int64)
        sought: dict[tuple[int, int], list[int]] = {}
        for j, r in enumerate(self.rows):
            if len(r) < k + window - 1:
                sought.setdefault((max(1, math.ceil(share * len(r))), 1), []).append(j)
            else:
                self.bar[j] = least_prints(self.least_n[j], k, window)
                sought.setdefault((k, window), []).append(j)
        self.prints = [(*how, *self._index(js, *how)) for how, js in sorted(sought.items())]

    def _index(self, js: list[int], k: int, window: int) -> tuple[np.ndarray, ...]:
        """Hashes in order, where each one's owners begin, the owners, and how often each has it."""
        owners: dict[int, Counter] = {}
        for j in js:
            for h in winnow(np.array(self.rows[j]), k, window)[1].tolist():
                owners.setdefault(h, Counter())[j] += 1
        hashes = sorted(owners)
        size = np.array([len(owners[h]) for h in hashes])
        return (
            np.array(hashes, dtype=np.uint64), np.cumsum(size) - size, size,
            np.array([j for h in hashes for j in owners[h]]), np.array([n for h in hashes for n in owners[h].values()]),
        )

    def found(self, texts: list[list[str]]) -> list[list[int]]:
        """For each text the names of the passages that it holds."""
        get, none = self.number.get, len(self.number)
        numbers = [get(w, none) for t in texts for w in (*t, None)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        held: list[list[int]] = [[] for _ in texts]
        row = np.array(numbers, dtype=np.int64)
        for d, j, stretches in self._candidates(row, ends):
            if any(self._holds(j, numbers[a:b], row[a:b]) for a, b in stretches):
                held[d] += self.names[j]
        return held

    def _candidates(self, row: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Text, passage and the parts of the text in which they share enough fingerprints."""
        for k, window, hashes, start, size, owner, times in self.prints:
            at, h = winnow(row, k, window)
            x = np.searchsorted(hashes, h)
            x[x == len(hashes)] = 0
            hit = hashes[x] == h
            at, x = at[hit], x[hit]
            parts = size[x]
            each = np.repeat(start[x] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
            j, n, at, x = owner[each], times[each], np.repeat(at, parts), np.repeat(x, parts)
            doc = np.searchsorted(ends, at, side="right")
            key = doc * len(self.rows) + j
            order = np.argsort(key, kind="stable")
            key, at, n, x = key[order], at[order], n[order], x[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(first):
                continue
            last = np.append(first[1:], len(key))
            enough = np.add.reduceat(n, first) >= self.bar[key[first] % len(self.rows)]
            for a, b, i in zip(first[enough].tolist(), last[enough].tolist(), key[first[enough]].tolist()):
                d, p = divmod(i, len(self.rows))
                low, high = int(ends[d - 1]) if d else 0, int(ends[d]) - 1
                if stretches := self._stretches(p, k, at[a:b].tolist(), n[a:b].tolist(), x[a:b].tolist(), low, high):
                    yield d, p, stretches

    def _stretches(self, j: int, k: int, at: list[int], n: list[int], x: list[int], low: int, high: int) -> list[tuple[int, int]]:
        most, bar = STRETCH * len(self.rows[j]), int(self.bar[j])
        out: list[tuple[int, int]] = []
        there: dict[int, int] = {}
        begin = shared = 0
        for end, (place, times, h) in enumerate(zip(at, n, x)):
            there[h] = there.get(h, 0) + 1
            if there[h] == 1:
                shared += times
            while place + k - at[begin] > most:
                there[x[begin]] -= 1
                if not there[x[begin]]:
                    shared -= n[begin]
                begin += 1
            if shared >= bar:
                a, b = max(low, place + k - most), min(high, at[begin] + most)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
        return out

    def _holds(self, j: int, text: list[int], row: np.ndarray) -> bool:
        """Whether some stretch of a part of a text has enough of a passage in its order."""
        p, place = self.rows[j], self.places[j]
        part = [y for y in text if y in place]
        # the weight of its words in whatever order, then their number in order
        if len(part) < self.least_n[j] or sum(map(self.worth[j].__getitem__, set(part))) < self.least_w[j] or lcs(p, part, place) < self.least_n[j]:
            return False
        most = STRETCH * len(p)
        if len(text) <= most:
            return heaviest(p, part, self.each) >= self.least_w[j]
        xs, first, second = self.bags[j]
        self.cap[xs] = first + second
        at = np.flatnonzero(self.cap[row])
        numbers = row[at]
        cap = self.cap[numbers]
        self.cap[xs] = first
        early = self.cap[numbers]
        late = cap - early
        self.cap[xs] = 0
        weight = self.each[numbers]
        ends = np.searchsorted(at, at + most)

        def enough(a: int, b: int) -> bool:
            some = slice(a, ends[b])
            n, w = halves(numbers[some], early[some], late[some], weight[some])
            if n < self.least_n[j] or w < self.least_w[j]:
                return False
            part = numbers[some].tolist()
            return lcs(p, part, place) >= self.least_n[j] and heaviest(p, part, self.each) >= self.least_w[j]

        n, w = windows(at, numbers, cap, weight, most)
        # a stretch that ends with the one before it holds nothing more
        starts = np.flatnonzero((n >= self.least_n[j]) & (w >= self.least_w[j]) & (np.diff(ends, prepend=0) > 0))
        if not len(starts):
            return False
        best = int(starts[np.argmax(w[starts])])
        if enough(best, best):
            return True
        # what the stretches from a to b don't hold together none of them holds
        near = at[starts] // max(1, most // 8)
        todo = [x.tolist() for x in np.split(starts, np.flatnonzero(np.diff(near)) + 1)]
        while todo:
            some = todo.pop()
            if enough(some[0], some[-1]):
                if len(some) == 1:
                    return True
                todo += [some[len(some) // 2 :], some[: len(some) // 2]]
        return False


def windows(at: np.ndarray, numbers: np.ndarray, cap: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For the stretch of ``most`` places from each place on: how many words it has, and their weight, none counted more than ``cap`` times."""
    order = np.argsort(numbers, kind="stable")
    x, places = numbers[order], at[order]
    earlier = np.arange(len(x)) - cap[order]
    before = np.where(earlier >= np.searchsorted(x, x), places[np.maximum(earlier, 0)], -1)
    # a word counts in the stretches that begin after its cap-th occurrence before and reach it
    first = np.searchsorted(at, np.maximum(before, places - most) + 1)
    size = len(at) + 1
    n = np.bincount(first, minlength=size) - np.bincount(order + 1, minlength=size)
    w = np.bincount(first, weights=weight[order], minlength=size) - np.bincount(order + 1, weights=weight[order], minlength=size)
    return np.cumsum(n)[:-1], np.cumsum(w)[:-1] + 1e-9


def halves(numbers: np.ndarray, early: np.ndarray, late: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """Bounds of the number and the weight of a common subsequence: words of a passage's first half stand before some
    place of the text and those of its second half after it.

    early, late: how often each word stands in the first and the second half of the passage.
    """
    order = np.argsort(numbers, kind="stable")
    x, i = numbers[order], np.arange(len(numbers))
    before, after = np.empty_like(i), np.empty_like(i)
    before[order] = i - np.searchsorted(x, x)
    after[order] = np.searchsorted(x, x, side="right") - 1 - i
    before, after = before < early, after < late
    out = []
    for v in (1, weight):
        left, right = np.cumsum(before * v), np.cumsum((after * v)[::-1])[::-1]
        out.append(max(right[0], left[-1], (left[:-1] + right[1:]).max(initial=0)))
    return out[0], out[1] + 1e-9


#: Words that are looked through at once.
CHUNK = 50_000
#: The index of the block that a Python worker has in hand.
_INDEX: dict[str, Passages] = {}


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(w,) for text in b["text"] for w in set(words(text))], columns=["word"])


def frequencies(docs: DataFrame, tested: DataFrame) -> DataFrame:
    """word, n: in how many texts of ``docs(text)`` each word of ``tested(word)`` stands."""
    plain = F.octet_length("text") == F.length("text")
    # words() on texts of plain letters, without leaving the JVM
    ascii_words = docs.where(plain).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    others = docs.where(~plain).select("text").mapInPandas(_distinct_words, "word string")
    return ascii_words.unionByName(others).join(tested, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def _finder(sent, share: float, k: int, window: int):
    name = uuid.uuid4().hex

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = _INDEX.get(name)
        if passages is None:
            _INDEX.clear()
            passages = _INDEX[name] = Passages(*sent.value, share, k, window)
        for b in batches:
            rows, ids, texts, size = [], [], [], 0
            for doc, text in zip(b["doc_id"], b["text"]):
                ids.append(doc)
                texts.append(words(text))
                size += len(texts[-1])
                if size > CHUNK:
                    rows += [(d, i) for d, names in zip(ids, passages.found(texts)) for i in names]
                    ids, texts, size = [], [], 0
            if ids:
                rows += [(d, i) for d, names in zip(ids, passages.found(texts)) for i in names]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"]).astype({"doc_id": "int64", "item_id": "int64"})

    return find


def _blocks(tests: DataFrame, block: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The words of the passages, so many at once as have ``block`` characters."""
    some, size = [], 0
    for r in tests.toLocalIterator():
        if found := words(r["passage"]):
            some.append((r["item_id"], found))
            size += len(r["passage"])
        if size > block:
            yield some
            some, size = [], 0
    if some:
        yield some


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, block: int = 5_000_000, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id of ``documents(doc_id, text)`` that hold passages of ``items(item_id, passage)``.

    share: part of a passage, by number and by weight, that a text must hold.  block: how many characters of passages are
    broadcast at once; every block is compared with all texts.  k, window: of the winnowing; every leak is found whose half
    stands in spans of ``k + window - 1`` words or more, so with 1 and 1 every leak.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(trim(text)) > 0")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("length(trim(passage)) > 0").distinct()
    found = [spark.createDataFrame([], "doc_id long, item_id long")]
    n = docs.count()
    for some in _blocks(tests, block):
        tested = {w for _, p in some for w in p}
        counted = dict(frequencies(docs, F.broadcast(spark.createDataFrame([(w,) for w in sorted(tested)], "word string"))).collect())
        weight = {w: max(math.log((n + 1) / (1 + counted.get(w, 0))), 1e-3) for w in tested}
        sent = spark.sparkContext.broadcast((some, weight))
        found.append(spread(docs).mapInPandas(_finder(sent, share, k, window), "doc_id long, item_id long"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
