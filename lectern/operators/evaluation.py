"""Quality of retrieval: relevance, ranks, recall, reciprocal rank, thresholds."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.normal import for_search


class Phrases:
    """Finds which of many phrases stand in a text, in one pass over its characters."""

    def __init__(self, phrases: list[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for n, phrase in enumerate(phrases):
            at = 0
            for c in phrase:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append([])
                at = self.step[at][c]
            self.ends[at].append(n)
        self.back = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.step[at].items():
                b = self.back[at]
                while b and c not in self.step[b]:
                    b = self.back[b]
                self.back[to] = self.step[b].get(c, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]
                queue.append(to)

    def inside(self, text: str) -> set[int]:
        out: set[int] = set()
        at, step, back, ends = 0, self.step, self.back, self.ends
        for c in text:
            while at and c not in step[at]:
                at = back[at]
            at = step[at].get(c, 0)
            if ends[at]:
                out.update(ends[at])
        return out


class WordPhrases:
    """The same by the words of a text: phrases hang on one of their inner words, the one that fewest of them have, and only texts
    with that word are looked at.  Phrases without an inner word are sought by characters."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = phrases
        n: dict[str, int] = {}
        inner = []
        for p in phrases:
            words = p.split(" ")[1:-1]
            inner.append(words)
            for w in set(words):
                n[w] = n.get(w, 0) + 1
        self.by: dict[str, list[int]] = {}
        rest = []
        for i, words in enumerate(inner):
            if words:
                self.by.setdefault(min(words, key=lambda w: (n[w], -len(w), w)), []).append(i)
            else:
                rest.append(i)
        self.rest = rest
        self.chars = Phrases([phrases[i] for i in rest]) if len(rest) > 50 else None

    def inside(self, text: str) -> set[int]:
        out = {i for w in self.by.keys() & set(text.split(" ")) for i in self.by[w] if self.phrases[i] in text}
        if self.chars:
            return out | {self.rest[i] for i in self.chars.inside(text)}
        return out | {i for i in self.rest if self.phrases[i] in text}


def _finder(sent):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owners, phrases = sent.value
        search = WordPhrases(phrases)
        for b in batches:
            rows = [(i, q) for i, text in zip(b["passage_id"], b["text"]) for q in sorted({q for n in search.inside(for_search(text)) for q in owners[n]})]
            yield pd.DataFrame(rows, columns=["passage_id", "item_id"])

    return find


def relevant(passages: DataFrame, phrases: DataFrame, block: int = 50_000) -> DataFrame:
    """item_id, passage_id of passages(passage_id, text) that hold any of the phrases(item_id, phrase), both in their search form.

    Phrases are a query set: ``block`` of them at once are broadcast, in one structure, against all passages.  Blank phrases match nothing.
    """
    spark = passages.sparkSession
    kinds = passages.schema["passage_id"].dataType.simpleString(), phrases.schema["item_id"].dataType.simpleString()
    schema = f"passage_id {kinds[0]}, item_id {kinds[1]}"
    out = spark.createDataFrame([], schema)
    rows = phrases.where(F.trim("phrase") != "").select("item_id", "phrase").distinct().orderBy("item_id", "phrase").toLocalIterator()
    while some := list(itertools.islice(rows, block)):
        owners: dict[str, list] = {}
        for r in some:
            if form := for_search(r["phrase"]):
                owners.setdefault(form, []).append(r["item_id"])
        sent = spark.sparkContext.broadcast((list(owners.values()), list(owners)))
        out = out.unionByName(passages.where(F.col("text").isNotNull()).select("passage_id", "text").mapInPandas(_finder(sent), schema))
    return out.select("item_id", "passage_id").distinct()


def phrase_problems(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, phrase of questions(item_id, answer_phrases) that stand in no single passage."""
    phrases = questions.select("item_id", F.explode("answer_phrases").alias("phrase")).distinct()
    keyed = phrases.withColumn("key", F.to_json(F.struct("item_id", "phrase")))
    found = relevant(passages, keyed.select(F.col("key").alias("item_id"), "phrase")).select(F.col("item_id").alias("key")).distinct()
    return keyed.join(found, "key", "left_anti").select("item_id", "phrase")


def question_problems(questions: DataFrame) -> DataFrame:
    """item_id, problem of questions(item_id, kind, answer_phrases) that break a rule of question sets."""
    phrases = F.coalesce("answer_phrases", F.array().cast("array<string>"))
    bare = (F.size(phrases) == 0) | F.exists(phrases, lambda p: F.trim(F.coalesce(p, F.lit(""))) == "")
    rules = {"no phrases": (F.col("kind") == "answerable") & bare, "phrases of an absent question": (F.col("kind") == "absent") & (F.size(phrases) > 0), "id twice": F.col("n") > 1}
    q = questions.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    return q.select("item_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("problem")).distinct()


def first_relevant(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, found: rank of the first relevant hit of hits(query_id, rank, relevant), null for none."""
    return hits.groupBy(*by, "query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("found"))


def recall_at(ranks: DataFrame, ks: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """Share of queries found within each k; a null rank is a miss; mrr besides."""
    by = by or []
    aggs = [F.coalesce(F.avg(F.when(F.col("found") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), *aggs, F.coalesce(F.round(F.sum(1.0 / F.col("found")) / F.count("*"), 9), F.lit(0.0)).alias("mrr"))


def missed(questions: DataFrame, ranks: DataFrame) -> DataFrame:
    """query_id of the questions that no mode found: questions(query_id), ranks(query_id, found) with a row for each mode."""
    return questions.select("query_id").distinct().join(ranks.where("found is not null").select("query_id"), "query_id", "left_anti")


def _sums(scores: DataFrame) -> DataFrame:
    """Positives and all by distinct score, with the sums of the scores below and in all.

    The scores are split into ranges, summed by range, and a window sorts each range apart, so no task sorts all of them.
    """
    by = scores.where("score is not null").groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.count("*").alias("n"))
    parts = by.repartitionByRange("score").withColumn("part", F.spark_partition_id()).persist()
    total = parts.groupBy("part").agg(F.sum("pos").alias("part_pos"), F.sum("n").alias("part_n"), F.max("score").alias("part_top"))
    # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = total.select(
        "part", F.coalesce(F.sum("part_pos").over(before), F.lit(0)).alias("pos_before"), F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n_before"), F.max("part_top").over(before).alias("top_before"),
        F.sum("part_pos").over(everything).alias("all_pos"), F.sum("part_n").over(everything).alias("total"), F.max("part_top").over(everything).alias("top"),
    )
    w = Window.partitionBy("part").orderBy("score")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(total), "part").select(
        "score", "total", "all_pos", "top", F.coalesce(F.lag("score").over(w), F.col("top_before")).alias("prev"),
        (F.col("pos_before") + F.coalesce(F.sum("pos").over(upto), F.lit(0))).alias("pos_below"), (F.col("n_before") + F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("n_below"),
    )


def best_threshold(scores: DataFrame) -> DataFrame:
    """The cut of scores(score, positive) that separates best, the lower one of equals, with what it keeps and rejects.

    threshold, accuracy, kept, positives, rejected, negatives, keeps_everything, baseline; no row where one of the groups is empty.
    """
    d = _sums(scores)
    cut = F.when(F.col("prev").isNull(), F.col("score") - 1e-9).otherwise((F.col("prev") + F.col("score")) / 2)
    inner = d.select(cut.alias("threshold"), (F.col("all_pos") - F.col("pos_below")).alias("kept"), (F.col("n_below") - F.col("pos_below")).alias("rejected"), "all_pos", "total", F.col("prev").isNull().alias("keeps_everything"))
    above = d.where("score = top").select((F.col("top") + 1e-9).alias("threshold"), F.lit(0).cast("long").alias("kept"), (F.col("total") - F.col("all_pos")).alias("rejected"), "all_pos", "total", F.lit(False).alias("keeps_everything"))
    both = inner.unionByName(above).where("all_pos > 0 and all_pos < total").withColumn("accuracy", (F.col("kept") + F.col("rejected")) / F.col("total"))
    out = both.select("threshold", "accuracy", "kept", F.col("all_pos").alias("positives"), "rejected", (F.col("total") - F.col("all_pos")).alias("negatives"), "keeps_everything", (F.col("all_pos") / F.col("total")).alias("baseline"))
    return out.orderBy(F.desc(F.round("accuracy", 12)), "threshold").limit(1)


def score_range(scores: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("score"), F.lit(0.0))
    return scores.groupBy().agg(F.min(s).alias("lowest"), F.percentile(s, 0.5).alias("median"), F.max(s).alias("highest"))
