"""Beats of a narration: sentences, groups of them, their clock and the checks of its report."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BEATS, LEAST_WORDS, FALLBACK_WORDS = 8, 8, 25
TOLERANCE, NOTICEABLE, WORST, LEAST_WAIT = 0.05, 0.25, 1.0, 0.04
MOST_LINES = 6
_BREAK = re.compile(r"""[.!?]+["')’”]*\s+""")
_LABEL = re.compile(r"(?:step\s+)?\d+[.)]", re.IGNORECASE)


def sentences(text: str | None) -> list[str]:
    """Sentences; a number such as "Step 2." belongs to what follows, an ellipsis before a small letter ends none."""
    t = (text or "").strip()
    out: list[str] = []
    begin = 0
    for m in _BREAK.finditer(t):
        s, after = t[begin : m.end()].strip(), t[m.end() : m.end() + 1]
        if not (_LABEL.fullmatch(s) or s.endswith(("...", "…")) and after.islower()):
            out.append(s)
            begin = m.end()
    return [*out, rest] if (rest := t[begin:].strip()) else out


def words(text: str) -> int:
    return len(text.split())


def merge_short(beats: list[str], least: int = LEAST_WORDS) -> list[str]:
    """Beats of fewer words join the next one, the last one the one before, until none is short or one is left."""
    beats = list(beats)
    i = 0
    while len(beats) > 1 and i < len(beats):
        if words(beats[i]) >= least:
            i += 1
        elif i + 1 < len(beats):
            beats[i : i + 2] = [f"{beats[i]} {beats[i + 1]}"]
        else:
            beats[i - 1 :] = [f"{beats[i - 1]} {beats[i]}"]
            i -= 1
    return beats


def fallback(parts: list[str], least: int = FALLBACK_WORDS, most: int = MOST_BEATS) -> list[str]:
    """Sentences in groups of at least so many words, such that there are at most ``most``; a short rest joins the last group."""
    n = [words(p) for p in parts]
    target = max(least, math.ceil(sum(n) / most))
    groups: list[list[str]] = [[]]
    size = 0
    for p, k in zip(parts, n):
        groups[-1].append(p)
        size += k
        if size >= target:
            groups.append([])
            size = 0
    rest = groups.pop()
    if rest and groups and size < least:
        groups[-1] += rest
    elif rest:
        groups.append(rest)
    return [" ".join(g) for g in groups]


def _listed(f) -> object:
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x) if isinstance(x, str) else f(list(x)), na_action="ignore")

    return F.pandas_udf(each, "array<string>")


def story_sentences(text: Column) -> Column:
    return _listed(sentences)(text)


def merged_beats(beats: Column) -> Column:
    return _listed(merge_short)(beats)


def fallback_beats(text: Column, title: Column) -> Column:
    """Beats of a narration, or of the title where the narration is blank."""
    return _listed(lambda t: fallback(sentences(t)))(F.when(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") == "", title).otherwise(text))


def planned(parts: DataFrame, beats: DataFrame) -> DataFrame:
    """section, beat, text, visual: the sentences(section, i, sentence) that each of beats(section, beat, sentence_count, visual) covers.

    A storyboard counts only with one to eight beats of a sentence or more and a visual each, that cover all sentences; others give no row.
    """
    n = parts.groupBy("section").agg(F.count("*").alias("n"))
    ok = beats.groupBy("section").agg(F.count("*").alias("beats"), F.min("sentence_count").alias("least"), F.sum("sentence_count").alias("all"), F.min((F.trim(F.coalesce("visual", F.lit(""))) != "").cast("int")).alias("seen"))
    ok = ok.join(n, "section").where(F.col("beats").between(1, MOST_BEATS) & (F.col("least") >= 1) & (F.col("all") == F.col("n")) & (F.col("seen") == 1)).select("section")
    upto = F.sum("sentence_count").over(Window.partitionBy("section").orderBy("beat"))
    b = beats.join(ok, "section", "left_semi").withColumn("end", upto).withColumn("begin", F.col("end") - F.col("sentence_count"))
    # a beat lists the places of its sentences, so the join is by equal places
    b = b.select("section", "beat", F.trim("visual").alias("visual"), F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("i"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ")
    return b.join(parts, ["section", "i"]).groupBy("section", "beat", "visual").agg(text.alias("text"))


def beats_or_fallback(sections: DataFrame, parts: DataFrame, beats: DataFrame) -> DataFrame:
    """section, texts: a section's beats by its storyboard, short ones merged, or by groups of sentences where that doesn't count; sections(section, narration, title)."""
    by = planned(parts, beats).groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("beat", "text"))), lambda x: x["text"]).alias("told"))
    j = sections.join(by, "section", "left")
    return j.select("section", F.coalesce(merged_beats(F.col("told")), fallback_beats(F.when(F.col("told").isNull(), F.col("narration")), F.when(F.col("told").isNull(), F.col("title")))).alias("texts"))


def clock(beats: DataFrame) -> DataFrame:
    """section, report of beats(section, beat, duration, animation): each beat waits for its place in the schedule; a late one doesn't move the later ones.

    report: an array of beat, expected_end, actual_end, overrun in the order of the beats.
    """
    rows = F.array_sort(F.collect_list(F.struct("beat", F.col("duration").cast("double").alias("duration"), F.col("animation").cast("double").alias("animation"))))
    empty = F.array().cast("array<struct<beat:int,expected_end:double,actual_end:double,overrun:double>>")
    start = F.struct(F.lit(0.0).alias("expected"), F.lit(0.0).alias("actual"), empty.alias("report"))

    def step(s: Column, b: Column) -> Column:
        expected = s["expected"] + b["duration"]
        played = s["actual"] + b["animation"]
        actual = F.when(expected - played > LEAST_WAIT, expected).otherwise(played)
        entry = F.struct(b["beat"].cast("int").alias("beat"), F.round(expected, 3).alias("expected_end"), F.round(actual, 3).alias("actual_end"), F.round(F.greatest(F.lit(0.0), actual - expected), 3).alias("overrun"))
        return F.struct(expected.alias("expected"), actual.alias("actual"), F.concat(s["report"], F.array(entry)).alias("report"))

    return beats.groupBy("section").agg(rows.alias("rows")).select("section", F.aggregate("rows", start, step, lambda s: s["report"]).alias("report"))


def report_problem(rows: DataFrame, planned_beats: DataFrame) -> DataFrame:
    """section, problem, beat, worst of rows(section, beat, start, expected_end, overrun) against planned_beats(section, beat, duration).

    In this order: no report, another number of beats, a late start, another schedule, a beat that ends more than a second late; null for none.
    """
    total = F.sum("duration").over(Window.partitionBy("section").orderBy("beat"))
    plan = planned_beats.withColumn("total", total)
    counts = plan.groupBy("section").agg(F.count("*").alias("planned"))
    j = rows.join(plan.select("section", "beat", "total"), ["section", "beat"], "left")
    got = j.groupBy("section").agg(
        F.count("*").alias("n"), F.max("start").alias("start"), F.min(F.when(F.abs(F.col("expected_end") - F.col("total")) > TOLERANCE, F.col("beat"))).alias("off"), F.max("overrun").alias("worst"),
        F.max_by("beat", F.struct("overrun", -F.col("beat"))).alias("worst_beat"),
    )
    r = counts.join(got, "section", "left")
    problem = (
        F.when(F.col("n").isNull(), "no report").when(F.col("n") != F.col("planned"), "another number of beats").when(F.col("start") > TOLERANCE, "started late")
        .when(F.col("off").isNotNull(), "another schedule").when(F.col("worst") > WORST, "too long")
    )
    return r.select("section", problem.alias("problem"), F.when(problem == "another schedule", F.col("off")).when(problem == "too long", F.col("worst_beat")).alias("beat"), F.coalesce("worst", F.lit(0.0)).alias("worst"))


def issue_lines(issues: DataFrame) -> DataFrame:
    """section, line_no, line of issues(section, beat, position, issue): each issue once with its first and last beat, the first six, and how many more."""
    g = issues.groupBy("section", "issue").agg(F.min(F.struct("beat", "position")).alias("first"), F.count("*").alias("n"), F.min("beat").alias("low"), F.max("beat").alias("high"))
    w = Window.partitionBy("section")
    g = g.withColumn("line_no", F.row_number().over(w.orderBy("first", "issue"))).withColumn("all", F.count("*").over(w))
    where = F.when(F.col("n") == 1, F.concat(F.lit("Beat "), F.col("low").cast("string"))).otherwise(F.concat(F.lit("Beats "), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string")))
    shown = g.where(F.col("line_no") <= MOST_LINES).select("section", "line_no", F.concat(where, F.lit(": "), "issue").alias("line"))
    more = g.where((F.col("line_no") == MOST_LINES + 1)).select("section", "line_no", F.concat(F.lit("and "), (F.col("all") - MOST_LINES).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(more)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """section, attempt: of attempts(section, attempt, late, issues, overrun) the one that is not late, has fewest issues, overruns least; the earliest of equals."""
    return attempts.groupBy("section").agg(F.min_by("attempt", F.struct("late", "issues", "overrun", "attempt")).alias("attempt"))
