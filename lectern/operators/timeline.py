"""Timelines of scripts: running times, subtitle cues, groups of steps, overlapping boxes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(durations: DataFrame, key: str, order: str) -> DataFrame:
    """Starts and ends of consecutive durations in milliseconds: key, order, start_ms, end_ms."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return durations.withColumn("end_ms", F.sum("ms").over(w)).select(key, order, (F.col("end_ms") - F.col("ms")).alias("start_ms"), "end_ms")


def cues(parts: DataFrame) -> DataFrame:
    """section, i, start_ms, end_ms of parts(section, i, chars, section_start_ms, section_ms): time in proportion to length, the last
    part takes what is left."""
    w = Window.partitionBy("section")
    total, upto = F.sum("chars").over(w), F.sum("chars").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max("i").over(w) == F.col("i")
    p = parts.withColumn("_end", F.when(last, F.col("section_ms")).otherwise(F.floor(F.col("section_ms") * upto / total)))
    p = p.withColumn("_start", F.coalesce(F.lag("_end").over(w.orderBy("i")), F.lit(0)))
    return p.select("section", "i", (F.col("section_start_ms") + F.col("_start")).cast("long").alias("start_ms"), (F.col("section_start_ms") + F.col("_end")).cast("long").alias("end_ms"))


def step_groups(steps: DataFrame, key: str, order: str) -> DataFrame:
    """A step that isn't grouped with the one before starts a group: key, order, grp."""
    w = Window.partitionBy(key).orderBy(order)
    return steps.select(key, order, F.sum((~F.col("with_previous")).cast("int")).over(w).cast("long").alias("grp"))


def narrated(steps: DataFrame, narrations: DataFrame) -> DataFrame:
    """section, segment, text, steps, fallback of steps(section, i, event) with narrations(section, grouped, sentences).

    A narration counts when it has a flag for each step, the first one off, and a sentence that isn't blank for each flag that is off;
    else, or where there is none, every step's event is a segment.
    """
    s = steps.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("i", "event"))).alias("x")).join(narrations, "section", "left")
    opens = F.size(F.filter("grouped", lambda g: ~g))
    ok = (F.size("grouped") == F.size("x")) & ~F.coalesce(F.get("grouped", 0), F.lit(False)) & (F.size("sentences") == opens) & F.forall("sentences", lambda t: F.trim(t) != "")
    s = s.withColumn("ok", F.coalesce(ok, F.lit(False)))
    flat = s.select("section", "ok", "sentences", F.posexplode(F.zip_with("x", F.when(F.col("ok"), F.col("grouped")).otherwise(F.array().cast("array<boolean>")), lambda x, g: F.struct(x["i"].alias("i"), x["event"].alias("event"), F.coalesce(g, F.lit(False)).alias("g")))).alias("n", "x"))
    segment = F.sum((~F.col("x.g")).cast("int")).over(Window.partitionBy("section").orderBy("n")) - 1
    text = F.when(F.col("ok"), F.trim(F.get("sentences", F.col("segment").cast("int")))).otherwise(F.col("x.event"))
    f = flat.withColumn("segment", segment).withColumn("text", text)
    return f.groupBy("section", "segment").agg(F.min_by("text", "n").alias("text"), F.array_sort(F.collect_list("x.i")).alias("steps"), F.first(~F.col("ok")).alias("fallback"))


def overlaps(boxes: DataFrame, share: float = 0.10) -> DataFrame:
    """frame, a, b of boxes(frame, id, x0, y0, x1, y1) that overlap by more than a share of the smaller one."""
    a, b = boxes.alias("a"), boxes.alias("b")
    j = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1")))
    side = lambda k: F.least(f"a.{k}1", f"b.{k}1") - F.greatest(f"a.{k}0", f"b.{k}0")
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    return j.where(side("x") * side("y") > share * F.least(area("a"), area("b"))).select(F.col("a.frame").alias("frame"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def wrap(text: str, width: int = 72) -> list[str]:
    """Greedy lines of at most ``width`` characters; a longer word stays whole."""
    out: list[str] = []
    for w in (text or "").split():
        if out and len(out[-1]) + 1 + len(w) <= width:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def subtitle_lines(text: Column, width: int = 72) -> Column:
    """The lines of each sentence of a text, wrapped."""

    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [x for part in re.split(r"(?<=[.!?])\s+", t.strip()) for x in wrap(part, width)], na_action="ignore")

    return F.pandas_udf(f, "array<string>")(text)


def estimated_seconds(size: Column) -> Column:
    """How long an audio file of so many bytes is about, when it can't be measured."""
    return F.greatest(F.lit(1.0), F.round(size / 2000.0, 2))


def clip_fit(actual: Column, target: Column, most: float = 1.15) -> Column:
    """How a clip is made to fit: padded, played faster by at most ``most``, or left as it is, as ``pad x`` or ``speed x``."""
    factor = F.greatest(target / actual, F.lit(1 / most))
    return F.when(actual <= target, F.concat(F.lit("pad "), F.format_string("%.3f", target - actual))).otherwise(F.concat(F.lit("speed "), F.format_string("%.6f", factor)))


def step_seconds(audio: Column, steps: Column, each: float = 0.6) -> Column:
    """The first step takes what the others, of equal length, leave, and a second at least."""
    return F.concat(F.array(F.greatest(F.lit(1.0), F.round(audio - steps * each, 3))), F.array_repeat(F.lit(each), steps))


def size_label(size: Column) -> Column:
    """MB with one decimal, or whole KB, at least one."""
    mb = F.concat(F.format_string("%.1f", size / 1_000_000.0), F.lit(" MB"))
    return F.when(size >= 1_000_000, mb).otherwise(F.concat(F.greatest(F.lit(1), F.ceil(size / 1000.0)).cast("long"), F.lit(" KB")))
