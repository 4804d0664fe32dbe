"""Outlines and scripts: coverage of what must be said, accepted rewrites, notes, prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

WORDS_PER_MINUTE, LEAST_LENGTH, LEAST_REWRITE, MOST_FACTS = 130, 0.70, 0.80, 15
MARKER = "Background:"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def unmentioned(items: DataFrame, texts: DataFrame) -> DataFrame:
    """key, item of items(key, item) that texts(key, text) name in no variant: small letters, with an s, without one."""
    return items.where(~_blank(F.col("item"))).join(texts, "key").where(~T.mentions(F.coalesce("text", F.lit("")), F.col("item"))).select("key", "item")


def uncovered(items: DataFrame, plans: DataFrame) -> DataFrame:
    """key, item of items(key, item) that stand neither in the titles nor in the terms of plans(key, titles, terms)."""
    text = F.lower(F.array_join(F.concat(F.coalesce("titles", F.array().cast("array<string>")), F.coalesce("terms", F.array().cast("array<string>"))), " "))
    return items.where(~_blank(F.col("item"))).join(plans, "key").where(~F.contains(text, F.lower("item"))).select("key", "item")


def reviewed(found: DataFrame, missing: DataFrame) -> DataFrame:
    """key, term, reason: found(key, term, reason) and the missing(key, item) that it doesn't name, case aside."""
    low = found.select("key", F.lower(F.trim("term")).alias("low")).distinct()
    more = missing.withColumn("low", F.lower(F.trim("item"))).join(low, ["key", "low"], "left_anti")
    return found.select("key", "term", "reason").unionByName(more.select("key", F.col("item").alias("term"), F.lit("never mentioned").alias("reason")))


def remaining(accepted: Column, named: Column, missing: Column) -> Column:
    """What a review still has to report: after an accepted rewrite what is missing, else the named terms and what else is missing."""
    low = F.transform(named, lambda x: F.lower(x))
    return F.when(accepted | (F.size(named) == 0), missing).otherwise(F.concat(named, F.filter(missing, lambda x: ~F.array_contains(low, F.lower(x)))))


def rewrite_accepted(titles: Column, words: Column, new_titles: Column, new_narrations: Column, new_words: Column) -> Column:
    """A rewrite keeps the outline, empties no section, and has four fifths of the words."""
    return titles.eqNullSafe(new_titles) & ~F.exists(new_narrations, lambda x: _blank(x)) & (new_words >= LEAST_REWRITE * words)


def too_short(words: Column, minutes: Column) -> Column:
    return words < LEAST_LENGTH * minutes * WORDS_PER_MINUTE


def retry_accepted(titles: Column, words: Column, new_titles: Column, new_words: Column) -> Column:
    """A longer attempt counts when it has the same titles and more words."""
    return titles.eqNullSafe(new_titles) & (new_words > words)


def better_script(failed: Column, rewritten_failed: Column) -> Column:
    """Which script loses less: the rewrite when it fails no more than the first."""
    return F.when(rewritten_failed <= failed, "rewrite").otherwise("first")


def tidy_notes(titles: Column, notes: Column) -> Column:
    """Notes(title, note) with the titles of the sections; none unless there is one for each."""
    kept = F.zip_with(notes, titles, lambda n, t: F.struct(t.alias("title"), n["note"].alias("note")))
    return F.when(F.size(notes) == F.size(titles), kept).otherwise(F.slice(kept, 1, 0))


def with_background(narration: Column, background: Column) -> Column:
    """The narration after the marked background, where there is one."""
    return F.when(_blank(background), narration).otherwise(F.concat_ws(" ", F.lit(MARKER), F.trim(background), narration))


def removed_note(count: Column) -> Column:
    one = count == 1
    return F.when(count > 0, F.concat(count.cast("string"), F.when(one, " sentence the paper did not support was removed.").otherwise(" sentences the paper did not support were removed.")))


def quality_warnings(gaps: Column, conflicts: Column) -> Column:
    """Gaps(question, reason) first, then conflicts."""
    g = F.transform(gaps, lambda x: F.concat(F.lit("Knowledge gap: "), x["question"], F.lit(" ("), x["reason"], F.lit(")")))
    return F.concat(g, F.transform(F.coalesce(conflicts, F.array().cast("array<string>")), lambda x: F.concat(F.lit("Conflicting information flagged: "), x)))


def notes_text(number: Column, title: Column, purpose: Column, terms: Column, example: Column) -> Column:
    """One line of a section's notes for a prompt."""
    return F.concat_ws(
        " | ", F.concat(number.cast("string"), F.lit(". "), title), F.concat(F.lit("purpose: "), purpose), F.when(F.size(terms) > 0, F.concat(F.lit("define: "), F.array_join(terms, ", "))),
        F.when(~_blank(example), F.concat(F.lit("example: "), example)),
    )


def facts_text(concepts: Column, facts: Column) -> Column:
    """Lines of concepts and of the first facts; null when there is neither."""
    lines = F.concat(
        F.when(F.size(concepts) > 0, F.array(F.concat(F.lit("Key concepts: "), F.array_join(concepts, ", ")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(facts, 1, MOST_FACTS), lambda x: F.concat(F.lit("- "), x)),
    )
    return F.when((F.size(concepts) > 0) | (F.size(facts) > 0), F.array_join(lines, "\n"))


def label_path(labels: Column) -> Column:
    """Nested labels from the outside in, joined; ``unlabelled`` without any."""
    return F.coalesce(F.nullif(F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " · "), F.lit("")), F.lit("unlabelled"))


def render_sections(parts: DataFrame) -> DataFrame:
    """lesson, i, title, text of parts(lesson, place, part_name, title, text): introduction and conclusion count only with text, and the rest is numbered anew."""
    from pyspark.sql import Window

    kept = parts.where((F.col("part_name") == "section") | ~_blank(F.col("text")))
    return kept.withColumn("i", (F.row_number().over(Window.partitionBy("lesson").orderBy("place")) - 1).cast("int")).select("lesson", "i", "title", "text")


def resolved_route(path: Column, tracer: Column, values: Column, target: Column, known: dict[str, bool]) -> Column:
    """struct(path, tracer, target, warning) of a section's route: ``known`` tracers and whether they seek a target.

    An unknown tracer, missing values or unsorted values of a binary search fall back to generated code.  A target that is missing is
    taken from two thirds into the values.
    """
    seeks = tracer.isin(*(k for k, v in known.items() if v))
    aim = F.coalesce(target, F.when(seeks & (F.size(values) > 0), F.get(values, F.floor(F.size(values) * 2 / 3).cast("int"))))
    warning = (
        F.when(path == "codegen", None).when(~F.coalesce(tracer.isin(*known), F.lit(False)), "unknown tracer").when(F.coalesce(F.size(values), F.lit(0)) <= 0, "no values")
        .when((tracer == "binary_search") & (values != F.array_sort(values)), "values not sorted").when(seeks & aim.isNull(), "no target")
    )
    trace = (path != "codegen") & warning.isNull()
    return F.struct(F.when(trace, "trace").otherwise("codegen").alias("path"), F.when(trace, tracer).alias("tracer"), F.when(trace & seeks, aim).alias("target"), warning.alias("warning"))


def routed(sections: DataFrame, routes: DataFrame) -> DataFrame:
    """lesson, i, path of sections(lesson, i) by their routes(lesson, i, path); where the routes aren't one for each section, all are generated."""
    want = sections.groupBy("lesson").agg(F.array_sort(F.collect_list("i")).alias("want"))
    have = routes.groupBy("lesson").agg(F.array_sort(F.collect_list("i")).alias("have"))
    whole = want.join(have, "lesson").where("want = have").select("lesson", F.lit(True).alias("whole"))
    return sections.join(whole, "lesson", "left").join(routes, ["lesson", "i"], "left").select("lesson", "i", F.when(F.col("whole"), F.col("path")).otherwise("codegen").alias("path"))


def outcome(attempts: DataFrame) -> DataFrame:
    """section, path, warnings of attempts(section, path, ok): the first of trace, codegen, slideshow that went well, and those that failed before."""
    order = F.when(F.col("path") == "trace", 0).when(F.col("path") == "codegen", 1).otherwise(2)
    a = attempts.withColumn("o", order).groupBy("section").agg(F.min(F.when(F.col("ok"), F.col("o"))).alias("best"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.struct("o", "path")))).alias("failed"))
    best = F.coalesce("best", F.lit(2))
    return a.select("section", F.element_at(F.array(*map(F.lit, ("trace", "codegen", "slideshow"))), best + 1).alias("path"), F.transform(F.filter("failed", lambda x: x["o"] < best), lambda x: x["path"]).alias("warnings"))
