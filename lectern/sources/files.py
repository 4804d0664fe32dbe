"""Files in and out: PDF validation and hashing, manifests, question sets, videos, subtitles, artefacts and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import srt_time

QUESTIONS = "id string, kind string, category string, question string, answer_phrases array<string>, _corrupt string"
MANIFEST = "papers array<struct<key:string,sha256:string,url:string,local_path:string>>"
HEADER = "255044462D"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of the files below a folder whose name fits a pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def pdf_problem(path: Column, length: Column, content: Column, most_bytes: int = 50_000_000) -> Column:
    """Why a file is no PDF to take: its name, no bytes, too many, or no header within the first 1024."""
    head = F.hex(F.substring(content, 1, 1024))
    return F.when(~F.lower(path).endswith(".pdf"), "not a .pdf name").when(length == 0, "empty").when(length > most_bytes, "too large").when(~head.rlike(f"^(?:..)*{HEADER}"), "no PDF header")


def read_pdfs(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """path, length, sha256, problem of the files under a path; the source leaves files without bytes out."""
    return files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"), pdf_problem(F.col("path"), F.col("length"), F.col("content"), most_bytes).alias("problem"))


def wanted_pdfs(spark: SparkSession, asked: DataFrame, path: str) -> DataFrame:
    """asked(path) with what is known of the file: a path without a regular file below the folder is missing."""
    have = read_pdfs(spark, path)
    return asked.select("path").distinct().join(have, "path", "left").withColumn("problem", F.when(F.col("sha256").isNull(), "missing").otherwise(F.col("problem")))


def read_manifest(spark: SparkSession, manifest: str, folder: str, most_bytes: int = 30_000_000) -> DataFrame:
    """key, path, problem of the papers of a manifest, which are ``<key>/paper.pdf`` in a folder; those that aren't there yet have no path.

    Files must begin with the PDF header, be within the limit and, where the manifest pins one, have its hash.  Entries of a local
    path are used where they are and left out when missing.  Downloading is left to the caller.
    """
    papers = spark.read.schema(MANIFEST).option("multiLine", "true").json(manifest).select(F.explode("papers").alias("p")).select("p.*")
    have = files(spark, folder, "*.pdf").select("path", "length", F.sha2("content", 256).alias("sha"), F.hex(F.substring("content", 1, 5)).alias("head"))
    key = F.element_at(F.split("path", "/"), -2)
    stored = papers.where("local_path is null").join(have.withColumn("key", key), "key", "left")
    local = papers.where("local_path is not null").join(have, F.col("path").endswith(F.col("local_path")))
    problem = (
        F.when(F.col("path").isNull(), "not there yet").when(F.col("length") > most_bytes, "too large").when(F.col("head") != HEADER, "not a PDF")
        .when(F.col("sha256").isNotNull() & (F.lower("sha256") != F.col("sha")), "another hash")
    )
    return stored.select("key", "path", problem.alias("problem")).unionByName(local.select("key", "path", F.lit(None).cast("string").alias("problem")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their problem: unreadable line, phrases missing or not wanted."""
    q = spark.read.schema(QUESTIONS).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    phrases = F.size(F.filter(F.coalesce("answer_phrases", F.array().cast("array<string>")), lambda p: F.trim(p) != ""))
    return q.withColumn("problem", F.when(F.col("_corrupt").isNotNull(), "unreadable").when((F.col("kind") == "answerable") & (phrases == 0), "no phrase").when((F.col("kind") == "absent") & (phrases > 0), "phrase of an absent answer"))


def srt(cues: DataFrame) -> DataFrame:
    """section, srt: the subtitle file of cues(section, i, start_ms, end_ms, text)."""
    line = F.concat_ws("\n", (F.col("i") + 1).cast("string"), F.concat_ws(" --> ", srt_time(F.col("start_ms")), srt_time(F.col("end_ms"))), "text")
    return cues.select("section", F.struct("i", line.alias("line")).alias("x")).groupBy("section").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])).alias("srt"))


def videos(spark: SparkSession, root: str, owned: DataFrame | None = None, name: str = "lesson_demo.mp4") -> DataFrame:
    """id, title, url, created_at, size of the videos below a folder, of the owned(run_dir) runs if given; the latest has place 1."""
    from pyspark.sql import Window

    f = files(spark, root, name).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("created_at"))
    f = f.withColumn("id", F.regexp_replace("path", r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")).withColumn("run_dir", F.element_at(F.split("path", "/"), -2))
    if owned is not None:
        f = f.join(owned.select("run_dir").distinct(), "run_dir", "left_semi")
    title = F.initcap(F.translate("run_dir", "-_", "  "))
    return f.select("id", title.alias("title"), F.concat(F.lit("/media/"), "id").alias("url"), "created_at", "size").withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))


def boxes(content: bytes) -> Iterator[str]:
    """The kinds of the top-level boxes of an MP4 file, in order."""
    at, total = 0, len(content)
    while at + 8 <= total:
        size, kind, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
        size = size or total - at
        if size < 8:
            return
        yield kind.decode("latin-1")
        at += max(size, head if size < head else size)


def starts_fast(content: Column) -> Column:
    """Whether the index of an MP4 file comes before its media, or there is no media."""

    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda c: next((k == "moov" for k in boxes(bytes(c)) if k in ("moov", "mdat")), True), na_action="ignore")

    return F.pandas_udf(f, "boolean")(content)


def write_artefacts(runs: DataFrame, path: str) -> None:
    """Writes runs(run_id, ...) as JSON, a folder for each run; a failed run without a folder goes below ``_failed``."""
    folder = F.when(F.coalesce("run_dir", F.lit("")) == "", F.concat(F.lit("_failed/"), "run_id")).otherwise(F.col("run_dir")) if "run_dir" in runs.columns else F.col("run_id")
    runs.withColumn("folder", folder).write.mode("overwrite").partitionBy("folder").json(path)


def report(summaries: DataFrame, title: str = "Retrieval evaluation") -> str:
    """A markdown report of summaries(paper, mode, ...): a table for each paper.  There is a row for each paper and mode, so they come to the driver."""
    rows = summaries.orderBy("paper", "mode").collect()
    names = [c for c in summaries.columns if c != "paper"]
    lines = [f"# {title}", ""]
    for paper in dict.fromkeys(r["paper"] for r in rows):
        lines += [f"## {paper}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        lines += ["| " + " | ".join(f"{r[c]:.2f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |" for r in rows if r["paper"] == paper]
        lines.append("")
    return "\n".join(lines)


def call_log(calls: DataFrame) -> DataFrame:
    """run_id, log: a markdown log of calls(run_id, seq, label, prompt, output, error, duration_seconds), in order, each text in a fence that it can't close."""
    from lectern.functions.text import fence, table_cell

    part = lambda name, c: F.concat_ws("\n", F.lit(name), fence(c), c, fence(c))
    head = F.concat(F.lit("## "), F.col("seq").cast("string"), F.lit(". "), table_cell(F.col("label")))
    text = F.concat_ws("\n\n", head, part("Prompt", F.coalesce("prompt", F.lit(""))), part("Output", F.coalesce("output", F.lit(""))), F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), table_cell(F.col("error")))))
    return calls.select("run_id", F.struct("seq", "call_id", text.alias("text")).alias("x")).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["text"]), "\n\n").alias("log"))


def notes(json_text: Column) -> Column:
    """The strings of a JSON list; none for null, bad JSON or other things."""
    listed = F.from_json(json_text, "array<variant>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.array_compact(F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))), F.array().cast("array<string>"))
