"""Latest states, legal transitions, claims, call logs and the windowed limiter, from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in their order.
STAGES = ("queued", "parsing", "chunking", "storing", "embedding", "ready")


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def illegal(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Steps of events(key, status) that skip a stage or leave a final one."""
    w = Window.partitionBy(key).orderBy(*order)
    after = {a: [b, "failed"] for a, b in zip(STAGES, STAGES[1:])} | {"failed": ["queued", "embedding"]}
    ok = F.lit(False)
    for a, bs in after.items():
        ok = ok | (F.col("prev") == a) & F.col("status").isin(*bs)
    return events.withColumn("prev", F.lag("status").over(w)).where(F.col("prev").isNotNull() & ~ok)


def labelled(calls: DataFrame) -> DataFrame:
    """call_id, shown: the nth call of one label in a run is ``label #n``."""
    w = Window.partitionBy("run_id", "label").orderBy("seq", "call_id")
    n = F.row_number().over(w)
    return calls.select("call_id", F.when(n == 1, F.col("label")).otherwise(F.concat_ws(" #", "label", n.cast("string"))).alias("shown"))


def totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.round(F.sum(F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))), 3).alias("seconds"))


def limiter_windows(attempts: DataFrame, most: int, seconds: int) -> DataFrame:
    """Attempts(key, id, ts) that are at least the ``most``-th within the last ``seconds``, the boundary left out."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return attempts.withColumn("us", us).withColumn("n", F.count("*").over(w)).where(F.col("n") >= most).select("key", "id", "n")


def claims(events: DataFrame) -> DataFrame:
    """paper, event_id of events(paper, event_id, ts, kind) that win a retry: the first claim after a failure; later ones find nothing to claim."""
    w = Window.partitionBy("paper").orderBy("ts", "event_id")
    last_failure = F.max(F.when(F.col("kind") == "failed", F.struct("ts", "event_id"))).over(w)
    c = events.withColumn("failure", last_failure).where((F.col("kind") == "claim") & F.col("failure").isNotNull())
    first = Window.partitionBy("paper", "failure").orderBy("ts", "event_id")
    return c.withColumn("n", F.row_number().over(first)).where("n = 1").select("paper", "event_id")


def failed_in_progress(papers: DataFrame) -> DataFrame:
    """papers(paper, status) after a restart: what was in progress has failed."""
    return papers.withColumn("status", F.when(F.col("status").isin(*STAGES[:-1]), F.lit("failed")).otherwise(F.col("status")))


def patched(rows: DataFrame, changes: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """rows with the fields that changes(key, ts, field, value) may set, each at its latest change, and updated_at at the last one.

    Fields that aren't named in ``fields`` are ignored; a null value clears a field.
    """
    known = changes.where(F.col("field").isin(*fields))
    latest_of = lambda f: F.max(F.when(F.col("field") == f, F.struct("ts", F.struct("value").alias("v")))).alias(f"_{f}")
    c = known.groupBy(key).agg(F.max("ts").alias("_at"), *(latest_of(f) for f in fields))
    out = rows.join(c, key, "left")
    keep = [F.col(x) for x in rows.columns if x not in fields and x != "updated_at"]
    new = [F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v.value")).otherwise(F.col(f)).alias(f) for f in fields]
    return out.select(*keep, *new, F.greatest(F.col("updated_at"), F.col("_at")).alias("updated_at"))


def job_stages(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """job, stage, state of events(job, ts, event_id, kind, stage), kind being ``enter``, ``complete`` or ``fail``.

    Entering a stage closes the earlier ones that are open; stages entered before stay as they are.  Completing closes all, failing
    fails the current ones.  Unknown stages are ignored.  All of it follows from the order of the last entries.
    """
    known = F.create_map(*(x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))))
    e = events.withColumn("at", F.struct("ts", "event_id")).withColumn("no", F.try_element_at(known, F.col("stage"))).where((F.col("kind") != "enter") | F.col("no").isNotNull())
    jobs = e.groupBy("job").agg(F.max(F.when(F.col("kind") == "complete", F.col("at"))).alias("completed"), F.max(F.when(F.col("kind") == "fail", F.col("at"))).alias("failed"), F.collect_set(F.when(F.col("kind") == "enter", F.struct("no", "at"))).alias("entered"))
    j = jobs.select("job", "completed", "failed", "entered", F.posexplode(F.array(*map(F.lit, stages))).alias("no", "stage"))
    own = F.array_max(F.transform(F.filter("entered", lambda x: x["no"] == F.col("no")), lambda x: x["at"]))
    later = F.array_max(F.transform(F.filter("entered", lambda x: x["no"] > F.col("no")), lambda x: x["at"]))
    j = j.withColumn("own", own).withColumn("later", later)
    current = F.col("own").isNotNull() & (F.col("later").isNull() | (F.col("own") > F.col("later")))
    closed = F.col("later").isNotNull() & ~current
    state = F.when(closed, "done").when(current, F.when(F.col("failed") > F.col("own"), "failed").when(F.col("completed") > F.col("own"), "done").otherwise("current")).otherwise(F.when(F.col("completed").isNotNull(), "done").otherwise("pending"))
    return j.select("job", "stage", state.alias("state"))


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """token_hash, user_id of sessions(token, user_id, created_at, revoked_at) that are neither over nor revoked, of users that exist."""
    ends = F.col("created_at") + F.make_dt_interval(days=F.lit(days))
    return sessions.where((ends > now) & F.col("revoked_at").isNull()).join(users.select("user_id").distinct(), "user_id", "left_semi").select(F.sha2("token", 256).alias("token_hash"), "user_id")


def retry(status: Column, has_document: Column, claimed: Column) -> Column:
    """What a retry of a paper leads to."""
    return F.when(status != "failed", "only a failed paper can be retried").when(~claimed, "another retry was faster").when(has_document, "embedding").otherwise("queued")


def upload(existing_status: Column, has_document: Column) -> Column:
    """What an upload of a file leads to: a new paper, a new attempt of one that could not be read, or what is there."""
    return F.when(existing_status.isNull(), "created").when((existing_status == "failed") & ~F.coalesce(has_document, F.lit(False)), "requeued").otherwise("already exists")


def can_retry(status: Column, document: Column) -> Column:
    """Whether a paper that failed still has what it takes to go on."""
    return (status == "failed") & document.isNotNull()


def by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """users(user_id, email) of the given emails(email), case and blanks around them aside."""
    key = F.lower(F.trim("email"))
    return users.withColumn("key", key).join(emails.select(key.alias("key")).distinct(), "key", "left_semi").drop("key")


def lesson_minutes(level: Column) -> Column:
    """A weakly covered topic gets a short lesson."""
    return F.when(level == "weak", 2).otherwise(4)
