"""Registered queries over states, logs and small results of a run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import script, state, store, timeline
from lectern.plans.base import QUERIES, SQL, query  # noqa: F401
from lectern.sources import files
from lectern.streaming import limiter

_HEADER = "case event_id % 5 when 0 then 'bytes=' || (event_id % 1300) || '-' when 1 then 'bytes=-' || (event_id % 1200) when 2 then 'bytes=' || (event_id % 1300) || '-' || (event_id % 1500) when 3 then 'bytes=a-b' else 'items=0-1' end"


@query(rf"""with r as (select event_id, {_HEADER} as header, 1000 as size from events),
    p as (select *, try_cast(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 1) as bigint) as a, try_cast(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 2) as bigint) as b, regexp_matches(header, '^bytes=(\d+-\d*|-\d+)$') as ok from r),
    s as (select *, case when a is null then greatest(size - b, 0) else a end as s, case when a is null or b is null then size - 1 else least(b, size - 1) end as e from p)
    select event_id, case when not ok then null when a is null and b = 0 or s >= size or s > e then -1 else s end::bigint as start_byte, case when not ok then null when a is null and b = 0 or s >= size or s > e then -1 else e end::bigint as end_byte from s""")
def byte_range(t):
    r = t.events.select("event_id", T.byte_range(F.expr(_HEADER), F.lit(1000)).alias("r"))
    return r.select("event_id", F.col("r.start").cast("long").alias("start_byte"), F.col("r.end").cast("long").alias("end_byte"))


@query(rf"""with r as (select event_id, {_HEADER} as header, 1000 as size, user_id % 3 = 0 as own, event_id % 17 <> 0 as there from events),
    p as (select *, try_cast(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 1) as bigint) as a, try_cast(regexp_extract(header, '^bytes=(\d*)-(\d*)$', 2) as bigint) as b, regexp_matches(header, '^bytes=(\d+-\d*|-\d+)$') as ok from r),
    s as (select *, case when a is null then greatest(size - b, 0) else a end as s, case when a is null or b is null then size - 1 else least(b, size - 1) end as e from p)
    select event_id, case when not own or not there then 404 when not ok then 200 when a is null and b = 0 or s >= size or s > e then 416 else 206 end as status from s""")
def media_status(t):
    """Who doesn't own a file hears the same as when there is none."""
    r = t.events.select("event_id", (F.col("user_id") % 3 == 0).alias("own"), (F.col("event_id") % 17 != 0).alias("there"), T.byte_range(F.expr(_HEADER), F.lit(1000)).alias("r"))
    return r.select("event_id", F.when(~F.col("own") | ~F.col("there"), 404).when(F.col("r").isNull(), 200).when(F.col("r.start") < 0, 416).otherwise(206).alias("status"))


_KIND = "case event_type when 'error' then 'failed' when 'click' then 'claim' else event_type end"


@query(f"""with e as (select user_id as paper, event_id, ts, {_KIND} as kind from events), f as (select *, max(case when kind = 'failed' then (ts, event_id) end) over (partition by paper order by ts, event_id rows unbounded preceding) as failure from e)
    select paper, event_id from f where kind = 'claim' and failure is not null qualify row_number() over (partition by paper, failure order by ts, event_id) = 1""")
def retry_claims(t):
    return state.claims(t.events.select(F.col("user_id").alias("paper"), "event_id", "ts", F.expr(_KIND).alias("kind")))


_LATEST = "(select user_id as paper, arg_max(case event_type when 'signup' then 'queued' when 'view' then 'parsing' when 'click' then 'chunking' when 'purchase' then 'ready' else 'failed' end, (ts, event_id)) as status from events group by user_id)"


@query(f"select paper, case when status in ('queued', 'parsing', 'chunking', 'storing', 'embedding') then 'failed' else status end as status from {_LATEST}")
def restart_recovery(t):
    status = F.expr("case event_type when 'signup' then 'queued' when 'view' then 'parsing' when 'click' then 'chunking' when 'purchase' then 'ready' else 'failed' end")
    return state.failed_in_progress(state.latest(t.events.select(F.col("user_id").alias("paper"), "ts", "event_id", status.alias("status")), "paper", ["ts", "event_id"], "status"))


@query("""with c as (select user_id as paper, ts, event_id, case event_type when 'view' then 'detail' when 'click' then 'status' else 'other' end as field, case when event_id % 5 = 0 then null else event_type || event_id end as value from events),
    p as (select paper, ts, field, value from c qualify row_number() over (partition by paper, field, ts order by event_id desc) = 1), l as (select paper, field, arg_max(coalesce(value, chr(1)), ts) as value, max(ts) as at from p where field in ('detail', 'status') group by all),
    r as (select distinct user_id as paper from events)
    select r.paper, case when d.value is null then 'none' when d.value = chr(1) then null else d.value end as detail, case when s.value is null then 'queued' when s.value = chr(1) then null else s.value end as status,
    greatest(d.at, s.at) as updated_at from r left join l d on d.paper = r.paper and d.field = 'detail' left join l s on s.paper = r.paper and s.field = 'status'""")
def partial_updates(t):
    e = t.events.select(F.col("user_id").alias("paper"), "ts", "event_id", F.expr("case event_type when 'view' then 'detail' when 'click' then 'status' else 'other' end").alias("field"), F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.col("event_id").cast("string"))).alias("value"))
    w = Window.partitionBy("paper", "field", "ts").orderBy(F.desc("event_id"))
    changes = e.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "event_id")
    rows = t.events.select(F.col("user_id").alias("paper"), F.lit("none").alias("detail"), F.lit("queued").alias("status"), F.lit(None).cast("timestamp_ntz").alias("updated_at")).distinct()
    return state.patched(rows, changes, "paper", ("detail", "status"))


#: The stages of a job in their order.
STAGES = ("analyze", "knowledge", "plan", "script", "check", "route", "animate", "assemble")
_STAGE = "(['" + "', '".join(STAGES) + "'])"


@query(f"""with e as (select user_id as job, ts, event_id, case when event_type = 'purchase' and event_id % 3 = 0 then 'complete' when event_type = 'error' then 'fail' else 'enter' end as kind, case when event_id % 29 = 0 then 'other' else {_STAGE}[1 + event_id % 8] end as stage from events),
    n as (select *, list_position({_STAGE}, stage) as no from e where kind <> 'enter' or list_position({_STAGE}, stage) is not null),
    j as (select job, max((ts, event_id)) filter (where kind = 'complete') as completed, max((ts, event_id)) filter (where kind = 'fail') as failed from n group by job),
    s as (select j.*, k as no, {_STAGE}[k] as stage from j, (select unnest(range(1, 9)) as k)),
    o as (select s.job, s.no, max((n.ts, n.event_id)) filter (where n.no = s.no) as own, max((n.ts, n.event_id)) filter (where n.no > s.no) as later from s left join n on n.job = s.job and n.kind = 'enter' group by all)
    select s.job, s.stage, case when own is not null and (later is null or own > later) then case when failed > own then 'failed' when completed > own then 'done' else 'current' end
    when later is not null then 'done' when completed is not null then 'done' else 'pending' end as state from s join o using (job, no)""")
def job_stages(t):
    i = F.col("event_id")
    kind = F.when((F.col("event_type") == "purchase") & (i % 3 == 0), "complete").when(F.col("event_type") == "error", "fail").otherwise("enter")
    stage = F.when(i % 29 == 0, "other").otherwise(F.get(F.array(*map(F.lit, STAGES)), (i % 8).cast("int")))
    return state.job_stages(t.events.select(F.col("user_id").alias("job"), "ts", "event_id", kind.alias("kind"), stage.alias("stage")), STAGES)


_NOW = "(select max(ts) from events)"


@query(f"""select sha256('t' || event_id) as token_hash, e.user_id from events e join (select distinct user_id from events where event_type = 'signup') u using (user_id)
    where event_type = 'view' and ts + interval 14 day > {_NOW} and event_id % 7 <> 0""")
def live_sessions(t):
    v = t.events.where("event_type = 'view'")
    now = t.events.agg(F.max("ts").alias("now"))
    s = v.join(F.broadcast(now)).select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), "user_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("revoked_at"), "now")
    return state.live_sessions(s, t.events.where("event_type = 'signup'").select("user_id"), F.col("now"))


@query("""select distinct call_id, case when error is null then 'only a failed paper can be retried' when call_id % 3 = 0 then 'another retry was faster' when call_id % 2 = 0 then 'embedding' else 'queued' end as outcome,
    case when error is null then 'created' when call_id % 3 = 0 and call_id % 2 <> 0 then 'requeued' else 'already exists' end as upload from llm_calls""")
def retry_outcomes(t):
    i, failed = F.col("call_id"), F.col("error").isNotNull()
    r = state.retry(F.when(failed, "failed").otherwise("ready"), i % 2 == 0, i % 3 != 0)
    u = state.upload(F.when(failed, F.when(i % 3 == 0, "failed").otherwise("ready")), i % 2 == 0)
    return t.llm_calls.select("call_id", r.alias("outcome"), u.alias("upload")).distinct()


@query()
def limiter_refusals(t):
    """The limiter as a batch: failures and successes of each user in order, attempts while locked not counted."""
    a = t.events.where("event_type in ('error', 'purchase')").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "purchase").alias("ok"))
    return limiter.replay(a, 3, 72 * 3600).where("refused")


@query("""select distinct call_id, greatest(1.0, round(length(coalesce(output, '')) / 2000.0::double, 2)) as seconds, round(coalesce(case when duration_seconds > 0 then duration_seconds end, greatest(1.0, round(length(coalesce(output, '')) / 2000.0::double, 2))), 6) as used from llm_calls""")
def audio_seconds(t):
    e = timeline.estimated_seconds(F.length(F.coalesce("output", F.lit(""))))
    return t.llm_calls.select("call_id", e.alias("seconds"), F.round(F.coalesce(F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")), e), 6).alias("used")).distinct()


@query("""select run_id, round(sum(d), 3) as seconds, count(*) as clips from (select distinct call_id, run_id, coalesce(duration_seconds, 0) as d from llm_calls) group by run_id""")
def section_summaries(t):
    return t.llm_calls.select("call_id", "run_id", F.coalesce("duration_seconds", F.lit(0.0)).alias("d")).distinct().groupBy("run_id").agg(F.round(F.sum("d"), 3).alias("seconds"), F.count("*").alias("clips"))


@query("""select section_id, len(section_seconds)::int as steps, round(section_seconds[1], 3) as first from (select section_id, list_concat([greatest(1.0, round(n / 15.0::double - k * 0.6, 3))], list_transform(range(0, k), lambda x: 0.6::double)) as section_seconds
    from (select section_id, length(coalesce(narration, '')) as n, coalesce(section_index, 0) + 1 as k from script_sections))""")
def step_durations(t):
    s = timeline.step_seconds(F.length(F.coalesce("narration", F.lit(""))) / 15.0, F.coalesce("section_index", F.lit(0)) + 1)
    return t.script_sections.select("section_id", F.size(s).alias("steps"), F.round(F.get(s, 0), 3).alias("first"))


@query("""select distinct call_id, case when label = '' then 'unlabelled' else concat_ws(' · ', kind, label) end as path from llm_calls""")
def label_paths(t):
    labels = F.when(F.col("label") != "", F.array("kind", "label"))
    return t.llm_calls.select("call_id", script.label_path(labels).alias("path")).distinct()


@query(r"""select distinct call_id, regexp_replace(error, '^[A-Za-z]+:\s*', '') as shown, contains(lower(coalesce(output, '')), 'cannot') as refused from llm_calls""")
def failure_texts(t):
    return t.llm_calls.select("call_id", F.regexp_replace("error", r"^[A-Za-z]+:\s*", "").alias("shown"), F.contains(F.lower(F.coalesce("output", F.lit(""))), F.lit("cannot")).alias("refused")).distinct()


@query("""with n as (select distinct call_id, output from llm_calls)
    select call_id, case when json_valid(output) and json_type(output) = 'ARRAY' then len(list_filter(json_transform(output, '["JSON"]'), lambda x: json_type(x) = 'VARCHAR')) else 0 end::int as notes from n""")
def saved_notes(t):
    return t.llm_calls.select("call_id", F.size(files.notes(F.col("output"))).alias("notes")).distinct()


@query("""select d.document_id, case when u like 'postgres://%' then 'postgresql+psycopg://' || substr(u, 12) when u like 'postgresql://%' then 'postgresql+psycopg://' || substr(u, 14) when u like 'postgresql+psycopg2://%' then 'postgresql+psycopg://' || substr(u, 23)
    when u like 'postgresql+psycopg://%' then u end as url from (select document_id, case when document_id < '4' then 'postgres' when document_id < '8' then 'postgresql' when document_id < 'a' then 'postgresql+psycopg2' when document_id < 'd' then 'postgresql+psycopg' else 'mysql' end || '://h/' || document_id as u from rag_documents) d""")
def database_urls(t):
    i = F.col("document_id")
    scheme = F.when(i < "4", "postgres").when(i < "8", "postgresql").when(i < "a", "postgresql+psycopg2").when(i < "d", "postgresql+psycopg").otherwise("mysql")
    return t.rag_documents.select("document_id", T.database_url(F.concat(scheme, F.lit("://h/"), i)).alias("url"))


@query("""select document_id, case when source_asset_key like 'objects/%' then '/media/' || substr(source_asset_key, 9) end as url from rag_documents""")
def media_urls(t):
    return t.rag_documents.select("document_id", T.media_url(F.col("source_asset_key"), "objects").alias("url"))


@query("""select document_id, user_id in (select user_id from rag_documents where title is null) as owned from rag_documents""")
def owned_runs(t):
    owned = t.rag_documents.where("title is null").select("user_id").distinct().withColumn("owned", F.lit(True))
    return t.rag_documents.join(owned, "user_id", "left").select("document_id", F.coalesce("owned", F.lit(False)).alias("owned"))


@query("""select user_id, source_sha256, document_id from rag_documents where user_id || source_sha256 in (select user_id || source_sha256 from rag_documents where title is not null) qualify row_number() over (partition by user_id, source_sha256 order by created_at, document_id) = 1""")
def insert_races(t):
    """Of one user's copies of a file the first that was stored stays."""
    titled = t.rag_documents.where("title is not null").select("user_id", "source_sha256").distinct()
    w = Window.partitionBy("user_id", "source_sha256").orderBy("created_at", "document_id")
    return t.rag_documents.join(titled, ["user_id", "source_sha256"], "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "source_sha256", "document_id")


@query("""with s as (select section_id, run_id, coalesce(len(evidence_ids), 0) as n, row_number() over (partition by run_id order by section_id) as k from script_sections), c as (select run_id, call_id, row_number() over (partition by run_id order by seq, call_id) as k from (select distinct run_id, call_id, seq from llm_calls))
    select section_id, call_id from s join c using (run_id, k)""")
def zipped_calls(t):
    """Sections and calls of a run side by side, as far as both go."""
    return store.zipped(t.script_sections.select("run_id", "section_id"), t.llm_calls.select("run_id", "call_id", "seq").distinct(), ["run_id"], ["section_id"], ["seq", "call_id"]).select("section_id", "call_id")


@query("""select document_id, page_count is null and title is not null as can_retry from rag_documents""")
def retry_flags(t):
    status = F.when(F.col("page_count").isNull(), "failed").otherwise("ready")
    return t.rag_documents.select("document_id", state.can_retry(status, F.col("title")).alias("can_retry"))


@query("""select document_id, lower(trim(user_id)) in (select lower(trim(' ' || upper(user_id) || ' ')) from rag_documents where title is null) as known from rag_documents""")
def users_by_email(t):
    users = t.rag_documents.select("document_id", F.col("user_id").alias("email"))
    asked = t.rag_documents.where("title is null").select(F.concat(F.lit(" "), F.upper("user_id"), F.lit(" ")).alias("email"))
    found = state.by_email(users, asked).select("document_id", F.lit(True).alias("known"))
    return t.rag_documents.select("document_id").join(found, "document_id", "left").select("document_id", F.coalesce("known", F.lit(False)).alias("known"))
