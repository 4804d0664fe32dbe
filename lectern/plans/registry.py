"""Registered queries of the core: name -> (spark, directory) -> DataFrame, and their SQL.

Every query runs over its whole tables.  Where both engines compute floats, they are rounded to nine digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import evaluation, retrieval, state, store, timeline
from lectern.plans.base import QUERIES, SQL, Data, query  # noqa: F401

COS = "list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])))"
HITS = f"""
    select query_id, vec_id, s as similarity, label, qlabel, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank
    from (select q.vec_id as query_id, v.vec_id, v.label, q.label as qlabel, {COS} as s from embeddings q, embeddings v where q.vec_id % 100 = 0)"""


def _queries_of(t: Data) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(t: Data, k: int = 20) -> DataFrame:
    return retrieval.top_k(t.embeddings, _queries_of(t), k)


def _judged(t: Data, k: int) -> DataFrame:
    e = t.embeddings
    h = _hits(t, k).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    return h.withColumn("relevant", (F.col("label") == F.col("qlabel")) & (F.col("vec_id") != F.col("query_id")))


@query(f"select query_id, vec_id, rank, round(similarity, 9) as similarity from ({HITS}) where rank <= 20")
def vector_topk(t):
    return _hits(t).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 9).alias("similarity"))


@query(f"""select query_id, vec_id, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from (
    select q.vec_id as query_id, v.vec_id, {COS} as s from embeddings q join embeddings v on q.label = v.label where q.vec_id % 100 = 0) qualify rank <= 5""")
def vector_topk_scoped(t):
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    s = t.embeddings.join(q, "label").select("query_id", "vec_id", retrieval.cosine(F.col("q"), F.col("embedding")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.round("s", 9).desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("query_id", "vec_id", "rank")


@query("select vec_id, coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0, false) as valid from embeddings")
def vector_validity(t):
    return t.embeddings.select("vec_id", retrieval.valid_vector(F.col("embedding"), 64).alias("valid"))


@query(f"""select query_id, round(max(similarity), 9) as best, case when max(similarity) >= 0.75 then 'covered' when max(similarity) >= 0.6 then 'weak' else 'absent' end as level
    from ({HITS}) where rank <= 20 and vec_id <> query_id group by query_id""")
def coverage_band(t):
    return retrieval.coverage(_hits(t).where("vec_id <> query_id")).withColumn("best", F.round("best", 9))


@query(f"""with r as (select query_id, min(rank) filter (where label = qlabel and vec_id <> query_id) as found from ({HITS}) where rank <= 20 group by query_id)
    select query_id, found from r""")
def first_relevant_rank(t):
    return evaluation.first_relevant(_judged(t, 20)).withColumn("found", F.col("found").cast("long"))


_FOUND = f"(select query_id, any_value(qlabel) as category, min(rank) filter (where label = qlabel and vec_id <> query_id) as found from ({HITS}) where rank <= 20 group by query_id)"


@query(f"""select count(*) as queries, avg((coalesce(found, 99) <= 1)::int) as recall_1, avg((coalesce(found, 99) <= 3)::int) as recall_3, avg((coalesce(found, 99) <= 5)::int) as recall_5,
    coalesce(round(sum(1.0::double / found) / count(*), 9), 0) as mrr from {_FOUND}""")
def recall_and_mrr(t):
    return evaluation.recall_at(evaluation.first_relevant(_judged(t, 20)), (1, 3, 5))


@query("""with s as (select coalesce(duration_seconds, 0.0) as x from llm_calls)
    select min(x) as lowest, median(x) as median, max(x) as highest from s""")
def score_range(t):
    return evaluation.score_range(t.llm_calls.select(F.col("duration_seconds").alias("score")))


@query("select chunk_id, case when text = '' then 0 else greatest(1, ceil(octet_length(encode(text)) / 4.0)) end::int as tokens from rag_document_chunks")
def token_estimate(t):
    return t.rag_document_chunks.select("chunk_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""select item_id, array_to_string(list_distinct_keep, ' ') as terms from (
    select item_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1])[1:64] as list_distinct_keep
    from (select item_id, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') as w from eval_items))""")
def query_terms(t):
    return t.eval_items.select("item_id", F.array_join(T.query_terms(F.col("question")), " ").alias("terms"))


@query("select block_id, sha256(text) as sha, 'objects/' || left(sha256(text), 2) || '/' || sha256(text) || '/source.pdf' as key from rag_document_blocks")
def content_hash(t):
    sha = F.sha2("text", 256)
    return t.rag_document_blocks.select("block_id", sha.alias("sha"), T.content_key(sha).alias("key"))


@query("select user_id, source_sha256, count(*) as copies, min(document_id) as first_id from rag_documents group by user_id, source_sha256")
def dedupe_by_hash(t):
    return t.rag_documents.groupBy("user_id", "source_sha256").agg(F.count("*").alias("copies"), F.min("document_id").alias("first_id"))


@query("select chunk_id, sha256('title: ' || case when coalesce(trim(title), '') = '' then 'none' else trim(title) end || ' | text: ' || trim(text, ' ')) as sha from rag_document_chunks join rag_documents using (document_id)")
def embedding_input(t):
    j = t.rag_document_chunks.select("chunk_id", "document_id", "text").join(t.rag_documents.select("document_id", "title"), "document_id")
    return j.select("chunk_id", F.sha2(T.embedding_input(F.col("title"), F.col("text")), 256).alias("sha"))


@query("select chunk_id from rag_document_chunks where content_sha256 <> sha256(text) or token_count_estimate is null")
def missing_embeddings(t):
    c = t.rag_document_chunks
    done = c.where("token_count_estimate is not null").select("chunk_id", F.lit("m").alias("model_name"), F.sha2("text", 256).alias("content_sha256"))
    return store.missing_embeddings(c.select("chunk_id", "content_sha256"), done, "m").select("chunk_id")


@query("select vec_id, label + 100 * (vec_id % 2 = 0)::int as label from embeddings")
def embedding_upsert(t):
    e = t.embeddings.select("vec_id", F.col("label").cast("int").alias("label"), F.lit(1).alias("version"))
    return store.upsert(e, e.where("vec_id % 2 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version")), ["vec_id"], "version").select("vec_id", "label")


@query("""with h as (select chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) as h from rag_document_chunks)
    select chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[1 + strpos('0123456789abcdef', h[17]) - 1 - 4 * ((strpos('0123456789abcdef', h[17]) - 1) // 4)] || h[18:20] || '-' || h[21:32] as id from h""")
def uuid5_ids(t):
    return t.rag_document_chunks.select("chunk_id", T.uuid5(F.col("chunk_id")).alias("id"))


_LAYER = "select document_id, page_number, sum(length(text)) as layer_chars from rag_document_blocks where page_number is not null group by all"


@query(f"""select l.document_id, l.page_number from ({_LAYER}) l left join
    (select document_id, page_number, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) as chars from rag_document_blocks where block_type = 'paragraph' group by all) b
    on l.document_id = b.document_id and l.page_number = b.page_number where layer_chars >= 300 and coalesce(chars, 0) < 0.25 * layer_chars""")
def lost_pages(t):
    b = t.rag_document_blocks
    layer = b.where("page_number is not null").groupBy("document_id", "page_number").agg(F.sum(F.length("text")).alias("layer_chars"))
    return B.lost_pages(layer, b.where("block_type = 'paragraph'"))


@query("select chunk_id, lag(chunk_id) over w as previous_chunk_id, lead(chunk_id) over w as next_chunk_id from rag_document_chunks window w as (partition by document_id order by sequence_index, chunk_id)")
def section_links(t):
    return store.linked(t.rag_document_chunks)


@query("""select c.chunk_id, array_to_string(list_sort(list(distinct l.block_id)), ',') as missing from rag_chunk_source_blocks l join rag_document_chunks c using (chunk_id)
    left join rag_document_blocks b on b.block_id = l.block_id and b.document_id = c.document_id where b.block_id is null group by c.chunk_id""")
def chunk_ref_violations(t):
    return store.broken_references(t.rag_chunk_source_blocks, t.rag_document_blocks, t.rag_document_chunks).select("chunk_id", F.array_join("missing", ",").alias("missing"))


@query("""select section_id, len(list_filter(regexp_split_to_array(regexp_replace(trim(coalesce(narration, ''), ' '), '\\n', ' ', 'g'), '[ \\t\\n\\f\\r\\x0b]+'), lambda w: w <> ''))::int as words from script_sections""")
def script_words(t):
    return t.script_sections.select("section_id", T.word_count(F.col("narration")).alias("words"))


@query("""with w as (select run_id, len(list_filter(regexp_split_to_array(coalesce(narration, ''), '[ \\t\\n\\f\\r\\x0b]+'), lambda w: w <> '')) as words from script_sections)
    select run_id, sum(words)::bigint as words, sum(words) < 0.7 * 2 * 130 as too_short from w group by run_id""")
def script_length_check(t):
    g = t.script_sections.groupBy("run_id").agg(F.sum(T.word_count(F.col("narration"))).alias("words"))
    return g.withColumn("too_short", F.col("words") < 0.7 * 2 * 130)


@query("""with w as (select section_id, len(list_filter(regexp_split_to_array(coalesce(narration, ''), '[ \\t\\n\\f\\r\\x0b]+'), lambda w: w <> ''))::double as words from script_sections)
    select section_id, greatest(2.0, round(words / 150.0 * 60.0 + 0.5, 2)) as seconds from w""")
def speech_duration(t):
    return t.script_sections.select("section_id", T.speech_seconds(T.word_count(F.col("narration"))).alias("seconds"))


@query("""with p as (select run_id, section_id, coalesce(length(narration), 0)::bigint * 60 as ms from script_sections)
    select run_id, section_id, (sum(ms) over w - ms)::bigint as start_ms, (sum(ms) over w)::bigint as end_ms from p window w as (partition by run_id order by section_id rows unbounded preceding)""")
def running_times(t):
    return timeline.running(t.script_sections.select("run_id", "section_id", (F.coalesce(F.length("narration"), F.lit(0)).cast("long") * 60).alias("ms")), "run_id", "section_id")


@query("""with b as (select document_id, ordinal, block_type = lag(block_type) over (partition by document_id order by ordinal) as same from rag_document_blocks)
    select document_id, ordinal, sum((not coalesce(same, false))::int) over (partition by document_id order by ordinal)::bigint as grp from b""")
def step_grouping(t):
    w = Window.partitionBy("document_id").orderBy("ordinal")
    b = t.rag_document_blocks.select("document_id", "ordinal", F.coalesce(F.col("block_type") == F.lag("block_type").over(w), F.lit(False)).alias("with_previous"))
    return timeline.step_groups(b, "document_id", "ordinal")


@query("""with b as (select event_id // 20 as frame, event_id as id, (event_id * 37 % 100)::double as x0, (event_id * 53 % 60)::double as y0 from events), c as (select *, x0 + 20 as x1, y0 + 12 as y1 from b)
    select a.frame, a.id as a, b.id as b from c a join c b on a.frame = b.frame and a.id < b.id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1
    where (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.1 * 240""")
def box_overlaps(t):
    e = t.events.select(F.floor(F.col("event_id") / 20).alias("frame"), F.col("event_id").alias("id"), (F.col("event_id") * 37 % 100).cast("double").alias("x0"), (F.col("event_id") * 53 % 60).cast("double").alias("y0"))
    return timeline.overlaps(e.withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 12))


@query("select document_id, case when s = '' then 'lesson' else s end as slug from (select document_id, trim(left(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), 60), '-') as s from rag_documents)")
def slugs(t):
    return t.rag_documents.select("document_id", T.slug(F.coalesce("title", F.lit(""))).alias("slug"))


@query("select document_id, len(list_filter(string_split(source_asset_key, '/'), lambda s: s in ('', '.', '..') or contains(s, ':') or contains(s, chr(92)))) = 0 as safe from rag_documents")
def safe_paths(t):
    return t.rag_documents.select("document_id", T.safe_path(F.col("source_asset_key")).alias("safe"))


@query("""select chunk_id, case when page_start is null then null when page_end is null or page_start = page_end then 'page ' || page_start else 'pages ' || page_start || '-' || page_end end as label from rag_document_chunks""")
def page_labels(t):
    return t.rag_document_chunks.select("chunk_id", T.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


@query(r"""select block_id, len(regexp_extract_all(text, '[\p{L}\p{N}]'))::int as letters from rag_document_blocks""")
def letter_counts(t):
    return t.rag_document_blocks.select("block_id", F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).alias("letters"))


@query(r"""select section_id, translate(regexp_replace(background, '[ \t\n\f\r\x0b$]+', '', 'g'), '−–—', '---') as compact from script_sections""")
def compact_equations(t):
    return t.script_sections.select("section_id", T.compact_equation(F.col("background")).alias("compact"))


@query("""with c as (select distinct call_id, run_id, label, seq from llm_calls), n as (select *, row_number() over (partition by run_id, label order by seq, call_id) as n from c)
    select call_id, case when n = 1 then label else label || ' #' || n end as shown from n""")
def log_labels(t):
    return state.labelled(t.llm_calls.select("call_id", "run_id", "label", "seq").distinct())


@query("""select run_id, count(*) as calls, round(sum(duration_seconds) filter (where duration_seconds > 0), 3) as seconds from (select distinct call_id, run_id, duration_seconds from llm_calls) group by run_id""")
def log_totals(t):
    return state.totals(t.llm_calls.select("call_id", "run_id", "duration_seconds").distinct())


@query("select user_id, max_by(event_type, (epoch_us(ts), event_id)) as event_type from events group by user_id")
def status_latest(t):
    return state.latest(t.events, "user_id", ["ts", "event_id"], "event_type")


_STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'parsing' when 'click' then 'chunking' when 'purchase' then 'ready' else 'failed' end"


@query(f"""with e as (select user_id, event_id, {_STATUS} as status, lag({_STATUS}) over (partition by user_id order by ts, event_id) as prev from events)
    select event_id, prev, status from e where prev is not null and not coalesce(
    (prev, status) in (('queued','parsing'),('queued','failed'),('parsing','chunking'),('parsing','failed'),('chunking','storing'),('chunking','failed'),('storing','embedding'),('storing','failed'),('embedding','ready'),('embedding','failed'),('failed','queued'),('failed','embedding')), false)""")
def status_illegal(t):
    e = t.events.withColumn("status", F.expr(_STATUS))
    return state.illegal(e, "user_id", ["ts", "event_id"]).select("event_id", "prev", "status")


@query("""with e as (select user_id as key, event_id as id, count(*) over (partition by user_id order by epoch_us(ts) range between 259199999999 preceding and current row) as n from events where event_type = 'error')
    select key, id, n from e where n >= 3""")
def limiter_window(t):
    return state.limiter_windows(t.events.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts"), 3, 72 * 3600)


@query(r"""select doc_id, len(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\f\r\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::int as n from documents where text is not null""")
def sentences_simple(t):
    return t.documents.where("text is not null").select("doc_id", F.size(T.simple_sentences(F.col("text"))).alias("n"))


@query("""select doc_id, case when length(x) > 300 then left(x, 299) || '…' else x end as line from (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g'), ' ') as x from documents)""")
def one_line(t):
    return t.documents.select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("""select distinct call_id, case when duration_seconds <= 20 then 'pad ' || printf('%.3f', 20 - duration_seconds) else 'speed ' || printf('%.6f', greatest(20 / duration_seconds, 1 / 1.15::double)) end as fit
    from llm_calls where duration_seconds > 0""")
def clip_fit(t):
    return t.llm_calls.where("duration_seconds > 0").select("call_id", timeline.clip_fit(F.col("duration_seconds"), F.lit(20.0)).alias("fit")).distinct()


@query("""select distinct call_id, round(epoch_us(recorded_at) / 1e6 - epoch_us(started_at) / 1e6, 1) as seconds from llm_calls""")
def elapsed_seconds(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return t.llm_calls.select("call_id", F.round(us("recorded_at") - us("started_at"), 1).alias("seconds")).distinct()


@query("""select doc_id, case when n >= 1000000 then printf('%.1f', n / 1000000.0::double) || ' MB' else greatest(1, ceil(n / 1000.0))::bigint || ' KB' end as label
    from (select doc_id, octet_length(encode(text))::bigint as n from documents)""")
def size_labels(t):
    return t.documents.select("doc_id", timeline.size_label(F.octet_length("text").cast("long")).alias("label"))
