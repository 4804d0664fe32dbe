"""Registered queries over retrieval: vectors and words within a user's papers, fusion, and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import normal
from lectern.functions import text as T
from lectern.operators import evaluation, keyword, retrieval
from lectern.plans.base import QUERIES, SQL, Data, query  # noqa: F401
from lectern.plans.registry import COS, HITS, _hits, _judged

# Every paper is asked its own title; the questions of some users are asked under another name, which must find nothing.
# A passage has the vector that the hash of its id names.
ASKED_SQL = """e as (select c.chunk_id, c.document_id, c.sequence_index, v.embedding from (select chunk_id, document_id, sequence_index, ('0x' || left(sha256(chunk_id), 6))::bigint % (select count(*) from embeddings) as vec_id from rag_document_chunks) c join embeddings v using (vec_id)),
    q as (select d.document_id as query_id, d.document_id, case when left(sha256(d.document_id), 1) < '4' then d.user_id || '-' else d.user_id end as asker, d.user_id, d.title as query, f.embedding from rag_documents d
    join (select document_id, arg_min(embedding, (sequence_index, chunk_id)) as embedding from e group by document_id) f using (document_id))"""
VECTOR_SQL = f"""{ASKED_SQL}, h as (select q.query_id, v.chunk_id, {COS} as s from q join e v using (document_id) where asker = user_id),
    vr as (select query_id, chunk_id, s, row_number() over (partition by query_id order by round(s, 9) desc, chunk_id) as rank from h)"""
KEYWORD_SQL = r""", t as (select query_id, document_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')[1:64])) as word from q where asker = user_id and query is not null),
    w as (select chunk_id, document_id, sequence_index, word, count(*) as n from (select chunk_id, document_id, sequence_index, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as word from rag_document_chunks) group by all),
    k as (select t.query_id, w.chunk_id, w.sequence_index, sum(w.n) as hits from t join w using (document_id, word) group by all),
    kr as (select query_id, chunk_id, round(hits * 0.1::double, 6) as rank_score, row_number() over (partition by query_id order by hits desc, sequence_index, chunk_id) as rank from k)"""


def _store(t: Data):
    """chunk_id, model_name, embedding of every passage."""
    n = t.embeddings.count()
    slot = F.conv(F.substring(F.sha2("chunk_id", 256), 1, 6), 16, 10).cast("long") % n
    return t.rag_document_chunks.select("chunk_id", slot.alias("vec_id"), F.lit("m").alias("model_name")).join(t.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def _asked(t: Data):
    first = t.rag_document_chunks.select("chunk_id", "document_id", "sequence_index").join(_store(t), "chunk_id").groupBy("document_id").agg(F.min_by("embedding", F.struct("sequence_index", "chunk_id")).alias("embedding"))
    asker = F.when(F.substring(F.sha2("document_id", 256), 1, 1) < "4", F.concat("user_id", F.lit("-"))).otherwise(F.col("user_id"))
    return t.rag_documents.select(F.col("document_id").alias("query_id"), "document_id", asker.alias("user_id"), F.col("title").alias("query")).join(first, "document_id")


def _by_vector(t: Data, limit: int = 20):
    return retrieval.scoped(t.rag_document_chunks, _store(t), t.rag_documents, _asked(t), "m", 64, limit)


def _by_word(t: Data, stems: bool = False):
    return keyword.search(t.rag_document_chunks, t.rag_documents, _asked(t), 20, stems)


@query(f"with {VECTOR_SQL} select query_id, chunk_id, round(s, 9) as similarity, rank from vr where rank <= 5")
def vector_in_paper(t):
    return _by_vector(t, 5).select("query_id", "chunk_id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"with {ASKED_SQL}{KEYWORD_SQL} select query_id, chunk_id, rank_score, rank from kr where rank <= 20")
def keyword_in_paper(t):
    return _by_word(t).select("query_id", "chunk_id", "rank_score", F.col("rank").cast("long").alias("rank"))


@query()
def keyword_stemmed(t):
    return _by_word(t, stems=True)


@query(f"""with {VECTOR_SQL}{KEYWORD_SQL}, b as (select coalesce(v.query_id, k.query_id) as query_id, coalesce(v.chunk_id, k.chunk_id) as item, v.rank as v, k.rank as w from (select * from vr where rank <= 20) v
    full join (select * from kr where rank <= 20) k on v.query_id = k.query_id and v.chunk_id = k.chunk_id),
    s as (select *, round(coalesce(1.0::double / (60 + v), 0) + coalesce(1.0::double / (60 + w), 0), 12) as score, concat_ws(',', case when v is not null then 'vector' end, case when w is not null then 'keyword' end) as methods from b)
    select query_id, item, score, methods, row_number() over (partition by query_id order by score desc, v nulls last, w nulls last, item) as rank from s qualify rank <= 8""")
def rrf_fusion(t):
    v, k = (x.withColumnRenamed("chunk_id", "item") for x in (_by_vector(t), _by_word(t)))
    r = retrieval.ranked(v, k, "hybrid", 8)
    return r.select("query_id", "item", "score", F.concat_ws(",", "methods").alias("methods"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {VECTOR_SQL}{KEYWORD_SQL}, b as (select query_id, max(s) as best, 'vector' as mode from vr where rank <= 8 group by query_id union all select query_id, arg_min(rank_score, rank), 'keyword' from kr where rank <= 8 group by query_id)
    select mode, query_id, round(best, 9) as best from b""")
def coverage_scores(t):
    v, k = (x.withColumnRenamed("chunk_id", "item") for x in (_by_vector(t), _by_word(t)))
    one = lambda m: retrieval.best_score(retrieval.ranked(v, k, m, 8), m).select(F.lit(m).alias("mode"), "query_id", F.round("best", 9).alias("best"))
    return one("vector").unionByName(one("keyword"))


@query(f"""with {VECTOR_SQL}{KEYWORD_SQL}, j as (select 'vector' as mode, query_id, chunk_id, rank from vr where rank <= 8 union all select 'keyword', query_id, chunk_id, rank from kr where rank <= 8),
    r as (select j.mode, j.query_id, min(j.rank) filter (where contains(lower(c.text), lower(q.query))) as found from j join rag_document_chunks c using (chunk_id) join q using (query_id) group by all)
    select mode, count(*) as queries, round(avg((coalesce(found, 99) <= 1)::int), 9) as recall_1, round(avg((coalesce(found, 99) <= 3)::int), 9) as recall_3, round(avg((coalesce(found, 99) <= 8)::int), 9) as recall_8, coalesce(round(sum(1.0::double / found) / count(*), 9), 0) as mrr from r group by mode""")
def recall_by_mode(t):
    """A passage is relevant when it has the whole title."""
    q = t.rag_documents.select(F.col("document_id").alias("query_id"), F.lower("title").alias("title"))
    text = t.rag_document_chunks.select("chunk_id", F.lower("text").alias("text"))
    v, k = _by_vector(t, 8).select("query_id", "chunk_id", "rank"), _by_word(t).where("rank <= 8").select("query_id", "chunk_id", "rank")
    both = v.withColumn("mode", F.lit("vector")).unionByName(k.withColumn("mode", F.lit("keyword")))
    j = both.join(text, "chunk_id").join(q, "query_id").withColumn("relevant", F.coalesce(F.contains("text", "title"), F.lit(False)))
    r = evaluation.recall_at(evaluation.first_relevant(j, ("mode",)), (1, 3, 8), ["mode"])
    return r.select("mode", "queries", *(F.round(f"recall_{k}", 9).alias(f"recall_{k}") for k in (1, 3, 8)), "mrr")


@query(f"""with {VECTOR_SQL}{KEYWORD_SQL}, j as (select query_id, chunk_id from vr where rank <= 8 union all select query_id, chunk_id from kr where rank <= 8),
    f as (select distinct j.query_id from j join rag_document_chunks c using (chunk_id) join q using (query_id) where contains(lower(c.text), lower(q.query)))
    select query_id from q where query_id not in (select query_id from f)""")
def missed_questions(t):
    q = t.rag_documents.select(F.col("document_id").alias("query_id"), F.lower("title").alias("title"))
    text = t.rag_document_chunks.select("chunk_id", F.lower("text").alias("text"))
    both = _by_vector(t, 8).select("query_id", "chunk_id", "rank").unionByName(_by_word(t).where("rank <= 8").select("query_id", "chunk_id", "rank"))
    j = both.join(text, "chunk_id").join(q, "query_id").withColumn("relevant", F.coalesce(F.contains("text", "title"), F.lit(False)))
    return evaluation.missed(_asked(t).select("query_id"), evaluation.first_relevant(j))


_FOUND = f"(select query_id, any_value(qlabel) as category, min(rank) filter (where label = qlabel and vec_id <> query_id) as found from ({HITS}) where rank <= 20 group by query_id)"


@query(f"""select category, count(*) as queries, avg((coalesce(found, 99) <= 5)::int) as recall_5, coalesce(round(sum(1.0::double / found) / count(*), 9), 0) as mrr from {_FOUND} group by category""")
def recall_by_category(t):
    found = _judged(t, 20).groupBy("query_id").agg(F.any_value("qlabel").alias("category"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("found"))
    return evaluation.recall_at(found, (5,), ["category"])


@query()
def ann_recall(t):
    """Recall of the approximate index against the exact search."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = retrieval.Cells(t.embeddings, 32)
    return evaluation_recall(index.search(index.assign(t.embeddings), q, 10, 16), _hits(t, 10))


def evaluation_recall(found, exact):
    return retrieval.recall(found, exact).select(F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.9).alias("enough"))


@query("""with s as (select distinct call_id, round(duration_seconds, 1) as score, error is null as positive from llm_calls where duration_seconds is not null),
    d as (select distinct score from s),
    cuts as (select (score + lead(score) over (order by score)) / 2 as t from d union all select min(score) - 1e-9 from d union all select max(score) + 1e-9 from d),
    b as (select score, count(*) as n, sum(positive::int) as p from s group by score),
    a as (select t, sum(case when score >= t then p else 0 end)::bigint as kept, sum(case when score < t then n - p else 0 end)::bigint as rejected from cuts, b where t is not null group by t),
    n as (select count(*) as total, sum(positive::int)::bigint as positives from s)
    select round(t, 9) as threshold, round((kept + rejected) / total, 9) as accuracy, kept, positives, rejected, total - positives as negatives, t < (select min(score) from d) as keeps_everything, round(positives / total, 9) as baseline from a, n order by round((kept + rejected) / total, 12) desc, t limit 1""")
def threshold_search(t):
    s = t.llm_calls.where("duration_seconds is not null").select("call_id", F.round("duration_seconds", 1).alias("score"), F.col("error").isNull().alias("positive")).distinct()
    r = evaluation.best_threshold(s)
    return r.select(F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"), "kept", "positives", "rejected", "negatives", "keeps_everything", F.round("baseline", 9).alias("baseline"))


#: What the search form does to a text, as far as SQL can say it: full-width and joined letters, blanks, dashes, soft hyphens, case.
_SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + _SPACES
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + " " * len(_SPACES)


def _form(c: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    dashes = normal.DASHES
    inner = f"translate(translate({c}, '{quoted(_WIDE)}', '{quoted(_PLAIN)}'), '{dashes}­', '{' ' * len(dashes)}')"
    return f"trim(regexp_replace(lower(replace(replace(replace(nfc_normalize({inner}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')), '[ ]+', ' ', 'g'))"


@query(f"""with p as (select item_id, {_form('phrase')} as phrase from (select item_id, unnest(answer_phrases) as phrase from eval_items)), d as (select doc_id, {_form('text')} as text from documents)
    select distinct item_id, doc_id from p join d on contains(text, phrase) where phrase <> ''""")
def phrase_relevance(t):
    phrases = t.eval_items.select("item_id", F.explode("answer_phrases").alias("phrase"))
    return evaluation.relevant(t.documents.select(F.col("doc_id").alias("passage_id"), "text"), phrases).select("item_id", F.col("passage_id").alias("doc_id"))


@query(f"""with p as (select distinct item_id, phrase, {_form('phrase')} as form from (select item_id, unnest(answer_phrases) as phrase from eval_items)), d as (select {_form('text')} as text from documents)
    select item_id, phrase from p where form = '' or not exists (select 1 from d where contains(d.text, p.form))""")
def phrase_problems(t):
    return evaluation.phrase_problems(t.eval_items.select("item_id", "answer_phrases"), t.documents.select(F.col("doc_id").alias("passage_id"), "text"))


@query("""with q as (select item_id // 2 as item_id, case when item_id % 9 = 0 then 'answerable' when item_id % 7 = 0 then 'absent' else kind end as kind, coalesce(answer_phrases, []) as ps from eval_items)
    select distinct item_id, 'id twice' as problem from q qualify count(*) over (partition by item_id) > 1
    union select item_id, 'no phrases' from q where kind = 'answerable' and (len(ps) = 0 or len(list_filter(ps, lambda p: trim(coalesce(p, '')) = '')) > 0)
    union select item_id, 'phrases of an absent question' from q where kind = 'absent' and len(ps) > 0""")
def question_problems(t):
    """Of questions whose ids are halved and some of whose kinds are changed, so that every rule is broken somewhere."""
    kind = F.when(F.col("item_id") % 9 == 0, "answerable").when(F.col("item_id") % 7 == 0, "absent").otherwise(F.col("kind"))
    return evaluation.question_problems(t.eval_items.select(F.floor(F.col("item_id") / 2).alias("item_id"), kind.alias("kind"), "answer_phrases"))


@query("""select item_id, case when trim(question) <> '' then 'task: question answering | query: ' || trim(question) end as input from eval_items""")
def question_inputs(t):
    return t.eval_items.select("item_id", T.question_input(F.col("question")).alias("input"))


@query(f"""select query_id, case level when 'covered' then '{retrieval.MESSAGES['covered']}' when 'weak' then '{retrieval.MESSAGES['weak']}' else '{retrieval.MESSAGES['absent']}' end as message from
    (select query_id, case when max(similarity) >= 0.75 then 'covered' when max(similarity) >= 0.6 then 'weak' else 'absent' end as level from ({HITS}) where rank <= 20 and vec_id <> query_id group by query_id)""")
def coverage_messages(t):
    level = retrieval.coverage(_hits(t).where("vec_id <> query_id"))
    return level.select("query_id", F.coalesce(*(F.when(F.col("level") == k, v) for k, v in retrieval.MESSAGES.items())).alias("message"))
