"""Registered queries over scripts: forms and sentences of text, grounding, storyboards, layout, traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import normal
from lectern.functions import text as T
from lectern.operators import code, grounding, layout, script, storyboard, timeline, traces
from lectern.plans.base import QUERIES, SQL, Data, query  # noqa: F401
from lectern.sources import files

BACK = "|".join(grounding.BACK)
BLANKS = r"[\t-\r\x{85}\p{Z}]"


def _checks(t: Data):
    return t.sentence_checks.select("check_id", "section_id", "sentence_index", "sentence", "verdict", "quote", "supported").distinct()


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`([^`]+)`', '\1', 'g'),
    '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '(?m)^#+\s*', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g')) as sha from documents""")
def markdown_strip(t):
    return t.documents.select("doc_id", F.sha2(T.strip_markdown(F.col("text")), 256).alias("sha"))


@query()
def normalized_texts(t):
    return t.documents.select("doc_id", F.sha2(normal.normalized(F.col("text"), "none"), 256).alias("sha"), F.sha2(normal.search_form(F.col("text")), 256).alias("search_sha"))


@query()
def spoken_seconds(t):
    """Speaking time of what is left of a narration without markdown."""
    return t.script_sections.select("section_id", T.speech_seconds(T.word_count(normal.normalized(F.col("narration")))).alias("seconds"))


_MARKED = "trim(coalesce(sentence, ''))"
for _a in T.ABBREVIATIONS:
    _MARKED = f"replace({_MARKED}, '{_a}', '{_a.replace('.', chr(1))}')"


@query(rf"""select check_id, len(list_filter(string_split(regexp_replace({_MARKED}, '([.!?]["'')\]]?){BLANKS}+(["''(\[]?[^\t-\r\x{{85}}\p{{Z}}a-z"''(\[])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: trim(s) <> ''))::int as n from (select distinct check_id, sentence from sentence_checks)""")
def claim_sentences(t):
    return t.sentence_checks.select("check_id", "sentence").distinct().select("check_id", F.size(T.claim_sentences(F.coalesce("sentence", F.lit("")))).alias("n"))


@query()
def story_beats(t):
    """Beats of every narration: by groups of sentences, and with the short ones merged."""
    beats = storyboard.fallback_beats(F.col("narration"), F.coalesce("section_title", F.lit("Part")))
    return t.script_sections.select("section_id", F.size(storyboard.story_sentences(F.coalesce("narration", F.lit("")))).alias("sentences"), beats.alias("b")).select("section_id", "sentences", F.size("b").alias("beats"), F.size(storyboard.merged_beats(F.col("b"))).alias("merged"))


_SYMBOLS = grounding.SYMBOLS.replace("^", "").replace("'", "''")


@query(rf"""with s as (select section_id, coalesce(background, '') as b from script_sections),
    n as (select *, len(list_filter(string_split(regexp_replace(replace(replace(trim(b), 'e.g.', 'e' || chr(1) || 'g' || chr(1)), 'i.e.', 'i' || chr(1) || 'e' || chr(1)), '([.!?])["'')\]]*{BLANKS}+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(x) <> '')) as n from s)
    select section_id, case when regexp_replace(b, '\s+', '', 'g') = '' then null when regexp_matches(b, '[0-9{_SYMBOLS}^]') then 'digit or symbol' when regexp_matches(b, '(?i)\b(?:{"|".join(grounding.CLAIMS)})\b') then 'claim about the paper' when n > 2 then 'too long' end as problem from n""")
def background_rules(t):
    return t.script_sections.select("section_id", grounding.background_problem(F.col("background")).alias("problem"))


@query(rf"""with s as (select section_id, coalesce(background, '') as b from script_sections)
    select section_id, case when regexp_matches(b, '[0-9{_SYMBOLS}^]') or regexp_matches(b, '(?i)\b(?:{"|".join(grounding.CLAIMS)})\b') or len(list_filter(string_split(regexp_replace(replace(replace(trim(b), 'e.g.', 'e' || chr(1) || 'g' || chr(1)), 'i.e.', 'i' || chr(1) || 'e' || chr(1)), '([.!?])["'')\]]*{BLANKS}+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(x) <> '')) > 2 then '' else background end as background from s join script_sections using (section_id)""")
def kept_backgrounds(t):
    return t.script_sections.select("section_id", grounding.kept_background(F.col("background")).alias("background"))


@query(rf"""with s as (select distinct section_id as part, sentence_index as i, not supported as rejected, regexp_matches(sentence, '^[^\p{{L}}\p{{N}}_]*(?:{BACK})\b') as refers_back, check_id from sentence_checks),
    a as (select *, sum((not rejected and not refers_back)::int) over (partition by part order by i, check_id rows unbounded preceding) as island from s),
    b as (select *, max(rejected::int) over (partition by part, island order by i, check_id rows between unbounded preceding and 1 preceding) as prior from a)
    select check_id, case when rejected then 'rejected' when refers_back and coalesce(prior, 0) = 1 then 'dependent' else 'kept' end as fate from b""")
def sentence_removal(t):
    s = t.sentence_checks.select("section_id", "sentence_index", "check_id", (~F.col("supported")).alias("rejected"), F.col("sentence").rlike(grounding.REFERS_BACK).alias("refers_back")).distinct()
    parts = s.select(F.col("section_id").alias("part"), F.struct("sentence_index", "check_id").alias("i"), "rejected", "refers_back")
    return grounding.removal(parts).select(F.col("i.check_id").alias("check_id"), "fate")


@query("""with v as (select distinct check_id, section_id as part, sentence_index + case when check_id % 40 = 0 then 100 when check_id % 37 = 0 then -1 else 0 end as i from sentence_checks),
    s as (select section_id as part, count(*) as n from (select distinct check_id, section_id from sentence_checks) group by all)
    select part from v join s using (part) group by part having count(*) <> count(distinct i) or max((i < 0 or i >= n)::int) = 1""")
def verdict_index_problems(t):
    """Of verdicts some of whose indexes are moved, so that some are outside and some come twice."""
    c = F.col("check_id")
    moved = F.when(c % 40 == 0, 100).when(c % 37 == 0, -1).otherwise(0)
    v = t.sentence_checks.select("check_id", F.col("section_id").alias("part"), F.col("sentence_index").alias("i")).distinct()
    return grounding.index_problems(v.withColumn("i", F.col("i") + moved), v)


_SIGNALS = " or ".join(f"contains(lower(sentence), '{x.replace(chr(39), chr(39) * 2)}')" for x in grounding.FRAMING)


@query(rf"""with v as (select distinct check_id, section_id, sentence, verdict from sentence_checks where verdict = 'framing'), j as (select v.*, s.part_name from v join script_sections s using (section_id))
    select check_id, case when part_name in ('introduction', 'conclusion') and not regexp_matches(sentence, '\p{{Nd}}') and ({_SIGNALS}) then 'framing' else 'unsupported' end as result from j""")
def framing_verdicts(t):
    v = _checks(t).where("verdict = 'framing'").join(t.script_sections.select("section_id", "part_name"), "section_id")
    return v.select("check_id", grounding.judge(F.col("part_name"), F.lit(False), F.col("sentence"), F.col("verdict"), F.col("quote"), F.lit("")).alias("result"))


@query()
def verdict_judge(t):
    """Every sentence by its verdict against the passages that its section cites."""
    c = _checks(t)
    s = t.script_sections.select("section_id", "document_id", "part_name", "evidence_ids")
    passages = _passages(t)
    cited = s.where("part_name = 'section'").select("section_id", "document_id", F.explode(F.array_distinct("evidence_ids")).alias("passage_id")).join(passages, ["document_id", "passage_id"])
    whole = s.where("part_name <> 'section'").select("section_id", "document_id").join(passages, "document_id")
    texts = cited.select("section_id", "text").unionByName(whole.select("section_id", "text")).groupBy("section_id").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    part = F.col("section_id").alias("part")
    sentences = c.join(s.select("section_id", "part_name"), "section_id").select(part, F.col("sentence_index").alias("i"), "part_name", "sentence").distinct()
    verdicts = c.where("verdict is not null").select(part, F.col("sentence_index").alias("i"), "verdict", "quote")
    return grounding.judged(sentences, verdicts, texts.select(part, "texts"))


def _passages(t: Data):
    """document_id, passage_id, text, label of the numbered passages of every paper."""
    w = Window.partitionBy("document_id").orderBy("sequence_index", "chunk_id")
    c = t.rag_document_chunks.where(F.btrim("text", F.lit(" \t\n\r")) != "")
    return c.select("document_id", F.concat(F.lit("P"), F.row_number().over(w).cast("string")).alias("passage_id"), "text", F.coalesce(T.location(F.col("page_start"), F.col("page_end"), F.col("section_path")), F.lit("")).alias("label"))


@query()
def lesson_problems(t):
    s = t.script_sections
    lesson = F.concat_ws("/", "run_id", "document_id")
    sections = s.select(lesson.alias("lesson"), F.col("section_id").alias("section"), F.col("part_name").alias("part"), "narration", "background", F.col("evidence_ids").alias("cited"))
    lessons = s.select(lesson.alias("lesson"), "document_id").distinct()
    passages = _passages(t).join(lessons, "document_id").select("lesson", "passage_id", "text", "label")
    return grounding.lesson_problems(sections, passages).select("lesson", "section", "problem")


@query("""with p as (select document_id, 'P' || row_number() over (partition by document_id order by sequence_index, chunk_id) as passage_id from rag_document_chunks where trim(text, e' \\t\\n\\r') <> ''),
    c as (select section_id, document_id, unnest(list_distinct(evidence_ids)) as passage_id from script_sections where part_name = 'section')
    select c.section_id, string_agg(c.passage_id, ', ' order by c.passage_id) as unknown from c left join p using (document_id, passage_id) where p.passage_id is null group by c.section_id""")
def unknown_citations(t):
    s = t.script_sections.where("part_name = 'section'").select("section_id", "document_id", F.explode(F.array_distinct("evidence_ids")).alias("passage_id"))
    lost = s.join(_passages(t).select("document_id", "passage_id"), ["document_id", "passage_id"], "left_anti")
    return lost.groupBy("section_id").agg(F.array_join(F.array_sort(F.collect_set("passage_id")), ", ").alias("unknown"))


@query()
def numbers_supported(t):
    c = _checks(t).select("check_id", F.coalesce("sentence", F.lit("")).alias("s"), F.coalesce("quote", F.lit("")).alias("q")).distinct()
    return c.select("check_id", F.array_join(grounding.unsupported_numbers(F.col("s"), F.col("q")), ",").alias("numbers"), F.array_join(grounding.unsupported_equations(F.col("s"), F.col("q")), ",").alias("equations")).where("numbers <> '' or equations <> ''")


@query("""with s as (select section_id, run_id, document_id, part_name, section_title, row_number() over (partition by run_id, document_id order by section_id) as place from script_sections),
    c as (select section_id, count(distinct sentence_index) as n, count(distinct sentence_index) filter (where supported) as kept from sentence_checks group by section_id),
    k as (select s.*, coalesce(c.n, 1) as n, coalesce(c.kept, 1) as kept from s left join c using (section_id)),
    l as (select *, sum((part_name = 'section')::int) over (partition by run_id, document_id order by place) as no, max((part_name = 'section')::int) over (partition by run_id, document_id) as some_ from k where part_name <> 'section' or kept > 0)
    select section_id, case when part_name = 'section' and section_id % 5 = 0 then 'Part ' || no else section_title end as title from l where some_ = 1""")
def applied_reports(t):
    """Which parts of a script are left, and under which title; every fifth title is rejected."""
    w = Window.partitionBy("run_id", "document_id").orderBy("section_id")
    sentences = t.sentence_checks.groupBy("section_id", F.col("sentence_index").alias("i")).agg(F.max("supported").alias("kept"), F.min("sentence").alias("sentence"))
    listed = sentences.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence", "kept"))), lambda x: x).alias("x"))
    s = t.script_sections.withColumn("place", F.row_number().over(w)).join(listed, "section_id", "left")
    lesson = F.concat_ws("/", "run_id", "document_id").alias("lesson")
    texts = F.coalesce(F.transform("x", lambda x: F.coalesce(x["sentence"], F.lit("x"))), F.array(F.lit("x")))
    parts = s.select(lesson, "place", "part_name", F.col("section_title").alias("title"), (F.col("section_id") % 5 == 0).alias("title_rejected"), texts.alias("sentences"), "section_id")
    fates = s.select(lesson, "place", F.posexplode("x").alias("i", "x")).select("lesson", "place", "i", F.when(F.col("x.kept"), "kept").otherwise("rejected").alias("fate"))
    return grounding.applied(parts, fates).join(parts.select("lesson", "place", "section_id"), ["lesson", "place"]).select("section_id", "title")


@query("""select section_id, case when coalesce(trim(background), '') = '' then sha256(narration) else sha256(concat_ws(' ', 'Background:', trim(background), narration)) end as sha from script_sections""")
def narrations_with_background(t):
    return t.script_sections.select("section_id", F.sha2(script.with_background(F.col("narration"), F.col("background")), 256).alias("sha"))


@query("""with r as (select section_id, count(distinct sentence_index) filter (where not supported) as n from sentence_checks group by section_id)
    select section_id, case when n = 1 then '1 sentence the paper did not support was removed.' when n > 1 then n || ' sentences the paper did not support were removed.' end as note from r""")
def removed_notes(t):
    n = t.sentence_checks.groupBy("section_id").agg(F.count_distinct(F.when(~F.col("supported"), F.col("sentence_index"))).alias("n"))
    return n.select("section_id", script.removed_note(F.col("n")).alias("note"))


@query("""with a as (select run_id, count(*) filter (where not supported) as failed from (select distinct check_id, run_id, supported from sentence_checks where check_id % 2 = 0) group by run_id),
    b as (select run_id, count(*) filter (where not supported) as failed from (select distinct check_id, run_id, supported from sentence_checks where check_id % 2 = 1) group by run_id)
    select run_id, case when b.failed <= a.failed then 'rewrite' else 'first' end as choice from a join b using (run_id)""")
def script_choices(t):
    """The even checks of a run stand for the first script, the odd ones for its rewrite."""
    c = t.sentence_checks.select("check_id", "run_id", "supported").distinct()
    failed = lambda odd: c.where(F.col("check_id") % 2 == odd).groupBy("run_id").agg(F.count_if(~F.col("supported")).alias(f"f{odd}"))
    return failed(0).join(failed(1), "run_id").select("run_id", script.better_script(F.col("f0"), F.col("f1")).alias("choice"))


@query(rf"""with w as (select run_id, document_id, array_agg(section_title order by section_id) as titles, array_agg(coalesce(narration, '') order by section_id) as texts, sum(len(list_filter(regexp_split_to_array(coalesce(narration, ''), '[ \t\n\f\r\x0b]+'), lambda w: w <> '')))::bigint as words from script_sections group by all)
    select a.document_id, a.run_id, b.run_id as other, a.titles = b.titles and len(list_filter(b.texts, lambda x: trim(x) = '')) = 0 and b.words >= 0.8 * a.words as rewrite, a.titles = b.titles and b.words > a.words as retry from w a join w b on a.document_id = b.document_id and a.run_id < b.run_id""")
def accepted_rewrites(t):
    """Of each paper's scripts, whether one could stand for an earlier one."""
    s = t.script_sections.groupBy("run_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "section_title", F.coalesce("narration", F.lit("")).alias("text")))).alias("x"), F.sum(T.word_count(F.col("narration"))).alias("words"))
    s = s.select("run_id", "document_id", F.transform("x", lambda x: x["section_title"]).alias("titles"), F.transform("x", lambda x: x["text"]).alias("texts"), "words")
    b = s.select("document_id", *(F.col(c).alias(f"b_{c}") for c in ("run_id", "titles", "texts", "words")))
    j = s.join(b, "document_id").where(F.col("run_id") < F.col("b_run_id"))
    return j.select("document_id", "run_id", F.col("b_run_id").alias("other"), script.rewrite_accepted(F.col("titles"), F.col("words"), F.col("b_titles"), F.col("b_texts"), F.col("b_words")).alias("rewrite"), script.retry_accepted(F.col("titles"), F.col("words"), F.col("b_titles"), F.col("b_words")).alias("retry"))


_PLAN = "(select distinct call_id, run_id, output from llm_calls where schema_name = 'LessonPlan' and output is not null)"


@query(f"""with p as (select call_id, run_id, try_cast(json_extract(case when json_valid(output) then output end, '$.sections') as varchar[]) as titles from {_PLAN}),
    r as (select call_id, run_id, try_cast(json_extract(case when json_valid(output) then output end, '$.must_cover') as varchar[]) as items from (select distinct call_id, run_id, output from llm_calls where schema_name = 'LessonRequest' and output is not null)),
    i as (select distinct run_id, unnest(items) as item from r), x as (select run_id, lower(array_to_string(flatten(list(titles order by call_id)), ' ')) as text from p where titles is not null group by run_id)
    select i.run_id, i.item from i join x using (run_id) where trim(item) <> '' and not contains(x.text, lower(i.item))""")
def uncovered_items(t):
    """What a run's requests must cover and its plans' titles don't name."""
    strings = lambda schema, field: t.llm_calls.where((F.col("schema_name") == schema) & F.col("output").isNotNull()).select("call_id", "run_id", F.from_json("output", f"{field} array<string>")[field].alias("x")).distinct()
    plans = strings("LessonPlan", "sections").where("x is not null").groupBy("run_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("call_id", "x"))), lambda s: s["x"])).alias("titles"))
    items = strings("LessonRequest", "must_cover").select("run_id", F.explode("x").alias("item")).distinct()
    return script.uncovered(items.withColumnRenamed("run_id", "key"), plans.select(F.col("run_id").alias("key"), "titles", F.lit(None).cast("array<string>").alias("terms"))).select(F.col("key").alias("run_id"), "item")


@query("""with i as (select item_id, unnest(answer_phrases) as item from eval_items), x as (select item_id, lower(left(coalesce(passage, ''), (length(coalesce(passage, '')) // 2)::int)) as text from eval_items)
    select distinct item_id, item from i join x using (item_id) where trim(item) <> '' and not (contains(text, lower(trim(item))) or contains(text, lower(trim(item)) || 's') or contains(text, regexp_replace(lower(trim(item)), 's$', '')))""")
def unmentioned_terms(t):
    """Answer phrases that the first half of their passage lacks."""
    items = t.eval_items.select(F.col("item_id").alias("key"), F.explode("answer_phrases").alias("item")).distinct()
    half = F.left("passage", F.floor(F.length("passage") / 2).cast("int"))
    return script.unmentioned(items, t.eval_items.select(F.col("item_id").alias("key"), half.alias("text"))).select(F.col("key").alias("item_id"), "item")


@query("""select distinct call_id, case when contains(lower(prompt), 'photosynthesis') then 'Photosynthesis' when contains(lower(prompt), 'binary search') or contains(lower(prompt), 'binary-search') then 'Binary Search' when contains(lower(prompt), 'sorting') then 'Sorting' else label end as topic from llm_calls""")
def request_topics(t):
    return t.llm_calls.select("call_id", T.topic(F.col("prompt"), F.col("label")).alias("topic")).distinct()


@query("""select distinct call_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(output, '`+'), lambda x: length(x))), 0))::int) as fence, replace(replace(coalesce(output, ''), '|', '\\|'), chr(10), ' ') as cell from llm_calls""")
def log_fences(t):
    return t.llm_calls.select("call_id", T.fence(F.coalesce("output", F.lit(""))).alias("fence"), T.table_cell(F.col("output")).alias("cell")).distinct()


@query()
def call_logs(t):
    return files.call_log(t.llm_calls.select("call_id", "run_id", "seq", "label", "prompt", "output", "error").distinct()).select("run_id", F.sha2("log", 256).alias("sha"))


@query("""with c as (select section_id, row_number() over (partition by run_id order by section_id) - 1 as i, length(coalesce(narration, '')) as n, case when part_name = 'section' then 3 else 2 end as parts from script_sections)
    select section_id, i::int as i, case when n = 0 then 'pending' else 'spoken' end as state from c""")
def narration_states(t):
    w = Window.partitionBy("run_id").orderBy("section_id")
    return t.script_sections.select("section_id", (F.row_number().over(w) - 1).cast("int").alias("i"), F.when(F.length(F.coalesce("narration", F.lit(""))) == 0, "pending").otherwise("spoken").alias("state"))


@query(r"""with s as (select section_id, string_split(regexp_replace(trim(narration, ' '), '([.!?])[ \t\n\f\r\x0b]+', '\1' || chr(1), 'g'), chr(1)) as p from script_sections where trim(narration, e' \t\n\f\r\x0b') <> ''),
    u as (select section_id, unnest(list_filter(p, lambda x: x <> '')) as x, generate_subscripts(list_filter(p, lambda x: x <> ''), 1) - 1 as i from s),
    n as (select section_id, i, length(x)::bigint as chars, sum(length(x)) over w as upto, sum(length(x)) over (partition by section_id) as total, max(i) over (partition by section_id) as last from u window w as (partition by section_id order by i rows unbounded preceding)),
    e as (select section_id, i, case when i = last then total * 60 else floor(total * 60 * upto / total) end as end_ms from n)
    select section_id, i::int as i, coalesce(lag(end_ms) over (partition by section_id order by i), 0)::bigint as start_ms, end_ms::bigint as end_ms from e""")
def subtitle_cues(t):
    parts = t.script_sections.where(F.btrim("narration", F.lit(" \t\n\f\r\x0b")) != "").select("section_id", F.posexplode(T.simple_sentences(F.btrim("narration", F.lit(" ")))).alias("i", "x"))
    total = F.sum(F.length("x")).over(Window.partitionBy("section_id"))
    c = timeline.cues(parts.select(F.col("section_id").alias("section"), "i", F.length("x").cast("long").alias("chars"), F.lit(0).cast("long").alias("section_start_ms"), (total * 60).cast("long").alias("section_ms")))
    return c.select(F.col("section").alias("section_id"), "i", "start_ms", "end_ms")


@query()
def subtitle_files(t):
    parts = t.script_sections.where(F.btrim("narration", F.lit(" \t\n\f\r\x0b")) != "").select("section_id", F.posexplode(timeline.subtitle_lines(F.col("narration"))).alias("i", "text"))
    total = F.sum(F.length("text")).over(Window.partitionBy("section_id"))
    p = parts.select(F.col("section_id").alias("section"), "i", "text", F.length("text").cast("long").alias("chars"), F.lit(0).cast("long").alias("section_start_ms"), (total * 60).cast("long").alias("section_ms"))
    return files.srt(timeline.cues(p).join(p.select("section", "i", "text"), ["section", "i"])).select(F.col("section").alias("section_id"), F.sha2("srt", 256).alias("sha"))


_BOX = "(select event_id // 20 as frame, event_id as id, (event_id * 37 % 160)::double / 10 - 8 as x0, (event_id * 53 % 90)::double / 10 - 4.5 as y0 from events)"


def _boxes(t: Data):
    i = F.col("event_id")
    e = t.events.select(F.floor(i / 20).alias("frame"), i.alias("id"), ((i * 37 % 160).cast("double") / 10 - 8).alias("x0"), ((i * 53 % 90).cast("double") / 10 - 4.5).alias("y0"), (i % 10 / 10).alias("opacity"))
    return e.withColumn("x1", F.col("x0") + 2.0).withColumn("y1", F.col("y0") + 0.5)


@query(f"""select frame, id, case when x0 < -7.05 or x0 + 2 > 7.05 or y0 + 0.5 > 4.05 or y0 < -4.05 then 'leaves the screen' else 'covers the subtitle area' end as problem from {_BOX}
    where (x0 < -7.05 or x0 + 2 > 7.05 or y0 + 0.5 > 4.05 or y0 < -4.05 or y0 < -4 + 1.2 - 0.05) and id % 10 >= 1""")
def box_problems(t):
    return layout.box_problems(layout.visible(_boxes(t)), 14.0, 8.0)


@query(f"""with t as (select *, x0 + 2 as x1, y0 + 0.5 as y1 from {_BOX} where id % 2 = 0), s as (select frame, id as shape, x0, y0, x0 + 2 as x1, y0 + 0.5 as y1 from {_BOX} where id % 2 = 1),
    p as (select frame, shape, x0 + k * 0.5 as x, y0 as y from s, (select unnest(range(0, 5)) as k))
    select distinct t.frame, t.id from t join p on t.frame = p.frame and p.x > t.x0 - 0.05 and p.x < t.x1 + 0.05 and p.y > t.y0 - 0.05 and p.y < t.y1 + 0.05 join s on s.frame = p.frame and s.shape = p.shape
    where not (s.x0 <= t.x0 + 0.02 and s.x1 >= t.x1 - 0.02 and s.y0 <= t.y0 + 0.02 and s.y1 >= t.y1 - 0.02)""")
def crossed_texts(t):
    b = _boxes(t)
    texts, shapes = b.where("id % 2 = 0"), b.where("id % 2 = 1").withColumnRenamed("id", "shape")
    points = shapes.select("frame", "shape", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "x0", F.col("y0").alias("y")).select("frame", "shape", (F.col("x0") + F.col("k") * 0.5).alias("x"), "y")
    return layout.crossed(texts, points, shapes)


@query("""with e as (select event_id, 1 + event_id % 20 as w, 1 + event_id % 9 as h, (event_id * 7 % 23) - 11 as x, (event_id * 5 % 13) - 6 as y from events),
    s as (select *, least(1.0::double, 13.0::double / w, 7.0::double / h) as k from e)
    select event_id, round(k, 6) as scale, round(greatest(-6.5 + w * k / 2, least(6.5 - w * k / 2, x)), 6) as x, round(greatest(-3.5 + h * k / 2, least(3.5 - h * k / 2, y)), 6) as y from s""")
def fitted_boxes(t):
    i = F.col("event_id")
    f = layout.fitted((1 + i % 20).cast("double"), (1 + i % 9).cast("double"), (i * 7 % 23 - 11).cast("double"), (i * 5 % 13 - 6).cast("double"), 13.0, 7.0)
    return t.events.select("event_id", f.alias("f")).select("event_id", "f.*")


@query("""with s as (select call_id, lower(trim(coalesce(kind, ''))) as kind, lower(trim(prompt)) as words from (select distinct call_id, kind, prompt from llm_calls))
    select call_id, case when kind = 'comparison' or contains(words, 'comparison') or contains(words, 'side-by-side') or contains(words, 'versus') or contains(words, 'vs') then 'comparison'
    when kind = 'text' and call_id % 2 = 0 or contains(words, 'title card') or words = 'centered text' then 'text'
    when contains(words, 'flow') or contains(words, 'process') or contains(words, 'left-to-right') or contains(words, 'left to right') or contains(words, 'diagram') then 'connected' else 'text' end as mode from s""")
def layout_modes(t):
    c = t.llm_calls.select("call_id", "kind", "prompt").distinct()
    return c.select("call_id", layout.mode(F.when(F.col("call_id") % 2 == 0, F.col("kind")), F.col("prompt")).alias("mode"))


@query("""select distinct c.run_id as scene, 'passage' as kind, e.id as target from (select run_id, unnest(evidence_ids) as id from script_sections) e join (select distinct run_id from script_sections) c using (run_id)
    where e.id not in (select 'P' || k from (select unnest(range(1, 9)) as k))""")
def scene_references(t):
    """References of scripts to passages, of which only the first eight are elements of their scene."""
    scenes = t.script_sections.select(F.col("run_id").alias("scene")).distinct()
    elements = scenes.select("scene", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select("scene", F.concat(F.lit("P"), F.col("k").cast("string")).alias("id"))
    used = t.script_sections.select(F.col("run_id").alias("scene"), F.lit("passage").alias("kind"), F.explode("evidence_ids").alias("target"))
    return layout.reference_problems(elements, used)


@query("""with a as (select run_id as scene, coalesce(section_index, 0) as o, evidence_ids as t from script_sections)
    select scene, 'order twice' as problem from a group by scene having count(*) <> count(distinct o) union all select scene, 'no target' from a group by scene having max((coalesce(len(t), 0) = 0)::int) = 1""")
def scene_actions(t):
    a = t.script_sections.select(F.col("run_id").alias("scene"), F.coalesce("section_index", F.lit(0)).alias("action_order"), F.col("evidence_ids").alias("targets"))
    return layout.action_problems(a)


_CLOCK = "(select distinct call_id, run_id, seq, duration_seconds from llm_calls where duration_seconds > 0)"


@query(f"""with b as (select run_id, row_number() over (partition by run_id order by seq, call_id) as beat, round(duration_seconds, 1) as d, round(duration_seconds * (0.8 + call_id % 5 * 0.1), 1) as a from {_CLOCK}),
    e as (select *, sum(d) over w as expected from b window w as (partition by run_id order by beat rows unbounded preceding)),
    r as (select x.run_id, x.beat, x.expected, max(y.expected + coalesce(z.s, 0)) as latest from e x join e y on x.run_id = y.run_id and y.beat <= x.beat
        left join lateral (select sum(q.a) as s from e q where q.run_id = x.run_id and q.beat > y.beat and q.beat <= x.beat) z on true group by all),
    f as (select e.run_id, e.beat, e.expected, (select sum(q.a) from e q where q.run_id = e.run_id and q.beat <= e.beat) as played from e)
    select r.run_id, r.beat, round(r.expected, 3) as expected_end, round(greatest(r.latest, f.played) - r.expected, 3) > 1 as late from r join f using (run_id, beat)""")
def beat_clock(t):
    """Whether each call of a run, as a beat, ends more than a second behind its schedule."""
    w = Window.partitionBy("run_id").orderBy("seq", "call_id")
    c = t.llm_calls.where("duration_seconds > 0").select("call_id", "run_id", "seq", "duration_seconds").distinct()
    beats = c.select(F.col("run_id").alias("section"), F.row_number().over(w).alias("beat"), F.round("duration_seconds", 1).alias("duration"), F.round(F.col("duration_seconds") * (0.8 + F.col("call_id") % 5 * 0.1), 1).alias("animation"))
    r = storyboard.clock(beats).select(F.col("section").alias("run_id"), F.explode("report").alias("r"))
    return r.select("run_id", F.col("r.beat").cast("long").alias("beat"), F.col("r.expected_end").alias("expected_end"), (F.col("r.overrun") > 1).alias("late"))


@query("""with r as (select run_id, seq as beat, 0.01 * (call_id % 7) as start, round(duration_seconds, 2) as d, (call_id % 23) / 10.0 as overrun, call_id from (select distinct call_id, run_id, seq, duration_seconds from llm_calls where duration_seconds > 0)),
    n as (select run_id, row_number() over (partition by run_id order by beat, call_id) as beat, start, d, overrun::double as overrun from r),
    g as (select run_id, max(start) as start, max(overrun) as worst, arg_max(beat, (overrun, -beat)) as worst_beat from n group by run_id)
    select run_id, case when start > 0.05 then 'started late' when worst > 1 then 'too long' end as problem, case when start > 0.05 then null when worst > 1 then worst_beat end as beat, worst from g""")
def beat_reports(t):
    c = t.llm_calls.where("duration_seconds > 0").select("call_id", "run_id", "seq", "duration_seconds").distinct()
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "call_id"))
    total = F.sum("duration").over(Window.partitionBy("section").orderBy("beat"))
    b = c.select(F.col("run_id").alias("section"), n.alias("beat"), F.round("duration_seconds", 2).alias("duration"), (F.col("call_id") % 7 * 0.01).alias("start"), (F.col("call_id") % 23 / 10.0).alias("overrun")).withColumn("expected_end", total)
    r = storyboard.report_problem(b.select("section", "beat", "start", "expected_end", "overrun"), b.select("section", "beat", "duration"))
    return r.select(F.col("section").alias("run_id"), "problem", F.col("beat").cast("long").alias("beat"), "worst")


@query("""with i as (select run_id as section, seq as beat, call_id as position, label || case when error is null then '' else ' ' || error end as issue from (select distinct call_id, run_id, seq, label, error from llm_calls)),
    g as (select section, issue, min((beat, position)) as first, count(*) as n, min(beat) as low, max(beat) as high from i group by all),
    r as (select *, row_number() over (partition by section order by first, issue) as line_no, count(*) over (partition by section) as total from g)
    select section, line_no, case when line_no = 7 then 'and ' || (total - 6) || ' more' when n = 1 then 'Beat ' || low || ': ' || issue else 'Beats ' || low || '-' || high || ': ' || issue end as line from r where line_no <= 7""")
def issue_lines(t):
    issue = F.concat("label", F.when(F.col("error").isNull(), "").otherwise(F.concat(F.lit(" "), "error")))
    i = t.llm_calls.select("call_id", "run_id", "seq", "label", "error").distinct().select(F.col("run_id").alias("section"), F.col("seq").alias("beat"), F.col("call_id").alias("position"), issue.alias("issue"))
    return storyboard.issue_lines(i).select("section", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""select run_id as section, arg_min(call_id, (error is not null, length(coalesce(output, '')) % 5, coalesce(duration_seconds, 0), call_id)) as attempt from (select distinct call_id, run_id, error, output, duration_seconds from llm_calls) group by run_id""")
def best_attempts(t):
    c = t.llm_calls.select("call_id", "run_id", "error", "output", "duration_seconds").distinct()
    a = c.select(F.col("run_id").alias("section"), F.col("call_id").alias("attempt"), F.col("error").isNotNull().alias("late"), (F.length(F.coalesce("output", F.lit(""))) % 5).alias("issues"), F.coalesce("duration_seconds", F.lit(0.0)).alias("overrun"))
    return storyboard.best_attempt(a)


@query("""with p as (select section_id, run_id, part_name, section_title, narration from script_sections), k as (select * from p where part_name = 'section' or coalesce(trim(narration), '') <> '')
    select section_id, (row_number() over (partition by run_id order by section_id) - 1)::int as i from k""")
def render_sections(t):
    p = t.script_sections.select(F.col("run_id").alias("lesson"), F.col("section_id").alias("place"), "part_name", F.col("section_id").cast("string").alias("title"), F.col("narration").alias("text"))
    return script.render_sections(p).select(F.col("title").cast("long").alias("section_id"), "i")


@query("""with r as (select call_id, output as tracer, [1 + call_id % 5, 2 + call_id % 3, 9 - call_id % 4]::int[] as v from (select distinct call_id, output from llm_calls where label like 'route%'))
    select call_id, case when tracer in ('linear_search', 'bubble_sort', 'insertion_sort') or tracer = 'binary_search' and v[1] <= v[2] and v[2] <= v[3] then 'trace' else 'codegen' end as path,
    case when tracer = 'linear_search' or tracer = 'binary_search' and v[1] <= v[2] and v[2] <= v[3] then v[3] end as target,
    case when tracer is null or tracer not in ('linear_search', 'bubble_sort', 'insertion_sort', 'binary_search') then 'unknown tracer' when tracer = 'binary_search' and not (v[1] <= v[2] and v[2] <= v[3]) then 'values not sorted' end as warning from r""")
def resolved_routes(t):
    """Routes that calls chose, with arrays that follow from their ids."""
    i = F.col("call_id")
    r = t.llm_calls.where("label like 'route%'").select("call_id", "output").distinct()
    values = F.array((1 + i % 5).cast("int"), (2 + i % 3).cast("int"), (9 - i % 4).cast("int"))
    known = {"linear_search": True, "binary_search": True, "bubble_sort": False, "insertion_sort": False}
    x = script.resolved_route(F.lit("trace"), F.col("output"), values, F.lit(None).cast("int"), known)
    return r.select("call_id", x.alias("x")).select("call_id", "x.path", "x.target", "x.warning")


@query("""with s as (select distinct run_id as lesson, seq as i from llm_calls), r as (select distinct run_id as lesson, seq as i, kind as path from llm_calls where call_id % 6 <> 0 or seq > 0),
    w as (select lesson from (select lesson, list_sort(list(i)) as want from s group by lesson) join (select lesson, list_sort(list(i)) as have from r group by lesson) using (lesson) where want = have)
    select s.lesson, s.i, case when w.lesson is not null then r.path else 'codegen' end as path from s left join w using (lesson) left join r on r.lesson = s.lesson and r.i = s.i""")
def section_routes(t):
    c = t.llm_calls.select(F.col("run_id").alias("lesson"), F.col("seq").alias("i"), F.col("kind").alias("path"), "call_id")
    return script.routed(c.select("lesson", "i").distinct(), c.where("call_id % 6 <> 0 or i > 0").select("lesson", "i", "path").distinct())


@query("""with a as (select distinct run_id as section, case call_id % 3 when 0 then 'trace' when 1 then 'codegen' else 'slideshow' end as path, call_id % 3 as o, error is null as ok from llm_calls),
    b as (select section, min(o) filter (where ok) as best from a group by section)
    select section, case coalesce(best, 2) when 0 then 'trace' when 1 then 'codegen' else 'slideshow' end as path, coalesce((select string_agg(distinct a.path, ',' order by a.path desc) from a where a.section = b.section and not a.ok and a.o < coalesce(b.best, 2)), '') as warnings from b""")
def render_outcomes(t):
    path = F.when(F.col("call_id") % 3 == 0, "trace").when(F.col("call_id") % 3 == 1, "codegen").otherwise("slideshow")
    a = t.llm_calls.select(F.col("run_id").alias("section"), path.alias("path"), F.col("error").isNull().alias("ok")).distinct()
    return script.outcome(a).select("section", "path", F.array_join("warnings", ",").alias("warnings"))


def _arrays(t: Data):
    c = F.col("created_at")
    return t.rag_documents.select("document_id", F.array(F.month(c), F.dayofmonth(c), F.hour(c)).alias("a"), F.dayofmonth(c).alias("b"))


def _trace(t: Data, name: str, arrays):
    traces.register(t.spark)
    arrays.createOrReplaceTempView("traced_arrays")
    return t.spark.sql(f"select v.document_id, s.* from traced_arrays v, lateral trace_{name}(v.a, v.b) s")


@query("""with v as (select document_id, [month(created_at), day(created_at), hour(created_at)]::int[] as a, day(created_at)::int as b from rag_documents), p as (select *, list_position(a, b) as hit from v),
    s as (select document_id, 0 as step, 'start' as event, null as found from p union all select document_id, k, case when k = hit then 'found' else 'compare' end, case when k = hit then k - 1 end from p, (select unnest(range(1, 4)) as k) where k <= hit)
    select document_id, step::int as step, event, found::int as found from s""")
def trace_linear_search(t):
    return _trace(t, "linear_search", _arrays(t)).select("document_id", "step", "event", "found")


@query()
def trace_steps(t):
    a = _arrays(t)
    out = None
    for name in ("binary_search", "bubble_sort", "insertion_sort"):
        traces.register(t.spark)
        view = f"arrays_of_{name}"
        (a.withColumn("a", F.array_sort("a")) if name == "binary_search" else a).createOrReplaceTempView(view)
        one = t.spark.sql(f"select '{name}' as tracer, v.document_id, s.step, cast(s.values as string) as state, s.event, s.found from {view} v, lateral trace_{name}(v.a, v.b) s")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with v as (select document_id, [month(created_at), day(created_at), hour(created_at)]::int[] as a from rag_documents)
    select document_id, a[1] <= a[2] and a[2] <= a[3] as ascending from v""")
def ascending_arrays(t):
    return _arrays(t).select("document_id", traces.ascending(F.col("a")).alias("ascending"))


@query("""with v as (select document_id, [month(created_at), day(created_at), hour(created_at)]::int[] as a, day(created_at)::int as b from rag_documents), p as (select document_id, list_position(a, b) as hit from v),
    c as (select document_id, hit, k - 1 as cell, s as step from p, (select unnest(range(1, 4)) as k), (select unnest(range(0, 4)) as s) where s <= hit)
    select document_id, step::int as step, cell::int as cell, case when step = hit and cell = step - 1 then 'found' when step > 0 and cell = step - 1 then 'highlight' else 'normal' end as role, case when step > 0 and cell < step - 1 then 0.3::double else 1.0::double end as opacity from c""")
def cell_roles(t):
    s = _trace(t, "linear_search", _arrays(t)).select("document_id", "step", "found", "highlighted", "sorted", "dimmed", F.posexplode("values").alias("cell", "value"))
    c = F.col("cell")
    return s.select("document_id", "step", "cell", traces.cell_role(c, F.col("found"), F.col("highlighted"), F.col("sorted")).alias("role"), traces.cell_opacity(c, F.col("dimmed")).alias("opacity"))


@query("""with v as (select document_id, [month(created_at), day(created_at), hour(created_at)]::int[] as a, day(created_at)::int as b from rag_documents), p as (select document_id, list_position(a, b) as hit from v),
    s as (select document_id, k as step, hit from p, (select unnest(range(1, 4)) as k) where k <= hit)
    select document_id, step::int as step, case when step = 1 then 'add' else 'move' end as op, 'i' as name, (step - 1)::int as a from s union all select document_id, step::int, 'found', null, (step - 1)::int from s where step = hit""")
def array_changes(t):
    return traces.changes(_trace(t, "linear_search", _arrays(t)), "document_id").select("document_id", "step", "op", "name", "a")


@query()
def code_problems(t):
    """What is wrong with the scene code that calls returned."""
    c = t.llm_calls.where("label like 'scene code%' and output is not null").select("call_id", "output").distinct()
    return c.select("call_id", F.array_join(code.code_problems(code.unfenced(F.col("output"))), "; ").alias("problems"))


@query("""with s as (select block_id, case when ordinal % 3 = 0 then ' ' else caption end as own, [trim(left(text, 20), ' '), ' ', trim(substr(text, 21, 10), ' ')] as parts from rag_document_blocks)
    select block_id, case when trim(coalesce(own, ''), ' ') <> '' then trim(own, ' ') when array_to_string(list_filter(parts, lambda x: trim(x, ' ') <> ''), ' ') <> '' then array_to_string(list_filter(parts, lambda x: trim(x, ' ') <> ''), ' ') end as caption from s""")
def captions(t):
    own = F.when(F.col("ordinal") % 3 == 0, F.lit(" ")).otherwise(F.col("caption"))
    return t.rag_document_blocks.select("block_id", T.caption(own, F.array(F.substring("text", 1, 20), F.lit(" "), F.substring("text", 21, 10))).alias("caption"))


@query("""with c as (select distinct run_id, seq, call_id, label, prompt from llm_calls), s as (select run_id, row_number() over (partition by run_id order by seq, call_id) - 1 as i, label from c),
    n as (select run_id, count(*) as k from s group by run_id), ok as (select run_id, k, k >= 2 and ascii(run_id) % 2 = 0 as told from n)
    select s.run_id as section, case when told then i // 2 else i end::bigint as segment, min(case when told then 'part ' || (i // 2) else label end) as text, count(*) as steps, not told as fallback from s join ok using (run_id) where not told or true group by all""")
def step_narrations(t):
    """Calls of a run as steps: told two at a time in every second run, else by their labels."""
    c = t.llm_calls.select("run_id", "seq", "call_id", "label").distinct()
    steps = c.select(F.col("run_id").alias("section"), (F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "call_id")) - 1).alias("i"), F.col("label").alias("event"))
    n = steps.groupBy("section").agg(F.count("*").cast("int").alias("k")).where((F.ascii("section") % 2 == 0) & (F.col("k") >= 2))
    told = n.select("section", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i % 2 == 1).alias("grouped"), F.transform(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / 2).cast("int")), lambda i: F.concat(F.lit("part "), i.cast("string"))).alias("sentences"))
    r = timeline.narrated(steps, told)
    return r.select("section", F.col("segment").cast("long").alias("segment"), "text", F.size("steps").cast("long").alias("steps"), "fallback")


@query()
def storyboard_texts(t):
    """Beats of every narration: two sentences at a time where their number is even, else by the fallback."""
    s = t.script_sections.select(F.col("section_id").alias("section"), "narration", F.coalesce("section_title", F.lit("Part")).alias("title"))
    parts = s.select("section", F.posexplode(storyboard.story_sentences(F.coalesce("narration", F.lit("")))).alias("i", "sentence"))
    beats = parts.where("i % 2 = 0").select("section", F.floor(F.col("i") / 2).cast("int").alias("beat"), F.lit(2).alias("sentence_count"), F.lit("shown").alias("visual"))
    return storyboard.beats_or_fallback(s, parts, beats).select(F.col("section").alias("section_id"), F.size("texts").alias("beats"))
