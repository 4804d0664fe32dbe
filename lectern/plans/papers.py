"""Registered queries over papers: parsing, chunks, storage, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import chunking, store
from lectern.plans.base import QUERIES, SQL, query  # noqa: F401

TYPE_SQL = """case replace(lower(source_label), ' ', '_') when 'title' then 'title' when 'section_header' then 'heading' when 'heading' then 'heading' when 'header' then 'heading'
    when 'text' then 'paragraph' when 'paragraph' then 'paragraph' when 'formula_text' then 'paragraph' when 'list_item' then 'list_item' when 'listitem' then 'list_item' when 'table' then 'table'
    when 'picture' then 'figure' when 'figure' then 'figure' when 'formula' then 'equation' when 'equation' then 'equation' when 'caption' then 'caption' when 'footnote' then 'footnote'
    when 'code' then 'code' else 'other' end"""
ROLE_SQL = r"""with b as (select document_id, ordinal, source_label, trim(text) as text, lead(trim(text), 1) over w as t1, lead(trim(text), 2) over w as t2, lead(ordinal, 1) over w as o1, lead(ordinal, 2) over w as o2
    from rag_document_blocks where trim(text) <> '' window w as (partition by document_id order by ordinal)),
    k as (select *, replace(lower(source_label), ' ', '_') as label, regexp_replace(t1, '^(?:[Pp]rofessor|[Pp]rof|[Dd]r|[Mm]r|[Mm]rs|[Mm]s|[Mm]x)\.?\s+', '') as name from b),
    h as (select *, label = 'title' as explicit, coalesce((label = 'title' or label = 'section_header' and len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 4 and length(text) >= 20)
    and regexp_matches(name, '^(?:[A-Z][A-Za-z''’-]*|[A-Z]\.)(?:\s+(?:[A-Z][A-Za-z''’-]*|[A-Z]\.)){1,4}$')
    and regexp_matches(t2, '(?i)\b(?:department|college|university|institute|faculty|school|laborator(?:y|ies)|research\s+cent(?:er|re))\b'), false) as cluster from k),
    r as (select document_id, ordinal, 'title' as role, ordinal as of_ from h where explicit or cluster union all select document_id, o1, 'author', ordinal from h where cluster union all select document_id, o2, 'affiliation', ordinal from h where cluster)
    select document_id, ordinal, role from r qualify row_number() over (partition by document_id, ordinal order by of_ desc, role desc) = 1"""
PATH_SQL = """with b as (select document_id, ordinal, text, coalesce(is_document_metadata, false) as meta, block_type = 'heading' and not coalesce(is_document_metadata, false) as is_h, greatest(1, least(6, coalesce(heading_level, 1))) as lv from rag_document_blocks),
    n as (select b.document_id, b.ordinal, h.ordinal as ho, h.lv, h.text, min(h.lv) over (partition by b.document_id, b.ordinal order by h.ordinal desc rows between unbounded preceding and 1 preceding) as lower_later
    from b join b h on b.document_id = h.document_id and h.is_h and h.ordinal <= b.ordinal)
    select b.document_id, b.ordinal, case when any_value(b.meta) then '' else coalesce(string_agg(n.text, ' > ' order by n.ho) filter (where (n.lower_later is null or n.lower_later > n.lv) and trim(n.text) <> ''), '') end as path
    from b left join n using (document_id, ordinal) group by b.document_id, b.ordinal"""


@query(f"select block_id, {TYPE_SQL} as kind from rag_document_blocks")
def block_types(t):
    return t.rag_document_blocks.select("block_id", B.block_type(F.col("source_label")).alias("kind"))


@query(ROLE_SQL)
def metadata_roles(t):
    return B.metadata_roles(t.rag_document_blocks)


@query(PATH_SQL)
def section_path(t):
    return B.section_paths(t.rag_document_blocks).select("document_id", "ordinal", F.array_join("path", " > ").alias("path"))


def _items(t):
    """Blocks as a parser's items; every seventh ordinal loses its page, every eleventh its text."""
    b = t.rag_document_blocks
    o = F.col("ordinal")
    return b.select(
        "document_id", "ordinal", "source_label", F.when(o % 11 == 0, F.lit(" ")).when(o % 5 == 0, F.coalesce("caption", "text")).otherwise(F.col("text")).alias("text"), "caption",
        F.when(o % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("| "), "text")).alias("table_text"), F.col("heading_level").cast("string").alias("level"),
        F.when(o % 7 == 0, F.lit("0")).when(o % 13 == 0, F.lit("x")).otherwise(F.col("page_number").cast("string")).alias("page_number"),
    )


@query(f"""with i as (select document_id, ordinal, source_label, case when ordinal % 11 = 0 then ' ' when ordinal % 5 = 0 then coalesce(caption, text) else text end as text, caption,
    case when ordinal % 2 = 0 then ' ' else '| ' || text end as table_text, case when ordinal % 7 = 0 then '0' when ordinal % 13 = 0 then 'x' else page_number::varchar end as page_number from rag_document_blocks),
    k as (select document_id, ordinal, {TYPE_SQL} as kind, text, caption, table_text, try_cast(page_number as int) as page from i),
    s as (select document_id, ordinal, kind, trim(case when kind = 'table' then case when trim(table_text) <> '' then table_text else text end when kind = 'figure' and text = caption then '' else coalesce(text, '') end) as text, case when page > 0 then page end as page_number from k)
    select document_id, ordinal, sha256(text) as sha, page_number from s where text <> '' or kind in ('figure', 'table', 'equation')""")
def parsed_blocks(t):
    b = B.parsed(_items(t))
    return b.select("document_id", "ordinal", F.sha2("text", 256).alias("sha"), "page_number")


@query(f"""with r as ({ROLE_SQL}), j as (select b.document_id, b.ordinal, b.text, r.role from rag_document_blocks b left join r using (document_id, ordinal))
    select document_id, arg_min(text, ordinal) filter (where role = 'title' and text <> '') as title, coalesce(string_agg(text, '; ' order by ordinal) filter (where role = 'author'), '') as authors,
    coalesce(string_agg(text, '; ' order by ordinal) filter (where role = 'affiliation'), '') as affiliations from j group by document_id""")
def front_matter(t):
    b = t.rag_document_blocks.select("document_id", "ordinal", "text").join(B.metadata_roles(t.rag_document_blocks), ["document_id", "ordinal"], "left")
    return B.front_matter(b).select("document_id", "title", F.array_join("authors", "; ").alias("authors"), F.array_join("affiliations", "; ").alias("affiliations"))


@query("""select document_id from (select document_id, case when substr(sha256(document_id), 1, 1) = '0' then ' ' else text end as text from rag_document_blocks) group by document_id having count(*) filter (where trim(coalesce(text, '')) <> '') = 0""")
def unreadable_papers(t):
    text = F.when(F.substring(F.sha2("document_id", 256), 1, 1) == "0", " ").otherwise(F.col("text"))
    return B.unreadable(t.rag_document_blocks.select("document_id", text.alias("text")))


@query("""select block_id, sha256(case when block_type = 'figure' and c <> '' and strpos(x, c) = 0 then c when block_type = 'table' and c <> '' and strpos(x, c) = 0 then trim('Table caption: ' || c || chr(10) || x, e' \\t\\n\\r') else x end) as sha
    from (select block_id, block_type, trim(coalesce(text, ''), e' \\t\\n\\r') as x, trim(coalesce(caption, ''), e' \\t\\n\\r') as c from rag_document_blocks)""")
def block_content(t):
    return t.rag_document_blocks.select("block_id", F.sha2(B.content_text(F.col("block_type"), F.col("text"), F.col("caption")), 256).alias("sha"))


@query("""with b as (select block_id, document_id, ordinal // 2 - 1 as ordinal, page_number % 5 as page_number from rag_document_blocks)
    select block_id, 'negative ordinal' as problem from b where ordinal < 0 union all select block_id, 'page not positive' from b where page_number <= 0
    union all select block_id, 'ordinal twice' from (select block_id, count(*) over (partition by document_id, ordinal) as n from b) where n > 1""")
def block_violations(t):
    """Of ordinals that are halved and pages that are wrapped, so that every rule is broken somewhere."""
    b = t.rag_document_blocks.select("block_id", "document_id", (F.floor(F.col("ordinal") / 2) - 1).alias("ordinal"), (F.col("page_number") % 5).alias("page_number"))
    return B.violations(b)


@query()
def chunk_documents(t):
    return chunking.chunk(t.rag_document_blocks, documents=t.rag_documents)


@query()
def chunk_summary(t):
    return chunking.summary(chunking.packed(t.rag_document_blocks))


@query("""with c as (select chunk_id, document_id, token_count_estimate, page_start, page_end - sequence_index % 3 as page_end from rag_document_chunks),
    l as (select distinct chunk_id, block_id from rag_chunk_source_blocks where link_type = 'source' and block_id >= '4')
    select chunk_id, 'too large' as problem from c where token_count_estimate > 801 union all select chunk_id, 'no source' from c where chunk_id not in (select chunk_id from l)
    union all select chunk_id, 'pages reversed' from c where page_end < page_start
    union all select distinct l.chunk_id, 'unknown source' from l join c using (chunk_id) left join (select document_id, block_id from rag_document_blocks where block_id < 'e') b on b.block_id = l.block_id and b.document_id = c.document_id where b.block_id is null""")
def chunk_problems(t):
    """Of stored chunks whose last pages are moved and whose sources are thinned, so that every rule is broken somewhere."""
    ids = t.rag_chunk_source_blocks.where("link_type = 'source' and block_id >= '4'").groupBy("chunk_id").agg(F.collect_set("block_id").alias("source_ids"))
    c = t.rag_document_chunks.select("chunk_id", "document_id", "token_count_estimate", "page_start", (F.col("page_end") - F.col("sequence_index") % 3).alias("page_end")).join(ids, "chunk_id", "left")
    return chunking.problems(c.withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))), t.rag_document_blocks.where("block_id < 'e'"))


@query("""with h as (select document_id, count(*) filter (where block_type <> 'heading' and (trim(coalesce(text, '') || coalesce(caption, ''), e' \\t\\n\\r') <> '' or block_type in ('figure', 'table', 'equation'))) as n from rag_document_blocks where not coalesce(is_document_metadata, false) group by document_id)
    select document_id, true as chunked from h where n > 0""")
def chunked_papers(t):
    c = chunking.packed(t.rag_document_blocks).where(F.col("place") < 1 << 40)
    return c.select("document_id", F.lit(True).alias("chunked")).distinct()


@query()
def chunk_links(t):
    return chunking.links(chunking.chunk(t.rag_document_blocks))


@query("""select chunk_id, block_id, link_type, min(source_position)::int as source_position from rag_chunk_source_blocks group by all""")
def stored_links(t):
    l = t.rag_chunk_source_blocks  # noqa: E741
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("link_type") == kind, F.struct("source_position", "block_id")))), lambda x: x["block_id"])
    c = l.groupBy("chunk_id").agg(listed("source").alias("source_ids"), listed("related").alias("related_element_ids"), F.array_sort(F.collect_list(F.struct("link_type", "source_position", "block_id"))).alias("all"))
    place = c.select("chunk_id", F.explode("all").alias("x")).select("chunk_id", "x.*").groupBy("chunk_id", "block_id", "link_type").agg(F.min("source_position").alias("source_position"))
    return place.join(chunking.links(c).select("chunk_id", "block_id", "link_type"), ["chunk_id", "block_id", "link_type"]).select("chunk_id", "block_id", "link_type", "source_position")


@query("""select chunk_id, array_to_string(list_filter(['page'], lambda x: false), '') || coalesce(nullif(concat_ws(', ', case when page_start is null then null when page_end is null or page_start = page_end then 'page ' || page_start else 'pages ' || page_start || '-' || page_end end,
    case when len(section_path) > 0 then 'section ' || array_to_string(section_path, ' > ') end), ''), '') as label from rag_document_chunks""")
def passage_locations(t):
    return t.rag_document_chunks.select("chunk_id", F.coalesce(T.location(F.col("page_start"), F.col("page_end"), F.col("section_path")), F.lit("")).alias("label"))


@query("""select document_id, case when min(page_start) is null then null when coalesce(max(page_end), max(page_start)) = min(page_start) then 'page ' || min(page_start)
    else 'pages ' || min(page_start) || '-' || coalesce(max(page_end), max(page_start)) end as label from rag_document_chunks group by document_id""")
def page_ranges(t):
    g = t.rag_document_chunks.groupBy("document_id").agg(F.min("page_start").alias("a"), F.coalesce(F.max("page_end"), F.max("page_start")).alias("b"))
    return g.select("document_id", T.page_label(F.col("a"), F.col("b")).alias("label"))


@query("""select chunk_id, 'P' || row_number() over (partition by document_id order by sequence_index, chunk_id) as passage_id from rag_document_chunks where trim(text, e' \\t\\n\\r') <> ''""")
def passage_numbers(t):
    return store.numbered(t.rag_document_chunks.where(F.btrim("text", F.lit(" \t\n\r")) != ""))


@query("""select chunk_id, ((row_number() over (partition by document_id order by sequence_index, chunk_id) - 1) // 8)::int as batch from rag_document_chunks""")
def embedding_batches(t):
    return store.batches(t.rag_document_chunks.select("chunk_id", "document_id", "sequence_index"), ["document_id"], ["sequence_index", "chunk_id"], 8).select("chunk_id", "batch")


@query("""select user_id, document_id, row_number() over (partition by user_id order by created_at desc, document_id) as place from rag_documents""")
def recent_papers(t):
    return store.recent_first(t.rag_documents.select("user_id", "document_id", "created_at"), "user_id", "document_id").select("user_id", "document_id", F.col("place").cast("long").alias("place"))


@query("""with d as (select *, substr(sha256(document_id), 1, 1) < '8' as old from rag_documents), o as (select user_id, source_sha256, min(document_id) as document_id from d where old group by all),
    n as (select user_id, source_sha256, min(document_id) as document_id from d where not old group by all)
    select user_id, source_sha256, coalesce(o.document_id, n.document_id) as document_id, o.document_id is null as created from n left join o using (user_id, source_sha256)""")
def idempotent_insert(t):
    d = t.rag_documents.select("user_id", "source_sha256", "document_id", (F.substring(F.sha2("document_id", 256), 1, 1) < "8").alias("old"))
    return store.inserted(d.where("not old"), d.where("old"), ["user_id", "source_sha256"], "document_id")


@query("""select d.document_id, d.user_id, d.title, d.page_count, count(distinct c.chunk_id) as chunks, count(distinct b.block_id) filter (where b.block_type = 'figure') as figures from rag_documents d
    left join rag_document_chunks c using (document_id) left join rag_document_blocks b using (document_id) group by all""")
def paper_report(t):
    c = t.rag_document_chunks.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    f = t.rag_document_blocks.where("block_type = 'figure'").groupBy("document_id").agg(F.count_distinct("block_id").alias("figures"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return t.rag_documents.select("document_id", "user_id", "title", "page_count").distinct().join(c, "document_id", "left").join(f, "document_id", "left").select("document_id", "user_id", "title", "page_count", zero("chunks"), zero("figures"))


@query("""select block_id, case when d.document_id is null then null else b.document_id end as document_id from rag_document_blocks b left join (select document_id from rag_documents where page_count is not null) d using (document_id)""")
def cleared_references(t):
    gone = t.rag_documents.where("page_count is null").select("document_id")
    b = t.rag_document_blocks.select("block_id", "document_id")
    return store.set_null(b, gone.unionByName(b.select("document_id").distinct().join(t.rag_documents.select("document_id"), "document_id", "left_anti")), "document_id")


@query(r"""select document_id, case when n = '' then 'paper.pdf' else n end as name from (select document_id, left(trim(regexp_replace(regexp_extract(source_filename, '([^/\\]*)$', 1), '[\p{C}\p{Zl}\p{Zp}]', '', 'g')), 255) as n from rag_documents)""")
def display_names(t):
    return t.rag_documents.select("document_id", T.display_name(F.col("source_filename")).alias("name"))


@query(r"""select document_id, regexp_matches(e, '^[^@\s]+@[^@\s]+\.[^@\s]+$') and length(e) <= 254 as valid from (select document_id, lower(trim(user_id || case when document_id < '8' then '@example.org' else ' at home' end)) as e from rag_documents)""")
def email_checks(t):
    e = F.concat("user_id", F.when(F.col("document_id") < "8", "@example.org").otherwise(" at home"))
    return t.rag_documents.select("document_id", T.email_valid(e).alias("valid"))


@query("""select chunk_id, coalesce(section_path[1:len(p.path)] = p.path, false) as below from rag_document_chunks c left join (select document_id, section_path[1:2] as path from rag_document_chunks where len(section_path) > 0
    qualify row_number() over (partition by document_id order by sequence_index, chunk_id) = 1) p using (document_id)""")
def path_prefixes(t):
    """Which passages stand below the section of the document's first passage that has one."""
    c = t.rag_document_chunks.select("chunk_id", "document_id", "sequence_index", "section_path")
    w = Window.partitionBy("document_id").orderBy("sequence_index", "chunk_id")
    first = c.where(F.size("section_path") > 0).withColumn("n", F.row_number().over(w)).where("n = 1").select("document_id", F.slice("section_path", 1, 2).alias("path"))
    return c.join(first, "document_id", "left").select("chunk_id", F.coalesce(F.slice("section_path", 1, F.greatest(F.size("path"), F.lit(0))) == F.col("path"), F.lit(False)).alias("below"))
