"""Blocks of parsed papers: types, roles, section paths, lost pages, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parser labels and the block types they stand for.
TYPES = {
    "title": "title", "section_header": "heading", "heading": "heading", "header": "heading", "text": "paragraph", "paragraph": "paragraph", "formula_text": "paragraph",
    "list_item": "list_item", "listitem": "list_item", "table": "table", "picture": "figure", "figure": "figure", "formula": "equation", "equation": "equation",
    "caption": "caption", "footnote": "footnote", "code": "code",
}
#: Words before an author's name, and words that name an institution.
HONORIFICS = ("prof", "professor", "dr", "mr", "mrs", "ms", "mx")
INSTITUTIONS = ("department", "college", "university", "institute", "faculty", "school", "laboratory", "laboratories", "research center", "research centre")
STRUCTURAL = ("figure", "table", "equation")
DEEPEST = 6


def label_key(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("_"))


def block_type(label: Column) -> Column:
    key, out = label_key(label), F.lit("other")
    for kind in dict.fromkeys(TYPES.values()):
        out = F.when(key.isin(*(k for k, v in TYPES.items() if v == kind)), kind).otherwise(out)
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def looks_like_author(text: Column) -> Column:
    """Two to five capitalised names or initials, after an honorific if there is one."""
    words = words_of(text)
    first = F.lower(F.regexp_replace(F.coalesce(F.get(words, 0), F.lit("")), r"\.$", ""))
    words = F.when(first.isin(*HONORIFICS) & (F.size(words) > 1), F.slice(words, 2, F.size(words))).otherwise(words)
    initial = lambda w: w.rlike(r"^[A-Z]\.$")
    name = lambda w: w.rlike(r"^[A-Z]") & ~F.substring(w, 2, 1000).rlike(r"[^A-Za-z'’-]")
    return F.size(words).between(2, 5) & F.forall(words, lambda w: initial(w) | name(w))


def looks_like_affiliation(text: Column) -> Column:
    """Whether a word of the text names an institution."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+", " "), F.lit(" "))
    out = F.lit(False)
    for w in INSTITUTIONS:
        out = out | F.contains(words, F.lit(f" {w} "))
    return out


def metadata_roles(blocks: DataFrame) -> DataFrame:
    """document_id, ordinal, role of titles, and of the authors and affiliations after them.

    A label of title is one; a heading of four words and twenty characters is one when the next two blocks with text look
    like authors and an affiliation.
    """
    w = Window.partitionBy("document_id").orderBy("ordinal")
    t = blocks.where(F.trim("text") != "").select("document_id", "ordinal", label_key(F.col("source_label")).alias("label"), F.trim("text").alias("text"))
    t = t.select("*", *(F.lead(c, k).over(w).alias(f"{c}{k}") for c in ("text", "ordinal") for k in (1, 2)))
    explicit = F.col("label") == "title"
    candidate = explicit | (F.col("label") == "section_header") & (F.size(words_of(F.col("text"))) >= 4) & (F.length("text") >= 20)
    cluster = candidate & F.coalesce(looks_like_author(F.col("text1")) & looks_like_affiliation(F.col("text2")), F.lit(False)) & F.col("ordinal2").isNotNull()
    role = lambda o, r, on: F.when(on, F.struct(F.col(o).alias("ordinal"), F.lit(r).alias("role"), F.col("ordinal").alias("of")))
    found = t.select("document_id", F.explode(F.array_compact(F.array(role("ordinal", "title", explicit | cluster), role("ordinal1", "author", cluster), role("ordinal2", "affiliation", cluster)))).alias("x"))
    # a block that several clusters claim has the role of the last one
    return found.groupBy("document_id", "x.ordinal").agg(F.max_by("x.role", F.struct("x.of", "x.role")).alias("role"))


def section_paths(blocks: DataFrame) -> DataFrame:
    """document_id, ordinal, path: the open headings above each block, by level; metadata blocks have none.

    A heading of level L closes those of level L and deeper, even one without text.  Per level, the last heading counts if no
    shallower one came later.
    """
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    meta = F.coalesce(F.col("is_document_metadata"), F.lit(False))
    level = F.greatest(F.lit(1), F.least(F.lit(DEEPEST), F.coalesce("heading_level", F.lit(1))))
    b = blocks.withColumn("lv", F.when((F.col("block_type") == "heading") & ~meta, level))
    cols = []
    for k in range(1, DEEPEST + 1):
        at = F.max(F.when(F.col("lv") == k, F.struct("ordinal", "text"))).over(w)
        closed = F.max(F.when(F.col("lv") < k, F.col("ordinal"))).over(w) if k > 1 else F.lit(None).cast("int")
        cols.append(F.when((closed.isNull() | (at["ordinal"] > closed)) & (F.trim(at["text"]) != ""), at["text"]).alias(f"h{k}"))
    path = F.array_compact(F.array(*(f"h{k}" for k in range(1, DEEPEST + 1))))
    return b.select("document_id", "ordinal", meta.alias("meta"), *cols).select("document_id", "ordinal", F.when(F.col("meta"), F.array().cast("array<string>")).otherwise(path).alias("path"))


def positive(number: Column) -> Column:
    """A whole number above zero, else null."""
    n = number.try_cast("int")
    return F.when(n > 0, n)


def parsed(items: DataFrame) -> DataFrame:
    """Blocks of items(document_id, ordinal, source_label, text, caption, table_text, level, page_number) of a parser.

    Types by label, roles by the patterns of titles; a table shows its own text, a figure none that repeats its caption; items
    without text go unless they are structural or a captioned figure, and the ordinals keep their gaps.
    """
    roles = metadata_roles(items)
    b = items.join(roles, ["document_id", "ordinal"], "left")
    kind = block_type(F.col("source_label"))
    kind = F.when(F.col("role") == "title", "title").when((F.col("role") == "affiliation") & (kind == "heading"), "other").otherwise(kind)
    text, caption = F.coalesce("text", F.lit("")), F.col("caption")
    shown = F.when(kind == "table", F.coalesce(F.when(F.trim("table_text") != "", F.col("table_text")), text)).when((kind == "figure") & F.coalesce(text == caption, F.lit(False)), F.lit("")).otherwise(text)
    b = b.select("document_id", "ordinal", kind.alias("block_type"), "source_label", F.trim(shown).alias("text"), "caption", positive(F.col("page_number")).alias("page_number"),
                 F.when(kind == "heading", F.coalesce(positive(F.col("level")), F.lit(1))).alias("heading_level"), F.col("role").isNotNull().alias("is_document_metadata"), "role")
    b = b.join(section_paths(b).withColumnRenamed("path", "section_path"), ["document_id", "ordinal"])
    return b.where((F.col("text") != "") | F.col("block_type").isin(*STRUCTURAL))


def front_matter(blocks: DataFrame) -> DataFrame:
    """document_id, title, authors, affiliations from blocks(document_id, ordinal, text, role)."""
    listed = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("ordinal", "text")))), lambda x: x["text"])
    return blocks.groupBy("document_id").agg(F.min_by(F.when(F.col("role") == "title", F.col("text")), F.when((F.col("role") == "title") & (F.col("text") != ""), F.col("ordinal"))).alias("title"), listed("author").alias("authors"), listed("affiliation").alias("affiliations"))


def unreadable(blocks: DataFrame) -> DataFrame:
    """document_id of documents without a block that has text."""
    return blocks.groupBy("document_id").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n")).where("n = 0").select("document_id")


def lost_pages(layer: DataFrame, blocks: DataFrame, least: int = 300, share: float = 0.25) -> DataFrame:
    """document_id, page_number of pages whose text layer has ``least`` letters and digits but whose blocks hold under ``share``."""
    got = blocks.groupBy("document_id", "page_number").agg(F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("chars"))
    return layer.join(got, ["document_id", "page_number"], "left").where((F.col("layer_chars") >= least) & (F.coalesce("chars", F.lit(0)) < share * F.col("layer_chars"))).select("document_id", "page_number")


def content_text(block_kind: Column, text: Column, caption: Column) -> Column:
    """What a block says: a figure its caption where the text hasn't it, a table its caption first, others their text."""
    t, c = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), F.btrim(F.coalesce(caption, F.lit("")), F.lit(" \t\n\r"))
    apart = (c != "") & ~F.contains(t, c)
    return F.when((block_kind == "figure") & apart, c).when((block_kind == "table") & apart, F.btrim(F.concat(F.lit("Table caption: "), c, F.lit("\n"), t), F.lit(" \t\n\r"))).otherwise(t)


def violations(blocks: DataFrame) -> DataFrame:
    """block_id, problem of blocks that break a constraint of the table."""
    w = Window.partitionBy("document_id", "ordinal")
    b = blocks.withColumn("same", F.count("*").over(w))
    rules = {"negative ordinal": F.col("ordinal") < 0, "page not positive": F.col("page_number") <= 0, "ordinal twice": F.col("same") > 1}
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return b.select("block_id", F.explode(found).alias("problem"))
