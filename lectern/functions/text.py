"""Text scalars as Column expressions; all built-in, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
#: The namespace of derived ids.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else a quarter of its UTF-8 bytes, rounded up; null stays null."""
    return F.ceil(F.octet_length(text) / 4.0).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def query_terms(text: Column, most: int = 64) -> Column:
    """Lower-case words in order of first appearance, the first ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))), 1, most)


def retrieval_text(prefix: Column, text: Column) -> Column:
    """Prefix and text joined by an empty line, or whichever is there."""
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(c)
    return F.concat_ws("\n\n", none(prefix), none(text))


def embedding_input(title: Column, content: Column) -> Column:
    title = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("none")).otherwise(F.trim(title))
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), F.trim(content))


def compact_equation(text: Column) -> Column:
    """Without dollar signs and blanks, with one kind of minus."""
    return F.translate(F.regexp_replace(text, r"[\s$]+", ""), "−–—", "---")


#: What markdown is taken off, in this order, and what stays of it.
MARKDOWN = (
    (r"(?s)```.*?```", " "), (r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
    (r"(?md)^#+\s*", ""), (r"(?md)^\s*[-*+]\s+", ""),
)
#: Abbreviations whose period ends no sentence of a script, longer ones before those they contain.
ABBREVIATIONS = ("Figs.", "Fig.", "Eqn.", "Eq.", "Sec.", "e.g.", "i.e.", "et al.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "cf.", "approx.")
#: Topics that a request names by a word, in this order.
TOPICS = (("photosynthesis", "Photosynthesis"), ("binary search", "Binary Search"), ("binary-search", "Binary Search"), ("sorting", "Sorting"))


def strip_markdown(text: Column) -> Column:
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return text


def claim_sentences(text: Column) -> Column:
    """Sentences of a script: no end after an abbreviation, nor before a small letter; one closing mark may follow the end mark."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for a in ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", "\x00")))
    parts = F.split(t, r"""(?U)(?:(?<=[.!?])|(?<=[.!?]["')\]]))\s+(?=["'(\[]?[^\sa-z"'(\[])""")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.translate(x, "\x00", "."), r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def background_sentences(text: Column) -> Column:
    """Parts after end marks with closing marks and blanks; "e.g." and "i.e." end none."""
    t = F.replace(F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("e.g."), F.lit("e\x00g\x00")), F.lit("i.e."), F.lit("i\x00e\x00"))
    return F.filter(F.transform(F.split(t, r"""(?U)(?<=[.!?])["')\]]*\s+"""), lambda x: F.translate(x, "\x00", ".")), lambda x: F.btrim(x) != "")


def display_name(path: Column, fallback: str = "paper.pdf", most: int = 255) -> Column:
    """The last part of a path, printable characters only, cut to ``most``."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    name = F.substring(F.trim(F.regexp_replace(name, r"[\p{C}\p{Zl}\p{Zp}]", "")), 1, most)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(fallback)).otherwise(name)


def question_input(query: Column) -> Column:
    """What is embedded for a question; null for a blank one."""
    return F.when(F.trim(query) != "", F.concat(F.lit("task: question answering | query: "), F.trim(query)))


def term_variants(term: Column) -> Column:
    """A term in small letters, with an s, and without the s at its end."""
    t = F.lower(F.trim(term))
    return F.array_distinct(F.array(t, F.concat(t, F.lit("s")), F.regexp_replace(t, "s$", "")))


def mentions(text: Column, term: Column) -> Column:
    """Whether a text has a term in one of its variants."""
    low = F.lower(text)
    return F.exists(term_variants(term), lambda v: (v != "") & F.contains(low, v))


def topic(request: Column, otherwise: Column) -> Column:
    out = otherwise
    for word, name in reversed(TOPICS):
        out = F.when(F.contains(F.lower(request), F.lit(word)), F.lit(name)).otherwise(out)
    return out


def fence(text: Column) -> Column:
    """A markdown fence longer than any run of backticks in a text, of three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def table_cell(text: Column) -> Column:
    """Text for a cell of a markdown table: bars escaped, on one line."""
    return F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")


def speech_seconds(words: Column) -> Column:
    """Seconds to speak so many words at 150 a minute, at least two."""
    return F.greatest(F.lit(2.0), F.round(words / 150.0 * 60.0 + 0.5, 2))


def srt_time(ms: Column) -> Column:
    part = lambda d, m: (F.floor(ms / d) % m).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1_000, 60), (ms % 1000).cast("long"))


def slug(text: Column, most: int = 60) -> Column:
    out = F.btrim(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, most), F.lit("-"))
    return F.when(out == "", F.lit("lesson")).otherwise(out)


def one_line(text: Column, most: int = 300) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def safe_path(path: Column) -> Column:
    """Whether a relative path has no empty, dot, drive or backslash segments."""
    bad = lambda s: (s == "") | (s == ".") | (s == "..") | s.contains(":") | s.contains("\\") | s.contains("\x00")
    return F.forall(F.split(path, "/"), lambda s: ~bad(s))


def email_valid(email: Column) -> Column:
    e = F.lower(F.trim(email))
    return (F.length(e) <= 254) & e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def simple_sentences(text: Column) -> Column:
    """Parts after every end mark that blanks follow."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based id: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def content_key(sha: Column, name: str = "source.pdf") -> Column:
    return F.concat_ws("/", F.lit("objects"), F.substring(sha, 1, 2), sha, F.lit(name))


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end) of a ``bytes=a-b`` header; null where it is unsupported, start -1 where it can't be satisfied."""
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    na, nb = F.try_to_number(a, F.lit("999999999999")).cast("long"), F.try_to_number(b, F.lit("999999999999")).cast("long")
    suffix = (a == "") & (b != "")
    start = F.when(suffix, F.greatest(size - nb, F.lit(0))).otherwise(na)
    end = F.when(suffix | (b == ""), size - 1).otherwise(F.least(nb, size - 1))
    bad = (suffix & (nb == 0)) | (start >= size) | (start > end)
    ok = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    return F.when(ok, F.struct(F.when(bad, F.lit(-1).cast("long")).otherwise(start.cast("long")).alias("start"), F.when(bad, F.lit(-1).cast("long")).otherwise(end.cast("long")).alias("end")))


def location(start: Column, end: Column, path: Column) -> Column:
    """Where a passage stands: its pages and its section."""
    section = F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.concat(F.lit("section "), F.array_join(path, " > ")))
    return F.nullif(F.concat_ws(", ", page_label(start, end), section), F.lit(""))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit(None).cast("string")).when(end.isNull() | (start == end), F.concat(F.lit("page "), start)).otherwise(F.concat(F.lit("pages "), start, F.lit("-"), end))


def database_url(url: Column) -> Column:
    """The address of a PostgreSQL database with its driver named; null for other databases."""
    rest = F.regexp_extract(url, r"^(?:postgres|postgresql|postgresql\+psycopg2|postgresql\+psycopg)://(.*)$", 1)
    return F.when(url.rlike(r"^(?:postgres|postgresql|postgresql\+psycopg2|postgresql\+psycopg)://"), F.concat(F.lit("postgresql+psycopg://"), rest))


def media_url(path: Column, root: str) -> Column:
    """The address of a file below a root; null for others."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.concat(F.lit("/media/"), F.substring(path, len(head) + 1, 1_000_000)))


def caption(own: Column, parts: Column) -> Column:
    """A caption of its own, else what its parts say, joined; null for neither."""
    t = F.trim(F.coalesce(own, F.lit("")))
    joined = F.array_join(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return F.when(t != "", t).when(joined != "", joined)
