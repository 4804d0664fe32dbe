import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import normal
from lectern.functions import text as T
from lectern.operators import blocks, chunking, code, evaluation, grounding, keyword, layout, retrieval, script, state, store, storyboard, timeline, traces
from lectern.sources import files
from lectern.streaming import limiter


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_forms_of_text(spark):
    for text, want in (("Multi\u2010Head \ufb01ne\u00ad  Straße", "multi head fine strasse"), ("A-B  c", "a b c"), ("", ""), (None, None)):
        assert one(spark, text, normal.search_form) == want
    assert one(spark, "Multi \u2014 ＨＥＡＤ", normal.quote_form) == "multi-head"
    assert one(spark, "“x”\u00a0–\u00a0y’s ½", normal.reading_form) == "\"x\" - y's 1\u20442"
    assert one(spark, "# A\n- **b** `c`\n```py\nx```  __d__", lambda c: normal.normalized(c, "none")) == "A b c d"
    assert one(spark, None, lambda c: normal.normalized(c, "none")) == "none"


def test_markdown_as_it_is_stripped(spark):
    assert one(spark, "a ```code``` _b_ ####### c", T.strip_markdown) == "a   b ####### c"
    assert one(spark, "#######   c\n  * d", T.strip_markdown) == "c\nd"


def test_claim_sentences(spark):
    text = 'See Fig. 3 and Figs. 4, e.g. this. It grew to 3.5 (cf. Smith et al. 2020). "Yes!" (No.) then. Next one? end'
    assert one(spark, text, T.claim_sentences) == ["See Fig. 3 and Figs. 4, e.g. this.", "It grew to 3.5 (cf. Smith et al. 2020).", '"Yes!"', "(No.) then.", "Next one? end"]
    assert one(spark, " ", T.claim_sentences) == []


def test_names_terms_and_fences(spark):
    assert one(spark, "C:\\x/y\\ a\x07b.pdf ", T.display_name) == "ab.pdf"
    assert one(spark, "a/", T.display_name) == "paper.pdf"
    assert one(spark, "Waves", T.term_variants) == ["waves", "wavess", "wave"]
    assert one(spark, "a ```` b `", T.fence) == "`````" and one(spark, "", T.fence) == "```"
    assert one(spark, "a|b\nc", T.table_cell) == "a\\|b c"
    assert one(spark, "  ", T.question_input) is None


def test_stems():
    for a, b in (("networks", "network"), ("running", "runs"), ("relational", "relate"), ("agreed", "agree"), ("hoping", "hoped"), ("happiness", "happy")):
        assert keyword.stem(a) == keyword.stem(b)
    assert keyword.stem("bus") == "bus" and keyword.stem("é") == "é"


def test_keyword_search_is_scoped_and_ranked(spark):
    chunks = spark.createDataFrame([("c1", "d1", 0, "the networks run and networks"), ("c2", "d1", 1, "a network of it"), ("c3", "d2", 0, "networks"), ("c4", "d1", 2, "nothing here")], "chunk_id string, document_id string, sequence_index int, text string")
    docs = spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "document_id string, user_id string")
    q = spark.createDataFrame([(1, "u1", "d1", "Which network, which networks?"), (2, "u1", "d2", "network"), (3, "u1", "d1", "the of and"), (4, "u1", "d1", None), (5, "u1", "none", "network")], "query_id int, user_id string, document_id string, query string")
    got = [(r["query_id"], r["chunk_id"], r["rank_score"], r["rank"]) for r in keyword.search(chunks, docs, q).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1", 0.2, 1), (1, "c2", 0.1, 2)]
    assert keyword.search(chunks, docs, q, stems=False).where("query_id = 3").count() == 2
    with pytest.raises(ValueError):
        keyword.search(chunks, docs, q, 0)


def test_vector_search_is_scoped(spark):
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2"), ("c3", "d3")], "chunk_id string, document_id string")
    emb = spark.createDataFrame([("c1", "m", [1.0, 0.0]), ("c2", "m", [0.9, 0.1]), ("c3", "m", [1.0, 0.0]), ("c1", "other", [0.0, 1.0]), ("c2", "m", [float("nan"), 1.0])], "chunk_id string, model_name string, embedding array<float>")
    docs = spark.createDataFrame([("d1", "u"), ("d2", "u"), ("d3", "v")], "document_id string, user_id string")
    q = spark.createDataFrame([(1, "u", None, [1.0, 0.0]), (2, "u", "d2", [1.0, 0.0]), (3, "u", "d3", [1.0, 0.0]), (4, "u", None, [1.0])], "query_id int, user_id string, document_id string, embedding array<float>")
    got = [(r["query_id"], r["chunk_id"]) for r in retrieval.scoped(chunks, emb, docs, q, "m", 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1"), (1, "c2"), (2, "c2")]


def test_top_k_equals_brute_force_in_blocks(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id < 20 or vec_id >= 900").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for row in retrieval.top_k(df, q.where("vec_id < 900"), 4, block=6).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for i in range(20):
        s = np.round(unit @ unit[i], 9)
        assert got[i] == sorted(range(300), key=lambda j: (-s[j], j))[:4]


def test_approximate_index_finds_nine_of_ten(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * r.normal(size=16)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = retrieval.Cells(df, 12, sample=400)
    found = index.search(index.assign(df), q, 10, 3)
    assert retrieval.recall(found, retrieval.top_k(df, q, 10)).first()["recall"] >= 0.9


def test_modes_of_search(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, item string, similarity double, rank int")
    w = spark.createDataFrame([(1, "b", 0.3, 1), (1, "c", 0.2, 2)], "query_id int, item string, rank_score double, rank int")
    got = [(r["item"], r["methods"]) for r in retrieval.ranked(v, w, "hybrid").orderBy("rank").collect()]
    assert got == [("b", ["vector", "keyword"]), ("a", ["vector"]), ("c", ["keyword"])]
    assert [r["item"] for r in retrieval.ranked(v, w, "keyword", 0).collect()] == ["b"]
    assert retrieval.best_score(retrieval.ranked(v, w, "keyword"), "keyword").first()["best"] == 0.3
    assert retrieval.best_score(retrieval.ranked(v, w, "hybrid"), "hybrid").first()["best"] == 0.9


def test_phrases_equal_brute_force(spark):
    random.seed(1)
    words = ["red", "fox", "river", "the", "glacier", "of"]
    texts = [" ".join(random.choices(words, k=12)) for _ in range(40)]
    phrases = [" ".join(random.choices(words, k=random.randint(1, 4))) for _ in range(30)] + ["ed f", " ", "", "Fox\u2010River"]
    p = spark.createDataFrame(list(enumerate(phrases)), "item_id long, phrase string")
    d = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")
    form = normal.for_search
    want = {(i, j) for i, x in enumerate(phrases) if form(x) for j, t in enumerate(texts) if form(x) in t}
    for block in (50_000, 7):
        assert {tuple(r) for r in evaluation.relevant(d, p, block).collect()} == want
    assert evaluation.Phrases(["ab", "b", "bc"]).inside("xabc") == {0, 1, 2}


def test_threshold_tells_what_it_keeps(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.3, False)], "score double, positive boolean")
    r = evaluation.best_threshold(s).first()
    assert (r["kept"], r["rejected"], r["positives"], r["negatives"], r["keeps_everything"], r["baseline"]) == (2, 2, 2, 2, False, 0.5)
    assert evaluation.best_threshold(s.where("positive")).count() == 0


def parsed_item(i, label="text", text="Some words.", **more):
    row = {"document_id": "d", "ordinal": i, "source_label": label, "text": text, "caption": None, "table_text": None, "level": None, "page_number": "1"} | more
    return tuple(row.values())


ITEM = "document_id string, ordinal int, source_label string, text string, caption string, table_text string, level string, page_number string"


def test_parsed_items(spark):
    rows = [
        parsed_item(0, "section_header", "A Study of the Glacier"), parsed_item(1, "picture", " "), parsed_item(2, "text", "Prof. Ada B. Lovelace"), parsed_item(3, "section_header", "Faculty of Rivers"),
        parsed_item(4, "Section Header", "Method", level="1"), parsed_item(5, "text", "  "), parsed_item(6, "table", "t", table_text="|a|"), parsed_item(7, "picture", "cap", caption="cap"), parsed_item(8, "text", "End.", page_number="x"),
    ]
    got = {r["ordinal"]: r for r in blocks.parsed(spark.createDataFrame(rows, ITEM)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert [got[i]["role"] for i in (0, 2, 3, 4)] == ["title", "author", "affiliation", None]
    assert [got[i]["block_type"] for i in (0, 3, 4, 6, 7)] == ["title", "other", "heading", "table", "figure"]
    assert got[6]["text"] == "|a|" and got[7]["text"] == "" and got[8]["page_number"] is None
    assert got[8]["section_path"] == ["Method"] and got[2]["section_path"] == []


BLOCK = "document_id string, block_id string, ordinal int, block_type string, text string, caption string, page_number int, section_path array<string>, is_document_metadata boolean, image_asset_path string, image_available boolean"


def test_chunk_records(spark):
    rows = [
        ("d", "b0", 0, "heading", "A", None, 1, ["A"], False, None, None), ("d", "b1", 1, "heading", "A1", None, 1, ["A", "A1"], False, None, None), ("d", "b2", 2, "paragraph", "One text.", None, 2, ["A", "A1"], False, None, None),
        ("d", "b3", 3, "figure", "", "A figure", 3, ["A", "A1"], False, "f.png", True), ("d", "b4", 4, "paragraph", "Other.", None, 4, ["B"], False, None, None), ("d", "b5", 5, "heading", "Z", None, 5, ["Z"], False, None, None),
    ]
    df, docs = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([("d", "T")], "document_id string, title string")
    got = chunking.chunk(df, documents=docs).orderBy("sequence_index").collect()
    assert [r["source_ids"] for r in got] == [["b0", "b1", "b2", "b3"], ["b4"], ["b5"]]
    first = got[0]
    assert (first["page_start"], first["page_end"], first["related_element_ids"], first["image_asset_paths"], first["context_prefix"]) == (1, 3, ["b3"], ["f.png"], "Document: T\nSection: A > A1")
    assert first["next_chunk_id"] == got[1]["chunk_id"] and got[2]["next_chunk_id"] is None and got[2]["text"] == "Z"
    again = chunking.chunk(df.repartition(3), documents=docs).orderBy("sequence_index").collect()
    assert [r["chunk_id"] for r in again] == [r["chunk_id"] for r in got]
    assert chunking.problems(chunking.chunk(df), df).count() == 0
    links = {(r["block_id"], r["link_type"]): r["source_position"] for r in chunking.links(chunking.chunk(df)).collect()}
    assert links["b3", "source"] == 3 and links["b3", "related"] == 0


def test_pieces_overlap_in_whole_words():
    out = chunking.pieces(" ".join(f"word{i}" for i in range(200)), 40, 8)
    assert all(chunking.estimate(p) <= 40 for p in out)
    assert all(b.split("\n")[0] in a for a, b in zip(out, out[1:]))


def test_verdicts(spark):
    rows = [
        ("introduction", "This video is short.", "framing", None, "", "framing"), ("section", "This video is short.", "framing", None, "", "unsupported"), ("introduction", "It has 3 parts in this video.", "framing", None, "", "unsupported"),
        ("introduction", "The glacier moves.", "framing", None, "", "unsupported"), ("section", "x", "supported", "the ice\u2014flow is slow", "They say the ice-flow  is SLOW here.", "supported"),
        ("section", "x", "supported", "N = 6", "N = 6", "unsupported"), ("section", "x", None, None, "", "unsupported"), ("section", "x", "contradicted", None, "", "contradicted"),
        ("section", "x", "supported", "one passage ends and begins", "one passage ends" + grounding.BREAK + "and begins", "unsupported"),
    ]
    df = spark.createDataFrame(rows, "part string, sentence string, verdict string, quote string, cited string, want string")
    got = df.select("want", grounding.judge(F.col("part"), F.lit(False), F.col("sentence"), F.col("verdict"), F.col("quote"), F.col("cited")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_lesson_problems(spark):
    sections = [
        ("l", 0, "introduction", "It has 7 parts.", None, None), ("l", 1, "section", "On page 5 it is 3 and x = y + 2.", "The paper shows it.", ["P1", "P9"]), ("l", 2, "section", " ", None, []), ("l", 3, "section", "It is 12.5 here, a = b.", "A plain word.", ["P1"]),
    ]
    s = spark.createDataFrame(sections, "lesson string, section int, part string, narration string, background string, cited array<string>")
    p = spark.createDataFrame([("l", "P1", "it is 12.5 and $a=b$ with 3.5", "page 5")], "lesson string, passage_id string, text string, label string")
    got = {(r["section"], r["problem"]): r["detail"] for r in grounding.lesson_problems(s, p).collect()}
    assert got == {(0, "unsupported number"): "7", (1, "unknown citation"): "P9", (1, "background"): "claim about the paper", (1, "unsupported equation"): "x = y + 2", (1, "unsupported number"): "2", (2, "no narration"): "", (2, "no citation"): ""}


def test_report_applied(spark):
    parts = [("l", 0, "introduction", None, False, ["a"]), ("l", 1, "section", "S1", False, ["b", "c"]), ("l", 2, "section", "S2", True, ["d"]), ("l", 3, "section", "S3", True, ["e", "f"]), ("l", 4, "conclusion", None, False, ["g"]), ("m", 0, "section", "S", False, ["h"])]
    p = spark.createDataFrame(parts, "lesson string, place int, part_name string, title string, title_rejected boolean, sentences array<string>")
    f = spark.createDataFrame([("l", 0, 0, "rejected"), ("l", 1, 0, "rejected"), ("l", 1, 1, "kept"), ("l", 2, 0, "rejected"), ("l", 3, 1, "dependent"), ("m", 0, 0, "rejected")], "lesson string, place int, i int, fate string")
    got = [(r["place"], r["title"], r["text"]) for r in grounding.applied(p, f).orderBy("lesson", "place").collect()]
    assert got == [(0, None, grounding.INTRODUCTION), (1, "S1", "c"), (3, "Part 2", "e"), (4, None, "g")]


def test_storyboards(spark):
    assert storyboard.sentences("Step 1. Do it! Wait... what? (Yes.) Go") == ["Step 1. Do it!", "Wait... what?", "(Yes.)", "Go"]
    assert storyboard.merge_short(["a b", "c " * 9, "d"], 8) == [f"a b {'c ' * 9} d"]
    groups = storyboard.fallback(["w " * 10] * 7)
    assert [storyboard.words(g) for g in groups] == [30, 40] and storyboard.fallback([]) == []
    parts = spark.createDataFrame([("s", i, f"x{i}") for i in range(3)] + [("t", 0, "y")], "section string, i int, sentence string")
    beats = spark.createDataFrame([("s", 0, 1, "v"), ("s", 1, 2, "w "), ("t", 0, 2, "v")], "section string, beat int, sentence_count int, visual string")
    assert {(r["section"], r["beat"]): r["text"] for r in storyboard.planned(parts, beats).collect()} == {("s", 0): "x0", ("s", 1): "x1 x2"}
    c = spark.createDataFrame([("s", 1, 2.0, 1.0), ("s", 2, 1.0, 3.0), ("s", 3, 5.0, 1.0)], "section string, beat int, duration double, animation double")
    assert [(r["actual_end"], r["overrun"]) for r in storyboard.clock(c).first()["report"]] == [(2.0, 0.0), (5.0, 2.0), (8.0, 0.0)]


def test_traces_and_changes(spark):
    assert len(list(traces.insertion_sort([3, 1, 2]))) == 7
    assert [r[8] for r in traces.bubble_sort([1, 2, 3])] == ["start", "compare", "compare", "no swap"]
    last = list(traces.binary_search([1, 3, 5, 7], 7))[-1]
    assert last[7] == 3 and last[5] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(traces.binary_search([2, 1], 1))
    with pytest.raises(ValueError):
        traces.add_tracer("bubble_sort", traces.bubble_sort)
    rows = [("k", *r) for r in traces.bubble_sort([2, 1])]
    df = spark.createDataFrame(rows, "key string, " + traces.STEP)
    assert [(r["step"], r["op"], r["name"], r["a"], r["b"]) for r in traces.changes(df, "key").orderBy("step", "place").collect()] == [(1, "add", "j", 0, None), (2, "swap", None, 0, 1), (3, "remove", "j", None, None)]


def test_layout(spark):
    rows = [("comparison", "", "comparison"), ("text", "flow", "text"), ("chart", "", "connected"), ("", "a title card", "text"), (None, "left to right", "connected"), (None, None, "text")]
    df = spark.createDataFrame(rows, "a string, b string, want string").select("want", layout.mode(F.col("a"), F.col("b")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_scripts(spark):
    r = spark.createDataFrame([(["A", "B"], [("x", "n1"), ("y", "n2")])], "t array<string>, n array<struct<title:string,note:string>>").select(script.tidy_notes(F.col("t"), F.col("n")).alias("x"), script.tidy_notes(F.slice("t", 1, 1), F.col("n")).alias("y")).first()
    assert [(x["title"], x["note"]) for x in r["x"]] == [("A", "n1"), ("B", "n2")] and r["y"] == []
    n = spark.range(1).select(script.notes_text(F.lit(1), F.lit("T"), F.lit("p"), F.array(F.lit("a"), F.lit("b")), F.lit("")).alias("a"), script.facts_text(F.array(F.lit("c")), F.array(F.lit("f"))).alias("b"), script.quality_warnings(F.array(F.struct(F.lit("q").alias("question"), F.lit("r").alias("reason"))), F.array(F.lit("z"))).alias("c")).first()
    assert n["a"] == "1. T | purpose: p | define: a, b" and n["b"] == "Key concepts: c\n- f" and n["c"] == ["Knowledge gap: q (r)", "Conflicting information flagged: z"]
    found = spark.createDataFrame([("k", "Wave", "unclear")], "key string, term string, reason string")
    missing = spark.createDataFrame([("k", "wave "), ("k", "Tide")], "key string, item string")
    assert {(x["term"], x["reason"]) for x in script.reviewed(found, missing).collect()} == {("Wave", "unclear"), ("Tide", "never mentioned")}
    left = spark.range(1).select(script.remaining(F.lit(False), F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()["x"]
    assert left == ["A", "b"]


def test_states(spark):
    e = spark.createDataFrame([("p", 1, 1, "claim"), ("p", 2, 2, "failed"), ("p", 3, 3, "claim"), ("p", 4, 4, "claim"), ("p", 5, 5, "failed"), ("p", 6, 6, "claim")], "paper string, event_id int, ts int, kind string")
    assert sorted(r["event_id"] for r in state.claims(e).collect()) == [3, 6]
    j = spark.createDataFrame([("j", 1, 1, "enter", "a"), ("j", 2, 2, "enter", "c"), ("j", 3, 3, "enter", "b"), ("j", 4, 4, "enter", "?")], "job string, ts int, event_id int, kind string, stage string")
    assert {r["stage"]: r["state"] for r in state.job_stages(j, ("a", "b", "c", "d")).collect()} == {"a": "done", "b": "current", "c": "current", "d": "pending"}


def test_limiter_replays_and_forgets(spark):
    a = spark.createDataFrame([("k", i, i * 1_000_000, False) for i in range(7)] + [("k", 9, 2_000_000_000, False)], "key string, id long, us long, ok boolean")
    assert {r["id"] for r in limiter.replay(a).where("refused").collect()} == {5, 6}


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    store.publish(spark, {"a": a}, str(tmp_path / "s"))
    assert store.published(spark, str(tmp_path / "s"), "a").count() == 2
    store.publish(spark, {"a": a.limit(1)}, str(tmp_path / "s"))
    assert store.published(spark, str(tmp_path / "s"), "a").count() == 1
    with pytest.raises(ValueError):
        store.batches(a, ["id"], ["v"], 0)


def test_files(spark, tmp_path):
    folder = tmp_path / "pdfs"
    for name, data in (("a/paper.pdf", b"xx%PDF-1.4"), ("b/paper.pdf", b"%PDF-1.7 text"), ("c/paper.pdf", b""), ("d/note.txt", b"%PDF-")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    got = {r["path"].split("/")[-2]: r["problem"] for r in files.read_pdfs(spark, str(folder)).collect()}
    assert got == {"a": None, "b": None, "d": "not a .pdf name"}  # the source doesn't list files without bytes
    manifest = tmp_path / "m.json"
    manifest.write_text('{"papers": [{"key": "a", "url": "u"}, {"key": "b", "url": "u", "sha256": "00"}, {"key": "e", "url": "u"}, {"key": "l", "local_path": "b/paper.pdf"}, {"key": "n", "local_path": "no/paper.pdf"}]}')
    got = {r["key"]: r["problem"] for r in files.read_manifest(spark, str(manifest), str(folder)).collect()}
    assert got == {"a": "not a PDF", "b": "another hash", "e": "not there yet", "l": None}
    asked = spark.createDataFrame([("file:/nowhere.pdf",)], "path string")
    assert files.wanted_pdfs(spark, asked, str(folder)).first()["problem"] == "missing"


def box(kind, size=8, body=b""):
    return size.to_bytes(4, "big") + kind + body


def test_videos_and_boxes(spark, tmp_path):
    assert list(files.boxes(box(b"ftyp") + box(b"moov", 16, b"12345678") + box(b"mdat", 0))) == ["ftyp", "moov", "mdat"]
    assert list(files.boxes(box(b"free", 1, (24).to_bytes(8, "big") + b"12345678") + box(b"mdat") + box(b"bad ", 3))) == ["free", "mdat"]
    df = spark.createDataFrame([(bytearray(box(b"mdat") + box(b"moov")),), (bytearray(box(b"moov") + box(b"mdat")),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in df.select(files.starts_fast(F.col("c"))).collect()] == [False, True, True]
    for run in ("my-run_1", "other"):
        (tmp_path / "out" / run).mkdir(parents=True)
        (tmp_path / "out" / run / "lesson_demo.mp4").write_bytes(b"x")
    owned = spark.createDataFrame([("my-run_1",)], "run_dir string")
    assert [(r["id"], r["title"], r["url"]) for r in files.videos(spark, str(tmp_path / "out"), owned).collect()] == [("my-run_1/lesson_demo.mp4", "My Run 1", "/media/my-run_1/lesson_demo.mp4")]


def test_reports_and_logs(spark, tmp_path):
    s = spark.createDataFrame([("p", "vector", 0.5)], "paper string, mode string, recall_1 double")
    assert "| vector | 0.50 |" in files.report(s)
    c = spark.createDataFrame([(1, "r", 1, "a|b", "say ```", "x", None)], "call_id int, run_id string, seq int, label string, prompt string, output string, error string")
    log = files.call_log(c).first()["log"]
    assert "## 1. a\\|b" in log and "````\nsay ```\n````" in log
    assert one(spark, '["a", 1, "b", null]', files.notes) == ["a", "b"] and one(spark, "{", files.notes) == [] and one(spark, None, files.notes) == []
    runs = spark.createDataFrame([("r1", "d1", "x"), ("r2", "", "y")], "run_id string, run_dir string, v string")
    files.write_artefacts(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_code_is_looked_at():
    good = "from manim import *\nclass SectionScene(Scene):\n    def construct(self):\n        self.wait(1)\n"
    assert code.problems(good) == []
    bad = "import os, numpy.ctypeslib\nfrom . import x\nclass A: pass\nopen('x').sys.__class__\n__name__"
    assert code.problems(bad) == ["1: import os", "1: import numpy.ctypeslib", "2: import from .", "4: attribute __class__", "4: attribute sys", "4: name open", "5: name __name__", "0: classes A"]
    assert code.problems("def (") == ["1: syntax"] and code.problems("x = 1") == ["0: classes none"]


def test_step_narrations_fall_back(spark):
    steps = spark.createDataFrame([("a", 0, "e0"), ("a", 1, "e1"), ("a", 2, "e2"), ("b", 0, "f0"), ("c", 0, "g0"), ("c", 1, "g1")], "section string, i int, event string")
    told = spark.createDataFrame([("a", [False, True, False], ["one ", "two"]), ("c", [True, False], ["x"])], "section string, grouped array<boolean>, sentences array<string>")
    got = {(r["section"], r["segment"]): (r["text"], r["steps"], r["fallback"]) for r in timeline.narrated(steps, told).collect()}
    assert got == {("a", 0): ("one", [0, 1], False), ("a", 1): ("two", [2], False), ("b", 0): ("f0", [0], True), ("c", 0): ("g0", [0], True), ("c", 1): ("g1", [1], True)}


def test_small_ones(spark):
    assert one(spark, "weak", state.lesson_minutes) == 2 and one(spark, "covered", state.lesson_minutes) == 4
    r = spark.createDataFrame([(" ", ["a ", "", " b"]), (" c ", None), (None, [])], "own string, parts array<string>").select(T.caption(F.col("own"), F.col("parts")).alias("x")).collect()
    assert [x["x"] for x in r] == ["a b", "c", None]
