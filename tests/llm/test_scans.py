from lectern.llm import scans

BLOCK = "block_id string, document_id string, ordinal int, block_type string, text string, page_number int, is_document_metadata boolean, line_no int"
CHUNK = "chunk_id string, document_id string, text string, page_start int"
BODY = "The boundary of the region changes.\nThe river shows the boundary."


def tables(spark, texts, chunks=()):
    rows = [(f"b{i}", "d", i + 5, "paragraph", t, p, False, 0) for i, (t, p) in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCK), spark.createDataFrame([(f"c{i}", "d", t, None) for i, t in enumerate(chunks)], CHUNK)


def test_noise_of_each_kind(spark):
    texts = [(BODY, 1)] * 30 + [
        ("A Study of Rivers\nThe well-\nknown boun-\ndary changes and the bouridary stays.", 2),
        ("The region ends.\nA Study of Rivers", 3), ("- 4 -", 4), ("Notes of the Circle   5\nthe end of it.", 5), ("a well-known way and a well-known place", 6), (None, 7), ("", 8),
    ]
    b, c = tables(spark, texts, ["The region ends.\nA Study of Rivers\n\n- 4 -\n\nthe river"])
    got = {tuple(r) for r in scans.noise(b, c).collect()}
    assert got == {
        ("blocks", "b30", 0, "header"), ("blocks", "b30", 2, "hyphenation"), ("blocks", "b30", 3, "misread"), ("blocks", "b31", 1, "header"), ("blocks", "b32", 0, "page_number"),
        ("blocks", "b33", 0, "header"), ("blocks", "b33", 0, "page_number"), ("chunks", "c0", 1, "header"), ("chunks", "c0", 3, "page_number"),
    }
    fixed = {r["record_id"]: r["text"] for r in scans.repaired(b, c).collect()}
    assert fixed["b30"] == "The well-known boundary changes and the boundary stays."
    assert fixed["b32"] == "" and fixed["b0"] == BODY.replace("\n", " ")


def test_corrections_rank_by_frequency(spark):
    words = spark.createDataFrame([("boundary", 500), ("bouridary", 1), ("card", 90), ("cord", 2), ("care", 900), ("hat", 50), ("hot", 40)], "word string, n long")
    got = {r["word"]: r["right"] for r in scans.corrections(words).collect()}
    assert got == {"bouridary": "boundary", "cord": "card"}


def test_empty_tables(spark):
    assert scans.noise(*tables(spark, [])).count() == 0


def test_printed_lines_become_paragraphs():
    assert scans.repair_text("The river\nruns down\nto the sea.\n\nIt ends.", []) == "The river runs down to the sea.\n\nIt ends."
    assert scans.repair_text("These:\n- one\n- two", []) == "These:\n- one\n- two"
    assert scans.repair_text("a = 1\nb = 2", [], running=False) == "a = 1\nb = 2"


def test_confusions_are_learnt_from_the_corpus(spark):
    right = "станция данные машина времена линия страна причина единица величина вершина".split()
    rows = [(w, 300) for w in right] + [(w.replace("н", "п", 1), 1) for w in right] + [("größe", 90), ("größc", 1), ("walked", 80), ("walker", 60), ("talked", 90), ("talker", 70), ("baker", 50), ("baked", 2)]
    words = spark.createDataFrame(rows, "word string, n long")
    learnt = scans.learnt_confusions(words)
    assert learnt == [("н", "п")]
    got = {r["word"]: r["right"] for r in scans.corrections(words, confusions=learnt).collect()}
    assert got == {w.replace("н", "п", 1): w for w in right} | {"größc": "größe"}
    assert scans.learnt_confusions(words.limit(0)) == []
