import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks, chunking, evaluation, grounding, retrieval, state, store, timeline, traces
from lectern.streaming import limiter

RANK = "list_no int, pos int, item string, method string"
BLOCK = "document_id string, block_id string, ordinal int, block_type string, source_label string, text string, caption string, page_number int, section_path array<string>, heading_level int, is_document_metadata boolean"


def rankings(spark, *lists):
    return spark.createDataFrame([(n, i, x, f"m{n}") for n, xs in enumerate(lists) for i, x in enumerate(xs)], RANK)


def test_fusion_scores_ties_and_repeats(spark):
    rows = retrieval.fuse(rankings(spark, "abc", "dbe")).orderBy("rank").collect()
    assert rows[0]["item"] == "b"
    both = {r["item"]: r["score"] for r in retrieval.fuse(rankings(spark, "ab", "ba")).collect()}
    assert both["a"] == both["b"] == round(1 / 61 + 1 / 62, 12)
    once = {r["item"]: r["score"] for r in retrieval.fuse(rankings(spark, "aab")).collect()}
    assert once == {"a": round(1 / 61, 12), "b": round(1 / 62, 12)}
    assert [r["item"] for r in retrieval.fuse(rankings(spark, "p", "q")).orderBy("rank").collect()] == ["p", "q"]
    with pytest.raises(ValueError):
        retrieval.fuse(rankings(spark, "a"), 0)


def test_coverage_boundaries(spark):
    e = spark.createDataFrame([(1, 0.75), (2, 0.7499), (3, 0.6), (4, 0.5999), (5, None), (6, 0.5), (6, 0.78)], "query_id int, similarity double")
    assert {r["query_id"]: r["level"] for r in retrieval.coverage(e).collect()} == {1: "covered", 2: "weak", 3: "weak", 4: "absent", 5: "absent", 6: "covered"}


def test_top_k_skips_zero_vectors_and_breaks_ties(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in retrieval.top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_search_modes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    p = spark.createDataFrame([(1, "the glacier moves"), (2, "a list, a list")], "chunk_id long, text string")
    q = spark.createDataFrame([(0, [0.9, 0.1])], "query_id long, embedding array<float>")
    assert [r["item"] for r in retrieval.search(v, p, q, ["list"], "keyword").collect()] == ["2"]
    assert {r["item"]: r["methods"] for r in retrieval.search(v, p, q, ["list"], "hybrid").collect()}["2"] == ["vector", "keyword"]
    assert retrieval.search(v, p, q, [], "keyword").count() == 0
    with pytest.raises(ValueError):
        retrieval.search(v, p, q, [], "other")


def test_recall_counts_misses(spark):
    r = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 5)], "query_id int, found int")
    got = evaluation.recall_at(r, (1, 3)).first()
    assert (got["recall_1"], got["recall_3"]) == (0.25, 0.5)
    assert got["mrr"] == round((1 + 1 / 3 + 1 / 5) / 4, 9)


@pytest.mark.parametrize(
    ("good", "bad", "accuracy", "low", "high"),
    [([0.8, 0.7, 0.9], [0.3, 0.4, 0.2], 1.0, 0.4, 0.7), ([0.5], [0.5], 0.5, -1, 0.5), ([0.8, 0.7, 0.9, 0.6], [0.65], 0.8, -1, 0.6)],
)
def test_threshold(spark, good, bad, accuracy, low, high):
    s = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "score double, positive boolean")
    got = evaluation.best_threshold(s).first()
    assert got["accuracy"] == pytest.approx(accuracy)
    assert low < got["threshold"] <= high


def block(i, kind="paragraph", text="Some text.", path=("A",), **more):
    row = {"document_id": "d", "block_id": f"b{i}", "ordinal": i, "block_type": kind, "source_label": "text", "text": text, "caption": None, "page_number": 1, "section_path": list(path), "heading_level": None, "is_document_metadata": False} | more
    return tuple(row.values())


def test_chunking_combines_splits_and_skips(spark):
    rows = [block(0, "title", "T", (), is_document_metadata=True), block(1, "heading", "A"), block(2), block(3, page_number=2), block(4, path=("B",)), block(5, "figure", "", ("B",))]
    got = chunking.chunk(spark.createDataFrame(rows, BLOCK), 100, 150, 10, 1).orderBy("sequence_index").collect()
    assert [r["source_ids"] for r in got] == [["b1", "b2", "b3"], ["b4", "b5"]]
    assert (got[0]["page_start"], got[0]["page_end"]) == (1, 2)
    assert "T" not in got[0]["text"].split()


def test_chunking_long_texts_stay_within_the_limit(spark):
    text = " ".join(f"Sentence number {i} says a little." for i in range(60))
    got = chunking.chunk(spark.createDataFrame([block(1, text=text), block(2, text="x" * 2400)], BLOCK), 30, 40, 5, 1).collect()
    assert max(r["token_count_estimate"] for r in got) <= 40
    whole = " ".join(r["text"] for r in got)
    assert all(f"number {i} " in whole for i in range(60))
    assert chunking.chunk(spark.createDataFrame([], BLOCK)).count() == 0
    with pytest.raises(ValueError):
        chunking.check_config(10, 5, 1, 1)


def test_section_paths(spark):
    rows = [block(1, "heading", "A", heading_level=1), block(2), block(3, "heading", "B", heading_level=2), block(4), block(5, "heading", "C", heading_level=1), block(6)]
    got = {r["ordinal"]: r["path"] for r in blocks.section_paths(spark.createDataFrame(rows, BLOCK)).collect()}
    assert (got[2], got[4], got[6]) == (["A"], ["A", "B"], ["C"])


def test_removal_takes_what_refers_back(spark):
    s = spark.createDataFrame([("p", 0, False, False), ("p", 1, True, False), ("p", 2, False, True), ("p", 3, False, False), ("p", 4, False, True)], "part string, i int, rejected boolean, refers_back boolean")
    assert [r["fate"] for r in grounding.removal(s).orderBy("i").collect()] == ["kept", "rejected", "dependent", "kept", "kept"]


def test_numbers(spark):
    df = spark.createDataFrame([("On page 5, 3 of 12.5 and 7", "12.5 and 3")], "a string, b string")
    row = df.select(grounding.unsupported_numbers(F.col("a"), F.col("b")).alias("x"), grounding.unsupported_numbers(F.col("a"), F.col("b"), F.lit("page 5")).alias("y")).first()
    assert row["x"] == ["5", "7"] and row["y"] == ["7"]


def test_upsert_and_missing(spark):
    a = spark.createDataFrame([(1, "x", 1)], "id int, v string, version int")
    b = spark.createDataFrame([(1, "y", 2), (2, "z", 2)], "id int, v string, version int")
    assert {(r["id"], r["v"]) for r in store.upsert(a, b, ["id"], "version").collect()} == {(1, "y"), (2, "z")}
    assert store.new_rows(b, a, ["id"]).count() == 1


def test_illegal_steps(spark):
    e = spark.createDataFrame([("k", 1, "queued"), ("k", 2, "parsing"), ("k", 3, "ready")], "key string, seq int, status string")
    assert [r["seq"] for r in state.illegal(e, "key", ["seq"]).collect()] == [3]


def test_overlap_and_wrap(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 15.0, 15.0), (1, 3, 9.9, 9.9, 20.0, 20.0)], "frame int, id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["a"], r["b"]) for r in timeline.overlaps(b).collect()} == {(1, 2), (2, 3)}
    assert timeline.wrap("aa bb cc", 5) == ["aa bb", "cc"]
    assert timeline.wrap("x" * 90 + " y", 72) == ["x" * 90, "y"]


def test_limiter_decides():
    times, second = [], 1_000_000
    for n in range(5):
        times, refused, _ = limiter.decide(times, n * second, False, 5, 900 * second)
        assert not refused
    times, refused, wait = limiter.decide(times, 10 * second, True, 5, 900 * second)
    assert refused and wait == 890
    _, refused, _ = limiter.decide(times, 901 * second, False, 5, 900 * second)
    assert not refused
    assert limiter.decide([1], 2, True, 5, 900 * second)[0] == []


def test_limiter_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("k", i, i * 1_000_000, False) for i in range(7)], "key string, id long, us long, ok boolean").coalesce(1).write.parquet(path)
    out = limiter.limit(spark.readStream.schema("key string, id long, us long, ok boolean").parquet(path))
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["id"] for r in spark.table("limited").where("refused").collect()} == {5, 6}


def test_traces_end_right():
    values = [3, 1, 2, 9, -4]
    for f in (traces.bubble_sort, traces.insertion_sort):
        assert list(f(values))[-1][1] == sorted(values)
    assert list(traces.linear_search([4, 5], 5))[-1][7:] == (1, "found")
    assert list(traces.binary_search([1, 2], 9))[-1][8] == "absent"


def test_phrases_of_items_after_many_without_any_are_found(spark):
    from types import SimpleNamespace

    from lectern.plans import search

    none = spark.range(20_050).select(F.col("id").alias("item_id"), F.lit(None).cast("array<string>").alias("answer_phrases")).coalesce(1)
    one = spark.createDataFrame([(99_999, ["Red fox"])], "item_id long, answer_phrases array<string>")
    t = SimpleNamespace(eval_items=none.unionByName(one), documents=spark.createDataFrame([(1, "a red fox")], "doc_id long, text string"))
    assert [tuple(r) for r in search.phrase_relevance(t).select("doc_id", "item_id").collect()] == [(1, 99_999)]
