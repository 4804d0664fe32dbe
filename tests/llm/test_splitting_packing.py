import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing, splitting

CHUNK = "chunk_id string, text string, limit_name string"
LIMIT = "limit_name string, max_tokens int, overlap_tokens int"


def test_sparse_table_equals_brute_force():
    r = np.random.default_rng(1)
    s = r.integers(0, 5, 200).astype(np.int8)
    table = splitting.SparseTable(s, 64)
    for _ in range(500):
        a = int(r.integers(0, 190))
        b = min(199, a + int(r.integers(0, 60)))
        assert table.strongest(a, b) == max(range(a, b + 1), key=lambda i: (s[i], i))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(4, 30), st.integers(0, 2))
def test_pieces_cover_the_text_within_the_limit(text, most, overlap):
    text = text.encode("utf-8", "ignore").decode()
    pieces = splitting.cuts(text, most, overlap)
    assert all(splitting.token_estimate(len(text[a:b].encode())) <= most for a, b, _ in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(c <= b and d > b for (_, b, _), (c, d, _) in zip(pieces, pieces[1:]))


def test_overlap_is_exact_and_cuts_are_natural():
    text = " ".join(f"Sentence {i} ends here." for i in range(100))
    pieces = splitting.cuts(text, 50, 5)
    assert all(text[:b].endswith(". ") for _, b, _ in pieces[:-1])
    assert all(splitting.token_estimate(len(text[c:b].encode())) == 5 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))


def test_split_pieces(spark):
    chunks = spark.createDataFrame([("a", "x" * 100, None), ("b", "y", None), ("c", None, None), ("d", "", None), ("a", "x" * 100, None)], CHUNK)
    limits = spark.createDataFrame([("l", 10, 2), ("n", None, 1)], LIMIT)
    pieces = splitting.split_pieces(chunks, limits)
    assert [tuple(r) for r in splitting.oversized(pieces).collect()] == [("l", "a")]
    assert pieces.count() == len(splitting.cuts("x" * 100, 10, 2))
    assert splitting.split_pieces(chunks.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        splitting.split_pieces(chunks, spark.createDataFrame([("l", 5, 5)], LIMIT))


def brute(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
        out.append(sorted(rooms))
    return out[-1] if out else []


def test_best_fit_equals_brute_force():
    random.seed(2)
    for _ in range(40):
        capacity = random.randint(5, 60)
        sizes = sorted((random.randint(1, capacity) for _ in range(50)), reverse=True)
        where = packing.best_fit_decreasing(sizes, capacity)
        used = {}
        for s, c in zip(sizes, where):
            used[c] = used.get(c, 0) + s
        assert sorted(capacity - v for v in used.values()) == brute(sizes, capacity)


def test_pack_keeps_every_token_and_the_capacity(spark):
    counts = spark.createDataFrame([(i, 1 + i * 7 % 90) for i in range(200)] + [(999, 0), (5, 1 + 35)], "doc_id long, tokens long")
    containers = spark.createDataFrame([("s", 50), ("bad", None)], "container_name string, capacity_tokens int")
    for group in (10**9, 800):
        rows = packing.pack(counts, containers, group_tokens=group).collect()
        used, docs = {}, {}
        for r in rows:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
            docs[r["doc_id"]] = docs.get(r["doc_id"], 0) + r["tokens"]
        assert max(used.values()) <= 50
        assert docs == {i: 1 + i * 7 % 90 for i in range(200)}
    assert packing.pack(counts.limit(0), containers).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in packing.token_counts(docs).collect()] == [(1, 2)]


def test_a_block_with_empty_lines_inside_keeps_the_types_of_the_others():
    text = "One.\n\nTwo.\n\nThree.\n\nFour."
    assert splitting.paragraphs(text, [("paragraph", "A", "One."), ("table", "A", "Three."), ("paragraph", "B", "Four.")]) == [("paragraph", "A"), ("paragraph", "A"), ("table", "A"), ("paragraph", "B")]
    assert splitting.paragraphs(text, [("paragraph", "A", "gone")]) is None


def test_texts_of_one_id_and_many_kinds_of_container(spark):
    counts = spark.createDataFrame([(1, 25), (1, 30), (2, 4)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([(f"k{i}", 10) for i in range(3)], "container_name string, capacity_tokens int")
    packed = packing.pack(counts, kinds)
    assert packed.groupBy("container_name", "container_id").sum("tokens").where("`sum(tokens)` > 10").count() == 0
    assert packed.where("container_name = 'k0'").groupBy().sum("tokens").first()[0] == 59
    many = spark.range(1500).selectExpr("concat('c', id) as container_name", "cast(10 as int) as capacity_tokens")
    used = many.selectExpr("container_name", "concat('0-', container_name) as container_id", "cast(5 as bigint) as tokens")
    assert packing.summary(used, many).count() == 1500
