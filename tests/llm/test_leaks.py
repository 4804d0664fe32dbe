import random

import numpy as np

from lectern.llm import leaks

DOC = "doc_id long, text string, item_id int"
ITEM = "item_id long, passage string"


def test_winnowing_finds_every_long_span():
    random.seed(3)
    for _ in range(200):
        span = [f"s{random.random()}" for _ in range(leaks.K + leaks.WINDOW - 1)]
        a = [f"a{i}" for i in range(random.randint(0, 9))] + span + ["x", "y"]
        b = [f"b{i}" for i in range(random.randint(0, 9))] + span + ["z"]
        number = {w: i for i, w in enumerate(sorted({*a, *b}))}
        prints = [set(leaks.winnow(np.array([number[w] for w in t]), leaks.K, leaks.WINDOW)[1].tolist()) for t in (a, b)]
        assert prints[0] & prints[1]


def brute(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_subsequences_equal_brute_force():
    random.seed(4)
    for _ in range(50):
        a, b = ([random.choice("abcde") for _ in range(random.randint(1, 20))] for _ in range(2))
        assert leaks.lcs(a, b) == brute(a, b)
        assert leaks.heaviest(a, b, dict.fromkeys("abcde", 1.0)) == brute(a, b)


def test_leaks_both_ways(spark):
    random.seed(5)
    passage = " ".join(f"name{i} moves the river" for i in range(12))
    half = passage.split()
    docs = [(i, " ".join(random.choice(["the", "river", "moves", "and", "a"]) for _ in range(80)), None) for i in range(20)]
    docs += [(50, "Before. " + passage.upper().replace(" ", ",  ") + " After.", None), (51, "x " + " ".join(half[:28]) + " y", None), (52, " ".join(half[:8]), None), (53, None, None), (54, "", None), (50, "Before. " + passage.upper() + " After.", None)]
    items = [(1, passage), (2, None), (3, " "), (1, passage)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = {(50, 1), (51, 1)}
    assert {tuple(r) for r in leaks.leaks(d, i).collect()} == want
    assert {tuple(r) for r in leaks.leaks(d, i, block=1).collect()} == want
    assert {tuple(r) for r in leaks.leaks(d, i, k=1, window=1).collect()} == want
    assert leaks.leaks(d.limit(0), i).count() == 0
    assert leaks.leaks(d, i.limit(0)).count() == 0


def found(spark, docs, items, **how):
    d, i = spark.createDataFrame([(*x, None) for x in docs], DOC), spark.createDataFrame(items, ITEM)
    return {tuple(r) for r in leaks.leaks(d, i, **how).collect()}


def halves_in_runs(runs):
    """Texts that hold half of a passage in runs of some length, and texts that hold the other half backwards."""
    random.seed(6)
    items, docs = [], [(1000 + i, " ".join(f"other{random.random()}" for _ in range(60))) for i in range(5)]
    for j, (n, run) in enumerate((n, run) for n in (48, 96, 160) for run in runs):
        words = [f"p{j}w{i}" for i in range(n)]
        parts = [words[i : i + run] for i in range(0, n, 2 * run)]
        docs.append((j, " ".join(" ".join(r) + "".join(f" f{j}x{k}y{m}" for m in range(run)) for k, r in enumerate(parts))))
        # every word of the passage is as rare as the others
        docs.append((100 + j, " ".join(w for w in reversed(words) if w not in set(sum(parts, [])))))
        items.append((j, " ".join(words)))
    return docs, items, {(j, j) for j in range(3 * len(runs))}


def test_half_of_the_words_in_short_runs_is_a_leak(spark):
    docs, items, want = halves_in_runs((2, 3, 4, 6))
    assert found(spark, docs, items, k=1, window=1) == want


def test_half_of_the_words_in_spans_of_the_guaranteed_length_is_a_leak(spark):
    docs, items, want = halves_in_runs((8, 12, 24))
    assert found(spark, docs, items) == found(spark, docs, items, k=1, window=1) == want


def test_words_are_compared_in_one_form(spark):
    items = [(1, "xylem phloem"), (2, "ＧＬＡＣＩＥＲ moraine ﬁord drumlin"), (3, "氷河は谷を削る")]
    docs = [(1, "so xylem phloem it is"), (2, "the glacier moraine fiord drumlin"), (3, "昔、氷河は谷を削る。"), *((10 + i, f"plain text {i}") for i in range(6))]
    assert found(spark, docs, items) == found(spark, docs, items, block=1) == {(1, 1), (2, 2), (3, 3)}


def test_stretch_of_the_full_length_off_the_grid():
    p = [f"w{i}" for i in range(40)]
    passages = leaks.Passages([(1, p)], dict.fromkeys(p, 1.0), k=1, window=1)
    for gap, want in ((100, [1]), (101, [])):
        text = ["-"] * 3 + p[:19] + ["-"] * gap + [p[19]] + ["-"] * 50
        assert passages.found([text]) == [want]


def test_many_passages_and_short_ones(spark):
    items = [(i, f"the {i}th stone of the {i}th wall is marked with sign {i} on its upper {i}th side") for i in range(400)] + [(900, "quasar"), (901, "red quasar halo")]
    docs = [(i, f"intro {i} " + items[i][1] + " end") for i in range(0, 400, 7)] + [(5000, "a quasar here"), (5001, "the red quasar halo there")]
    want = {(i, i) for i in range(0, 400, 7)} | {(5000, 900), (5001, 900), (5001, 901)}
    assert found(spark, docs, items) == found(spark, docs, items, block=3000) >= want


def test_one_item_with_two_passages_and_copies(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = [(1, "x " + a), (2, b + " y"), (3, "nothing of it"), (1, "x " + a)]
    assert found(spark, docs, [(7, a), (7, b), (8, a)]) == {(1, 7), (1, 8), (2, 7)}
