import random

from lectern.llm import defects, reading

CALL = "call_id long, prompt string, output string, error string, defect int"
EASY, HARD = "the dog sees a ball and the cat runs", "the covariance of the stochastic estimator is asymptotically consistent with the manifold"


def test_language():
    assert reading.language("the dog and the cat are in the house") == "en"
    assert reading.language("der Hund und die Katze sind in dem Haus") == "de"
    assert reading.language("собака и кот") is None
    assert defects.language_of("モデルは温度を測る") == "ja"


def test_reading_levels(spark):
    docs = [(i, " ".join([EASY if i % 2 else HARD] * 5)) for i in range(40)] + [(90, None), (91, "  "), (92, "der Hund und die Katze sind in dem Haus"), (1, " ".join([EASY] * 5))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rated = [(i, "ra", 1 if i % 2 else 5) for i in range(20)] + [(1, "rb", None), (2, "rb", 9), (0, "ra", 5)]
    lab = spark.createDataFrame(rated, "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(d, lab).collect()}
    assert got == {i: 1 if i % 2 else 5 for i in range(40)}
    seeded = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(d, lab.limit(0)).collect()}
    assert set(seeded) == set(range(40)) and seeded[0] > seeded[1]
    assert reading.reading_levels(d.limit(0), lab).count() == 0


def calls(n, seed):
    r = random.Random(seed)
    nouns = ["glacier", "river", "sensor", "battery", "enzyme", "network", "pump", "index"]
    say = lambda: " ".join(f"The {r.choice(nouns)} moves the {r.choice(nouns)} after the {r.choice(nouns)} stops." for _ in range(4))
    out = []
    for i in range(n):
        q = f"Explain in English how the {r.choice(nouns)} changes the {r.choice(nouns)} near the station."
        out.append((i, q, say(), r.choice([None, None, "slow response"])))
    nouns = ["Gletscher", "Sensor", "Speicher", "Druck"]
    say = lambda: " ".join(f"Der {r.choice(nouns)} bewegt den {r.choice(nouns)} und die Pumpe misst den {r.choice(nouns)} nach der Prüfung." for _ in range(3))
    return out + [(500 + i, f"Erkläre kurz, wie der {r.choice(nouns)} den {r.choice(nouns)} in der Station verändert.", say(), None) for i in range(n // 3)]


def test_defects(spark):
    good = calls(300, 1)
    q = good[0][1]
    bad = {
        1000: (q, None, "timeout", "empty"), 1001: (q, "```\n```", None, "empty"), 1002: (q, "I'm sorry, but I cannot help with that request.", None, "refusal"), 1003: (q, q, None, "copy"),
        1004: (q, good[5][2][:70], "finish reason: length", "truncated"), 1005: (q, "Der Gletscher bewegt die Pumpe und das Netz nach dem Halt. Die Pumpe ist mit dem Sensor verbunden.", None, "language"), 1006: (None, "", None, "empty"),
    }
    rows = [(*g, None) for g in good] + [(i, p, o, e, None) for i, (p, o, e, _) in bad.items()] + [(1003, q, q, None, None)]
    df = spark.createDataFrame(rows, CALL)
    got = {r["call_id"]: r["defect"] for r in defects.defects(df).collect()}
    assert {i: got.get(i) for i in bad} == {i: v[3] for i, v in bad.items()}
    assert sum(i < 1000 for i in got) <= 3
    assert defects.defects(df.limit(0)).count() == 0


def test_asked_language_is_known_by_many_names():
    for p in ("Write it in German.", "Schreibe es auf Deutsch.", "Écris-le en allemand.", "Escríbelo en alemán."):
        assert defects.asked_language(p) == "de"
    assert defects.asked_language("Write the part on the Chinese wall.") == "en"


def test_json_values_are_read_apart_from_keys():
    assert defects.answer_text('{"goal": "I \\"can\'t\\" do", "n": 3, "more": ["a", "b"]}').split() == ["I", '\\"can\'t\\"', "do", "a", "b"]
    assert not defects.structured("[no output]") and defects.structured('["x"]') and defects.structured("{")


def test_refusals_of_other_words_and_lists(spark):
    rows = calls(300, 2)
    q = rows[0][1]
    items = ["glacier flow", "tide tables", "river bends", "pump rates", "pipe joints", "heat loss"]
    r = random.Random(3)
    rows += [(2000 + i, "Name what matters for the station.", "\n".join(f"- {x}" for x in r.sample(items, 3)), None) for i in range(60)]
    rows += [(3000 + i, q.replace("river", f"river {i}"), "Sadly it is not possible for me to write that, my rules forbid it.", None) for i in range(6)]
    rows += [(4000, q, "You asked: " + q, None), (4001, q, good_cut(rows[3][2]), "stopped early: budget used up"), (4002, q, '{"answer": ""}', None), (4003, q, "[no output]", None), (4004, None, None, None)]
    got = {i["call_id"]: i["defect"] for i in defects.defects(spark.createDataFrame([(*x, None) for x in rows], CALL)).collect()}
    assert all(got.get(3000 + i) == "refusal" for i in range(6))
    assert [got.get(i) for i in (4000, 4001, 4002, 4003, 4004)] == ["copy", "truncated", "empty", "empty", "empty"]
    assert sum(2000 <= i < 2060 for i in got) <= 2


def good_cut(text):
    """Cut between two sentences, so only the error tells."""
    return text[: text.index(".") + 1]


def test_sentence_lengths_tell_levels(spark):
    short, long = "The pump moves water. ", "the pump moves the water and the pipe holds the water and the river takes the water and "
    docs = [(i, short * 12 if i % 2 else (long * 4).strip().capitalize() + ".") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "ra", 1 if i % 2 else 4) for i in range(40)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(d, lab).collect()}
    assert got == {i: 1 if i % 2 else 4 for i in range(60)}


def test_slip_follows_from_disagreement():
    import numpy as np

    r = np.random.default_rng(0)
    votes = np.zeros((4000, 5))
    for row in votes:
        for _ in range(2):
            row[2 if r.random() > 0.1 else 3] += 1
    assert abs(reading.slip(votes) - 0.1) < 0.02
