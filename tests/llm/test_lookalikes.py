import unicodedata

from lectern.llm import lookalikes as L

SCHEMA = "field_name string, record_id string, text string, kind string"


def test_kinds():
    cases = {
        "the ｃｈａｒｇｅ": ("the charge", {"form"}), "veriﬁe": ("verifie", {"form"}), "ﾃﾞー": ("デー", {"form"}),
        unicodedata.normalize("NFD", "é ï"): ("é ï", {"composition"}), "a​b­c": ("abc", {"invisible"}), "a b\tc": ("a b c", {"space"}),
        "stоred": ("stored", {"lookalike"}), "такoй": ("такой", {"lookalike"}),
    }
    for text, want in cases.items():
        assert L.unify(text) == want


def test_kept():
    for text in ("“x” – 3 m² … «y»", "（见图12.46）。", "angle θ or α", "called поток in Russian", "बड़ी ที่", "plain"):
        assert L.unify(text, None) == (text, set())


def test_classes_are_transitive():
    members, _ = L.class_of()
    assert "ο" in members["о"] and "o" in members["о"]


def test_whole_words_need_the_corpus(spark):
    word = "саѕеѕ"
    rows = [("f", "1", f"in some {word} of it", None), ("f", "2", "many cases and cases", None), ("f", "3", "a word сор unknown", None), ("f", "4", None, None), ("f", "1", f"in some {word} of it", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in L.variants(df).collect()} == {("f", "1", "lookalike")}
    assert {r["record_id"]: r["text"] for r in L.unified(df).collect()}["1"] == "in some cases of it"
    assert L.variants(df.limit(0)).count() == 0
    assert L.unified(df.limit(0)).count() == 0


def test_long_text():
    assert L.unify("é" * 100_000) == ("é" * 100_000, set())


def test_the_corpus_chooses_among_strings_that_look_the_same(spark):
    other = "сор"
    text = f"the {other} is here"
    for known, want in (("cop cop cop", "the cop is here"), (f"{other} {other} {other} поток", text)):
        df = spark.createDataFrame([("f", "1", text, None), ("f", "2", known, None)], SCHEMA)
        assert {r["record_id"]: r["text"] for r in L.unified(df).collect()}["1"] == want


def test_a_class_has_one_ordinary_form_in_each_script():
    members, kind = L.class_of()
    for m, group in members.items():
        plain = [L.script(x[0]) for x in group if x and x not in kind]
        assert len(plain) == len(set(plain))
