import pandas as pd

from lectern.llm.sentences import _dots, _look, _scan, _segment, sentence_units, units

SCHEMA = "field_name string, record_id long, doc string, text string, units string"


def cut(text, *keep):
    return [text[a:b] for a, b in units(text, frozenset(keep))]


def found(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    text = {(r[0], r[1]): r[3] for r in rows}
    out = {}
    for r in sorted(sentence_units(df).collect()):
        out.setdefault(r["record_id"], []).append(text[r["field_name"], r["record_id"]][r["start_char"] : r["end_char"]])
    return out


def test_quotes_brackets_citations_and_lists():
    assert cut('"Why now?" asks Ann. It stops.[20] (See it.) The end') == ['"Why now?" asks Ann.', "It stops.[20]", "(See it.)", "The end"]
    assert cut("The label reads 'Stop. Do not.' in red. Next.") == ["The label reads 'Stop. Do not.' in red.", "Next."]
    assert cut("A head\n- one\n- two\n43. The last. pH falls.") == ["A head", "- one", "- two", "43. The last.", "pH falls."]


def test_numbers_ellipses_and_missing_blanks():
    assert cut("The gap is .5 mm, not 8.42. It ... or not ... ends.Then more.") == ["The gap is .5 mm, not 8.42.", "It ... or not ... ends.", "Then more."]


def test_scripts():
    assert cut("“太大了！”她说。新方法……也许……好。（见表。）旁白问：“完了吗？没有。”然后继续。") == ["“太大了！”她说。", "新方法……也许……好。", "（见表。）", "旁白问：“完了吗？没有。”然后继续。"]
    assert cut("डॉ. मुनेश आए। ठीक है?") == ["डॉ. मुनेश आए।", "ठीक है?"]
    assert cut("Τι σημαίνει αυτό; Το μοντέλο.") == ["Τι σημαίνει αυτό;", "Το μοντέλο."]
    assert cut("ทีมวัดค่า 45 ครั้ง วิธีใหม่ดี") == ["ทีมวัดค่า 45 ครั้ง", "วิธีใหม่ดี"]
    assert cut("هل انتهى؟ ليس بعد.") == ["هل انتهى؟", "ليس بعد."]


def test_invisible_characters_and_offsets():
    t = "  One​ end.  Two.​\nThree  "
    assert cut(t) == ["One​ end.", "Two.​", "Three"]


def test_abbreviations_are_learnt_from_the_document_and_the_corpus(spark):
    rows = [
        ("a", 1, "d1", "We met Abc. Velorf, cf. Abc. two, and the rest. The abc. lists grow."),
        ("a", 2, "d2", "The team of Qra. Velorf left. We saw Qra. Munot here. Ask Qra. Orrum now. It was Qra. Sila then. See Qra. Tav again. The end."),
        ("a", 3, "d3", "It was sand, salt, etc. The next one, etc. and so on. More."),
    ]
    got = found(spark, rows)
    assert got[2][0] == "The team of Qra. Velorf left."
    assert got[3] == ["It was sand, salt, etc.", "The next one, etc. and so on.", "More."]


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [("a", 1, "d", None), ("a", 2, "d", " \n"), ("a", 3, None, "One. Two."), ("a", 3, None, "One. Two."), ("a", 4, "d", "x" * 200_000)]
    got = found(spark, rows)
    assert {k: len(v) for k, v in got.items()} == {3: 2, 4: 1}
    assert sentence_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_document_decides_before_the_corpus(spark):
    rows = [
        ("a", 1, "d1", "It is tlk. so, and tlk. here. We saw tlk. Velorf there."),
        ("a", 2, "d2", "The tlk is old. A tlk was new. " * 20),
        ("a", 3, "d3", "Ask the tlk. Velorf left."),
    ]
    got = found(spark, rows)
    assert got[1] == ["It is tlk. so, and tlk. here.", "We saw tlk. Velorf there."]
    assert got[3] == ["Ask the tlk.", "Velorf left."]


def test_a_document_counts_a_token_in_all_its_texts(spark):
    rows = [
        ("a", 1, "d1", "It is tlk. so, and tlk. here. We saw tlk. Velorf there."),
        ("a", 2, "d2", "Ask the tlk. Velorf left."),
        ("a", 3, "d2", "The tlk is old. A tlk was new. Any tlk fits."),
        ("a", 4, None, "Ask the tlk. Velorf left."),
    ]
    got = found(spark, rows)
    assert got[1] == ["It is tlk. so, and tlk. here.", "We saw tlk. Velorf there."]
    assert got[2] == ["Ask the tlk.", "Velorf left."]
    assert got[4] == ["Ask the tlk. Velorf left."]


def test_abbreviations_of_any_length(spark):
    rows = [
        ("a", 1, "d1", "Dort war Hauptm. und Arzt. Dann kam Hauptm. Weber an."),
        ("a", 2, "d2", "Ein Regierungsbaumstr. aus Ulm. Dann kam Regierungsbaumstr. Weber an."),
        ("a", 3, "d3", "So war Oberreg.Baumeistr. hier. Dann kam Oberregier.rat.baum. Weber an. Es war Oberregier.rat.baum. da."),
    ]
    got = found(spark, rows)
    assert got[1] == ["Dort war Hauptm. und Arzt.", "Dann kam Hauptm. Weber an."]
    assert got[2] == ["Ein Regierungsbaumstr. aus Ulm.", "Dann kam Regierungsbaumstr. Weber an."]
    assert got[3][-2:] == ["Dann kam Oberregier.rat.baum. Weber an.", "Es war Oberregier.rat.baum. da."]


def test_shares_are_the_same_whatever_the_block(spark):
    rows = [
        ("a", 1, "d1", "It is tlk. so, and tlk. here. We saw tlk. Velorf there."),
        ("a", 2, "d1", "It is grk. so, and grk. here. We saw grk. Velorf there."),
        ("a", 3, "d2", "Ask the tlk. Velorf left. Ask the grk. Velorf left."),
        ("a", 4, "d2", "The tlk is old. A tlk was new. Any tlk fits. My grk and a grk or the grk fit."),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    one, all_ = (sorted(sentence_units(df, block=n).collect()) for n in (1, 200_000))
    assert one == all_ and sum(r["record_id"] == 3 for r in one) == 4


def test_chains_of_periods_end_in_time():
    assert [t for t, _ in _dots("e.g. x end.Dr. Xy ...Then. U.S.A. b wait...")] == ["e", "e.g", "end", "Dr", "Then", "U", "U.S.A", "wait"]
    assert len(list(_dots("a." * 100_000 + " B"))) == 2 and len(units("a." * 100_000 + " B")) == 2


def test_an_ordinary_end_of_a_sentence_costs_no_row():
    def rows(n):
        b = pd.DataFrame({"field_name": "a", "record_id": range(n), "doc": "d", "text": "The old cat ran. She slept, as ever. Then 3 mice came."})
        return sum(map(len, _scan(iter([b])))), sum(map(len, _look(frozenset({"cf"}), iter([b]))))

    assert rows(1) == rows(50)
    assert rows(50)[1] == 0


def test_words_are_counted_whatever_stands_about_them():
    text = "A cat's cat, (cat) cat_2cat; cat\u00a0cat\u2003½cat 3cat.cat\n«cat»cat\tcat\u3000猫。cat"
    b = pd.DataFrame({"field_name": "a", "record_id": [1, 2], "doc": "d", "text": text})
    counts = pd.concat(_scan(iter([b]))).query("kind == 'all'").set_index("word")["n"].to_dict()
    assert counts == {"A": 2, "cat": 26, "s": 2, "½cat": 2, "猫": 2}


def test_a_wanted_token_is_looked_for_within_its_blanks():
    b = pd.DataFrame({"field_name": "a", "record_id": [1, 2, 3], "doc": ["d", "d", None], "text": ["The (tlk. Xy) and ½tlk. Ab or\ttlk's.", "No e.g. Xy or e.g.\nEnd.", "See tlk. Xy."]})
    got = pd.concat(_look(frozenset({"tlk", "e.g"}), iter([b])))
    sites, shares = got[got["next"].notna()], got[got["next"].isna()]
    assert sorted(zip(sites["record_id"], sites["word"], sites["next"])) == [(1, "tlk", "Ab"), (1, "tlk", "Xy"), (2, "e.g", "Xy"), (3, "tlk", "Xy")]
    assert shares[["doc", "word", "dot", "n"]].values.tolist() == [["d", "tlk", 2, 3]]


def test_a_record_may_go_over_batches():
    rows = [("a", 1, "Ask Dr. Xy. So.", None), ("a", 1, None, "Dr\tXy"), ("b", 1, "Ask Dr. Xy. So.", None), ("b", 1, "One.", None), ("a", 2, "One.", None)]
    batches = [pd.DataFrame([r], columns=["field_name", "record_id", "text", "keep"]) for r in rows]
    for some in (batches, [pd.concat(batches)]):
        got = [r for x in _segment(iter(some)) for r in x.values.tolist()]
        assert sorted(got) == [["a", 1, 0, 11], ["a", 1, 12, 15], ["a", 2, 0, 4], ["b", 1, 0, 4], ["b", 1, 0, 7], ["b", 1, 8, 11], ["b", 1, 12, 15]]
