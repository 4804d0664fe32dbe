import hashlib
import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_token_estimate(spark):
    assert [one(spark, t, T.token_estimate) for t in ("", "a", "abcd", "abcde", "é" * 4, None)] == [0, 1, 1, 2, 2, None]


def test_uuid5_is_the_standard_one(spark):
    for name in ("", "a", "chunk-7", "é"):
        assert one(spark, name, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS if False else uuid.UUID(hex=T.NAMESPACE), name))


def test_query_terms_keep_order_and_drop_repeats(spark):
    assert one(spark, "Why now, why THEN? été", T.query_terms) == ["why", "now", "then", "été"]


def test_slug_and_paths(spark):
    assert one(spark, "  Heat -- Exchange! ", T.slug) == "heat-exchange"
    assert one(spark, "¿?", T.slug) == "lesson"
    assert [one(spark, p, T.safe_path) for p in ("a/b.txt", "a//b", "../x", "C:/x", "a\\b")] == [True, False, False, False, False]


def test_srt_time_and_speech(spark):
    assert one(spark, 3_661_007, T.srt_time, "long") == "01:01:01,007"
    assert one(spark, 0, T.speech_seconds, "int") == 2.0
    assert one(spark, 150, T.speech_seconds, "int") == 60.5


def test_markdown_and_equations(spark):
    assert one(spark, "# Head\n- **a** `b`", T.strip_markdown) == "Head\na b"
    assert one(spark, "$x − 2$ = y", T.compact_equation) == "x-2=y"


def test_one_line_caps_with_an_ellipsis(spark):
    assert one(spark, "a\n b\t c", T.one_line) == "a b c"
    assert len(one(spark, "x" * 400, T.one_line)) == 300


def test_content_key(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    assert one(spark, sha, T.content_key) == f"objects/{sha[:2]}/{sha}/source.pdf"
