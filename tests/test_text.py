from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("c")).alias("x")).collect())]


def test_tokens_keep_two_bytes_hyphens_and_repeats(spark):
    got = column(spark, ["a è ab don't x-y --", "Cats cats", "", None, "日 本語 1 22 Ab_C"], text.tokens)
    assert got == [["è", "ab", "don", "x-y", "--"], ["cats", "cats"], [], [], ["日", "本語", "22", "ab_c"]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_query_tokens_have_the_token_rule(value):
    for token in text.token_list(value):
        assert len(token.encode()) >= 2 and not any(c.isspace() or c in "!?.,;" for c in token)


def test_query_tokens_equal_column_tokens(spark):
    values = ["The rest-of È_1 a b cc", "ción ΟΔΟΣ x", "--", "किताब पढ़ना", "หนังสือ ที่นี่", "كِتَاب جديد", "e\u0301t\u0301 x\u200dy ①②", "a\u20ddb İstanbul"]
    assert column(spark, values, text.tokens) == [text.token_list(v) for v in values]


def test_trim_takes_unicode_space(spark):
    assert column(spark, [" \t x y 　\n", "", "  "], text.unicode_trim) == ["x y", "", ""]
    assert column(spark, [" ", "a", None], text.is_blank) == [True, False, True]


def test_strip_tags(spark):
    assert column(spark, ["a<b>c<d e>f>g<unclosed", "", "<p>x</p>y"], text.strip_tags) == ["acfg", "", "xy"]


def test_size_switch_counts_bytes(spark):
    assert column(spark, ["é" * 5000, "é" * 5001], text.needs_chunks) == [False, True]


def test_paths(spark):
    paths = ["/a/b.txt", "/a/.txt", "/a.b/c", "d.TXT", "e.tar.pdf"]
    assert column(spark, paths, text.extension) == ["txt", "", "", "TXT", "pdf"]
    assert column(spark, paths, text.has_known_extension) == [True, False, False, False, True]


def test_unknown_counter(spark):
    row = spark.createDataFrame([([100, 3, 100],)], "ids array<int>").select(text.count_id("ids")).first()
    assert row[0] == 2
