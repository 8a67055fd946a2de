from pyspark.sql import functions as F

from hanloom.functions import text as tx


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_ranges(spark):
    cases = {
        "你好，世界！": ([(0, 9), (9, 18)], [(0, 6), (6, 9), (9, 15), (15, 18)]),
        "Hello,World!Rust.": ([(0, 6), (6, 12), (12, 17)], [(0, 5), (5, 6), (6, 11), (11, 12), (12, 16), (16, 17)]),
        "HelloWorld": ([(0, 10)], [(0, 10)]),
        "，Hello": ([(0, 3), (3, 8)], [(0, 3), (3, 8)]),
        ",,,": ([(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 3)]),
        "": ([], []),
    }
    for text, expected in cases.items():
        for inclusive, want in zip((True, False), expected, strict=True):
            assert [tuple(r) for r in one(spark, text, lambda t, i=inclusive: tx.split_ranges(t, i))] == want
    assert one(spark, None, tx.split_ranges) is None


def test_delimiters(spark):
    chars = [chr(c) for a, b in tx.DELIMITERS for c in range(a, b + 1)]
    assert len(chars) == 100
    rows = spark.createDataFrame([(c,) for c in [*chars, "`", "a", "你", "🙂", ""]], "c string").select("c", tx.is_delimiter(F.col("c")).alias("d")).collect()
    assert all(r.d == (r.c in chars) for r in rows)


def test_punctuation(spark):
    assert one(spark, "“測試”‘x’", lambda t: tx.punctuation(t, "s")) == "「測試」『x』"
    assert one(spark, "「測試」『x』", lambda t: tx.punctuation(t, "t")) == "“測試”‘x’"
    assert one(spark, "“a”", lambda t: tx.punctuation(t, "?")) == "“a”"


def test_truncate(spark):
    for text, n, want in (("你好abc", 7, "你好a"), ("你好", 2, ""), ("🙂🙂", 7, "🙂"), ("abc", 10, "abc"), ("", 0, ""), ("你", 0, "")):
        assert one(spark, text, lambda t, n=n: tx.truncate_utf8(t, n)) == want


def test_detect(spark):
    ts, st = {"龍": "龙", "馬": "马"}, {"龙": "龍", "马": "馬"}
    for text, want in (("", 0), ("hello", 0), ("龙马", 2), ("龍马", 1), (" a著!", 0), (None, None)):
        assert one(spark, text, lambda t: tx.detect_script(t, ts, st)) == want


def test_small_functions(spark):
    assert one(spark, "a\r\nb\n", tx.strip_newlines) == "ab"
    assert one(spark, "a\r\nb\rc", tx.normalise_newlines) == "a\nb\nc"
    assert one(spark, "﻿x", tx.strip_bom) == "x"
    assert spark.range(1).select(tx.format_thousands(F.lit(1234567)).alias("x")).first()["x"] == "1,234,567"
    tagged = F.array(F.struct(F.lit("a").alias("word"), F.lit("n").alias("tag")), F.struct(F.lit("b").alias("word"), F.lit("x").alias("tag")))
    assert spark.range(1).select(tx.format_tags(tagged).alias("x")).first()["x"] == "a/n b/x"
    assert spark.range(1).select(F.size(tx.keep_tags(tagged, ["n"])).alias("x"), F.size(tx.keep_tags(tagged, [" "])).alias("y")).first() == (1, 2)
