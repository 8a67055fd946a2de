import pytest
from pyspark.sql import functions as F

from hanloom.errors import ConfigError
from hanloom.operators import keywords as kw
from hanloom.operators.engine import Engine
from hanloom.operators.segment import HmmModel, Segmenter
from hanloom.plans import configs
from hanloom.sources.lexicon import CustomTable, Lexicon, UserWord, builtin, derive_han_tables


def run(spark, engine, text, config, punct=False):
    return spark.createDataFrame([(text,)], "t string").select(engine.convert("t", config, punct).alias("x")).first()["x"]


def made(spark, **tables):
    return Engine(spark, Lexicon().with_tables(CustomTable(s, tuple(e.items())) for s, e in tables.items()))


def test_phrase_protects_character(spark):
    e = made(spark, TWVariantsPhrases={"純喫茶": "純喫茶"}, TWVariants={"喫": "吃"})
    assert run(spark, e, "純喫茶", "t2tw") == "純喫茶"
    assert run(spark, e, "喫", "t2tw") == "吃"
    e = made(spark, HKVariantsPhrases={"無線新聞": "無綫新聞"}, HKVariants={"線": "綫"})
    assert run(spark, e, "無線新聞", "t2hk") == "無綫新聞"


def test_first_table_wins_in_one_pass(spark):
    e = made(spark, TWPhrases={"甲": "乙"}, TWVariantsPhrases={"甲": "丁"}, TWVariants={"乙": "丙"})
    assert run(spark, e, "甲", "t2twp") == "乙"
    e = made(spark, TWVariantsRev={"甲": "乙"}, TWVariantsRevPhrases={"甲": "丁"}, TWPhrasesRev={"甲": "戊", "乙": "丙"})
    assert run(spark, e, "甲", "tw2tp") == "乙"
    assert run(spark, e, "甲", "tw2sp") == "丙"  # there the phrases are a round of their own


def test_longest_match_inside_a_token(spark):
    e = made(spark, TWPhrases={"甲乙": "A", "甲": "B", "丙丁": "C"}).with_words([UserWord("甲乙丙丁戊", 1000)])
    assert run(spark, e, "甲乙丙丁戊", "t2twp") == "AC戊"


def test_punctuation_and_nulls(spark):
    e = Engine(spark)
    for c in ("t2tw", "tw2t", "t2hk", "hk2t", "t2jp", "jp2t"):
        assert run(spark, e, "“測試”", c, True) == "「測試」"
        assert run(spark, e, "“測試”", c) == "“測試”"
        assert run(spark, e, None, c) is None
        assert run(spark, e, "", c) == ""
    assert run(spark, e, "鼠標", "t2hkp") == "滑鼠"
    assert run(spark, e, "滑鼠", "hk2tp") == "鼠標"


def test_configs(spark):
    assert [c.id for c in configs.CONFIGS][:5] == [1, 2, 3, 4, 17] and len(configs.BY_ID) == 20
    assert configs.config("T2JP").id == 16 and configs.config(16).name == "t2jp"
    for bad in ("unknown", " t2jp", 0, 21):
        with pytest.raises(ConfigError):
            configs.config(bad)
    e = Engine(spark)
    assert spark.createDataFrame([("x", "unknown")], "t string, c string").select(e.convert_any(F.col("t"), F.col("c")).alias("x")).first()["x"] == "Invalid config: unknown"


def test_derived_tables(spark):
    e = Engine(spark, derive_han_tables(spark, builtin()))
    assert run(spark, e, "你好，世界！“龙马精神”！", "s2t", True) == "你好，世界！「龍馬精神」！"
    assert run(spark, e, "龍馬精神", "t2s") == "龙马精神"
    rows = spark.createDataFrame([("你好，世界！龙马精神！",), ("龍馬",), ("abc",)], "t string").select(e.detect_script(F.col("t")).alias("d"), e.convert_auto(F.col("t")).alias("c")).collect()
    assert [r.d for r in rows] == [2, 1, 0] and rows[1].c == "龙马" and rows[2].c == "abc"


def test_segmentation(spark):
    words = [UserWord(w, 1000, "n") for w in ("云计算", "区块链", "技术", "幾千", "千隻", "幾千隻", "便是")]
    s = Segmenter(Lexicon().with_words(words).vocabulary())
    assert s.cut("云计算和区块链技术，OpenAI") == ["云计算", "和", "区块链", "技术", "，", "OpenAI"]
    assert s.search("幾千隻") == ["幾千", "千隻", "幾千隻"]
    assert s.full("便是美") == ["便", "便是", "是", "美"]
    assert s.tag("云计算3abc") == [("云计算", "n"), ("3abc", "eng")]
    assert s.cut("") == [] and "".join(s.cut("a，b 云计算\n")) == "a，b 云计算\n"
    assert Segmenter(Lexicon().with_words([UserWord("火星詞", 100000)]).vocabulary()).cut("火星詞") == ["火星詞"]
    assert Segmenter(Lexicon().with_words([UserWord("T恤", 10)]).vocabulary()).cut("買T恤。") == ["買", "T恤", "。"]
    hmm = HmmModel({"B": -0.5, "S": -1.0}, {"B": {"E": -0.1, "M": -3}, "M": {"E": -0.5, "M": -1}, "E": {"B": -0.5, "S": -0.7}, "S": {"B": -0.7, "S": -0.7}}, {"B": {"數": -1}, "E": {"大": -1}}, -9)
    assert Segmenter({}, hmm).cut("數大", True) == ["數大"] and Segmenter({}, hmm).cut("數大") == ["數", "大"]


def test_columns_and_sql(spark):
    from hanloom.functions.register import register

    e = Engine(spark).with_words([UserWord("幾千隻", 100, "m"), UserWord("綿羊", 100, "n")])
    assert spark.createDataFrame([("幾千隻綿羊",)], "t string").select(e.cut_and_join(F.col("t"), "/").alias("x")).first()["x"] == "幾千隻/綿羊"
    register(e)
    assert spark.sql("select han_cut('幾千隻綿羊') as c, han_convert('喫', 'T2TW') as t, han_convert('a', 'no') as n, han_to_corner('“a”') as p, size(han_split('a,b')) as k").first() == (["幾千隻", "綿羊"], "吃", "Invalid config: no", "「a」", 2)
    assert [r.word for r in spark.sql("select word from han_segment('幾千隻綿羊') order by pos").collect()] == ["幾千隻", "綿羊"]
    tokens = spark.createDataFrame([("喫",), ("無",)], "token string")
    assert {r.token: r.value for r in e.lookup(tokens, ["TWVariantsPhrases", "TWVariants"]).collect()} == {"喫": "吃", "無": None}


def test_keywords(spark):
    e = Engine(spark).with_words([UserWord(w, 100, t) for w, t in (("綿羊", "n"), ("山坡", "n"), ("碧綠", "a"), ("美麗", "a"))])
    docs = spark.createDataFrame([(1, "碧綠的山坡，綿羊\n美麗的綿羊。綿羊"), (2, "山坡"), (3, None), (4, "")], "id long, text string")
    for how in ("tfidf", "TextRank"):
        found = {r.id: [k.keyword for k in r.keywords] for r in kw.keywords(e, docs, "id", "text", how, 3).collect()}
        assert set(found) == {1, 2} and len(found[1]) == 3 and "綿羊" in found[1]
        only = {r.id: r.keywords for r in kw.keywords(e, docs, "id", "text", how, 10, ["n"]).collect()}
        assert {k.keyword for k in only[1]} == {"綿羊", "山坡"} and all(k.weight >= 0 for k in only[1])
    idf = spark.createDataFrame([("綿羊", 2.0), ("山坡", 1.0)], "term string, idf double")
    assert kw.tfidf(kw.terms(e, docs, "id", "text"), 1, idf).where("id = 1").first()["keyword"] == "綿羊"
    with pytest.raises(ValueError):
        kw.keywords(e, docs, "id", "text", "bm25", 1)


def test_stream(spark, tmp_path):
    from hanloom.streaming import convert as sc

    spark.createDataFrame([("喫",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = sc.converted(Engine(spark), spark.readStream.schema("text string").parquet(str(tmp_path / "in")), "t2tw")
    q = sc.write(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text or "" for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "吃"]


def test_converter():
    import hanloom
    from hanloom.operators.converter import Converter

    c = Converter(value="t2tw")
    assert c.convert("喫“茶”", punct=True) == "吃「茶」" and c.convert("喫", "t2hk") == "吃" and c.get_config() == "t2tw"
    with pytest.raises(ConfigError):
        c.set_config("t2mars")
    assert c.get_config() == "t2tw" and hanloom.abi_number() == 1 and hanloom.version_string() == hanloom.__version__
