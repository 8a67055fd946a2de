"""Queries against their SQL on the smallest tables, and what SQL can't tell against plain code."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hanloom import queries
from hanloom.operators import keywords as kw
from hanloom.operators.engine import Engine
from hanloom.operators.matcher import Round, convert
from hanloom.operators.segment import Segmenter
from hanloom.sources import lexicon as lx

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["s2twp_phrases", "hk2sp_phrases", "t2jp_phrases", "convert_mixed", "cut_search", "pos_tag", "sql_functions", "charsets", "lexicon_table", "checks", "streamed", "tfidf_top10"])
def test_query(spark, tables, name):
    got = queries.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = tables.sql(queries.oracle_sql()[name])
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, (tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())))


def test_texts_without_phrases_stay_in_the_engine(spark):
    """The engine's way and the worker's give the same, whichever a text takes."""
    rng = random.Random(2)
    entries = (("甲乙", "丙丁"), ("甲", "戊"), ("乙", "己"), ("戊己", "庚辛"), ("丙", "壬"), ("丁甲乙", "一二三"))
    lexicon = lx.Lexicon().with_tables([lx.CustomTable("STPhrases", entries[:1] + entries[5:]), lx.CustomTable("STCharacters", entries[1:3]), lx.CustomTable("TWVariantsPhrases", entries[3:4]), lx.CustomTable("TWVariants", entries[4:5])])
    texts = [None, "", "abc", *("".join(rng.choice("甲乙丙丁戊己庚辛, a。") for _ in range(rng.randrange(9))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.t for r in df.select(Engine(spark, lexicon).convert("text", "s2tw").alias("t")).collect()]
    rounds, cut = [Round([lexicon.table(s) for s in r]) for r in (("STPhrases", "STCharacters"), ("TWVariantsPhrases", "TWVariants"))], Segmenter(lexicon.vocabulary()).cut_chunk
    assert got == [None if t is None else convert(t, rounds, cut) for t in texts]


def test_textrank_by_matrix(spark):
    """Scores are taken in order of words, each from the newest of the others."""
    rng = random.Random(3)
    rows = [(i, p, rng.choice("abcdefg") * 2) for i in range(6) for p in range(rng.randrange(1, 40))]
    got = {(r.id, r.keyword): r.weight for r in kw.textrank(spark.createDataFrame(rows, "id long, pos int, term string"), 50).collect()}
    for i in range(6):
        words = [w for d, _, w in sorted(rows) if d == i]
        kinds = sorted(set(words))
        link = [[sum(1 for x in range(len(words)) for y in range(len(words)) if 0 < abs(x - y) < 5 and words[x] == a and words[y] == b and a != b) for b in kinds] for a in kinds]
        score = [1.0] * len(kinds)
        for _ in range(10):
            for x in range(len(kinds)):
                score[x] = 0.15 + 0.85 * sum(link[x][y] / sum(link[y]) * score[y] for y in range(len(kinds)) if link[x][y])
        for k, s in zip(kinds, score, strict=True):
            assert got.pop((i, k)) == pytest.approx(s, abs=1e-9)
    assert not got


def test_byte_order_mark_of_the_first_data_line_only(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n﻿a\tb\n﻿c\td\na\tx\n", encoding="utf-8")
    assert {(r.key, r.value) for r in lx.scan_table(spark, str(tmp_path / "t.txt"), "STPhrases").collect()} == {("a", "x"), ("﻿c", "d")}


def test_small_tables_are_spread(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert queries.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert queries.spread_small(many) is many and many.select(F.sum("id")).first()[0] == 4950
