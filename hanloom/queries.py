"""Queries over the test tables, one for each operator or more, and SQL that gives the same rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import source_queries, word_queries
from .functions import text as tx
from .operators import keywords as kw
from .operators.engine import Engine
from .plans import configs
from .queries_base import spread_small
from .sources import lexicon as lx

_LETTERS = string.ascii_lowercase
# Some characters and their new Japanese forms; ideographs that no short table maps.
OLD_NEW = "舊旧 國国 讀読 賣売 體体 廣広 學学 萬万 圓円 會会 來来 氣気 鐵鉄 澤沢 邊辺 櫻桜 龍竜 齋斎 濱浜 假仮 價価 兒児 勞労 圖図 團団 壓圧".split()
PLAIN = "一二三四五六七八九十百千山川水火木金土日月天地人口目"

#: The runnable configurations that the short tables, and the pairs above, feed.
CHAR_CONFIGS = ("t2tw", "t2twp", "tw2t", "tw2tp", "t2hk", "t2hkp", "hk2t", "hk2tp", "t2jp", "jp2t")


def _lexicon() -> lx.Lexicon:
    base = lx.builtin()
    new = [lx.CustomTable("JPSCharactersRev", tuple((p[0], p[1]) for p in OLD_NEW)), lx.CustomTable("JPSCharacters", tuple((p[1], p[0]) for p in OLD_NEW))]
    return base.with_tables(new)


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, _lexicon())


def alphabet(name: str) -> tuple[str, str]:
    """26 ideographs for the letters and what the configuration makes of them: keys of one character that no longer key holds."""
    lexicon = _lexicon()
    (tables,) = configs.config(name).rounds
    merged: dict[str, str] = {}
    for slot in reversed(tables):
        merged.update(lexicon.table(slot))
    longer = {c for k in merged if len(k) > 1 for c in k}
    keys = [k for k, v in merged.items() if len(k) == len(v) == 1 and k != v and k not in longer]
    keys = (keys + [c for c in PLAIN if c not in merged and c not in longer])[:26]
    return "".join(keys), "".join(merged.get(k, k) for k in keys)


def _han(name: str, text: str = "text") -> Column:
    return F.translate(F.lower(text), _LETTERS, alphabet(name)[0])


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _split(inclusive: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks = tx.split_chunks(F.col("text"), inclusive)
        return _docs(spark, sf_dir).select("doc_id", F.size(chunks).cast("long").alias("n_chunks"), _sha(F.array_join(chunks, "|")).alias("chunks_sha256"))

    return run


def delimiter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(tx.DELIMITER), F.lit(0))
    return _docs(spark, sf_dir).select(F.explode(found).alias("delimiter")).groupBy("delimiter").agg(F.count("*").alias("n"))


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.split_ranges(F.col("text"))).alias("pos", "r"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum("r.start").alias("starts"), F.max("r.end").cast("long").alias("n_bytes"))


def _quoted() -> Column:
    return F.translate("text", ".,!?", "“”‘’")


def punct_to_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _sha(tx.punctuation(_quoted(), "s")).alias("text_sha256"))


def punct_to_curly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _sha(tx.punctuation(F.translate("text", ".,!?", "「」『』"), "t")).alias("text_sha256"))


def _convert(name: str, punct: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", _engine(spark).convert(F.translate(_han(name), ".,", "“”") if punct else _han(name), name, punct).alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), _sha(F.col("t")).alias("text_sha256"))

    return run


def convert_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration a row; the source's number picks a known or an unknown one."""
    name = F.when(F.col("doc_id") % 3 == 0, "T2JP").when(F.col("doc_id") % 3 == 1, "jp2t").otherwise("t2mars")
    return _docs(spark, sf_dir).select("doc_id", _sha(_engine(spark).convert_any(_han("t2jp"), name)).alias("text_sha256"))


def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tx.truncate_utf8(_han("t2jp"), 200)
    return _docs(spark, sf_dir).select("doc_id", F.octet_length(cut).cast("long").alias("n_bytes"), cut.alias("prefix"))


def strip_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _sha(tx.strip_newlines(F.col("text"))).alias("text_sha256"))


def _detect(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, dict, dict]:
    to_simple = {p[0]: p[1] for p in OLD_NEW}
    mixed = F.when(F.col("doc_id") % 3 == 0, _han("t2jp")).when(F.col("doc_id") % 3 == 1, F.translate(_han("t2jp"), "".join(to_simple), "".join(to_simple.values()))).otherwise(F.col("text"))
    return _docs(spark, sf_dir), mixed, to_simple, {v: k for k, v in to_simple.items()}


def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mixed, simple, traditional = _detect(spark, sf_dir)
    return docs.select("doc_id", tx.detect_script(mixed, simple, traditional).alias("script"))


def script_auto_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mixed, simple, traditional = _detect(spark, sf_dir)
    tables = [lx.CustomTable("TSCharacters", tuple(simple.items())), lx.CustomTable("STCharacters", tuple(traditional.items()))]
    engine = Engine(spark, lx.Lexicon().with_tables(tables))
    return docs.select("doc_id", _sha(engine.convert_auto(mixed)).alias("text_sha256"))


def config_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = configs.config_table(spark).select("id", "name", "punct", F.posexplode("rounds").alias("round", "slots"))
    return rows.select("id", "name", "punct", "round", F.posexplode("slots").alias("priority", "slot"))


def slot_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.slot_table(spark).select("name", configs.slot_column(F.upper("name")).alias("slot"))


def lexicon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.key_stats(_lexicon().frame(spark)).select("slot", "entries", F.col("min_len").cast("int").alias("min_len"), F.col("max_len").cast("int").alias("max_len"), "len_mask", F.size("long_lengths").alias("n_long"))


def _changes(docs: DataFrame, mode: Column) -> DataFrame:
    """Changes made of documents: two letters of the language are the slot, the source the key."""
    return docs.select(F.col("doc_id").cast("int").alias("seq"), F.col("lang").alias("slot"), mode.alias("mode"), F.col("source").alias("key"), F.col("n_chars").cast("string").alias("value"))


def overlay_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    base = docs.groupBy(F.col("lang").alias("slot"), F.concat("source", F.lit("0")).alias("key")).agg(F.lit("base").alias("value"))
    return lx.overlay(base, _changes(docs, F.lit("append")))


def overlay_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    base = docs.groupBy(F.col("lang").alias("slot"), F.concat("source", F.lit("0")).alias("key")).agg(F.lit("base").alias("value"))
    return lx.overlay(base, _changes(docs, F.when((F.col("doc_id") % 97 == 0) & (F.col("lang") != "en"), "override").otherwise("append")))


def userdict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", "source", F.col("n_chars").cast("string"))).when(F.col("doc_id") % 5 == 1, F.concat_ws(" ", "source", F.concat(F.lit("+"), F.col("n_chars").cast("string")), "lang")).when(F.col("doc_id") % 5 == 2, F.col("source")).when(F.col("doc_id") % 5 == 3, F.lit("  ")).otherwise(F.concat_ws(" ", "source", F.lit("x1")))
    found = lx.validate_words(_docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), line.alias("line")))
    return found.select("line_no", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("freq", F.lit(-1)).cast("long").alias("freq"), F.coalesce("tag", F.lit("")).alias("tag"), "ok")


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the texts and what the first of two tables that has one makes of it."""
    chars = _docs(spark, sf_dir, "conversations").select(F.explode(F.split(_han("t2tw"), "")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return _engine(spark).lookup(chars, ["TWVariantsPhrases", "TWVariants"])


def _plain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.lower(tx.strip_newlines(F.col("text"))), tx.DELIMITER)
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.posexplode(parts).alias("pos", "term")).where(F.length("term") >= kw.SHORTEST)


def tfidf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.tfidf(_plain_terms(spark, sf_dir), 10).select(F.col("id").alias("doc_id"), "rank", "keyword", F.round("weight", 6).alias("weight"))


def tfidf_tagged_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms tagged n if longer than five characters, x otherwise; only n counts."""
    tagged = F.array(F.struct(F.col("term").alias("word"), F.when(F.length("term") > 5, "n").otherwise("x").alias("tag")))
    kept = _plain_terms(spark, sf_dir).where(F.size(tx.keep_tags(tagged, list(kw.POS_KEYWORDS))) > 0)
    return kw.tfidf(kept, 10).select(F.col("id").alias("doc_id"), "rank", "keyword", F.round("weight", 6).alias("weight"))


def textrank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kw.textrank(_plain_terms(spark, sf_dir), 10).select(F.col("id").alias("doc_id"), "rank", "keyword", F.round("weight", 4).alias("weight"))


# Letter groups whose ideographs are taken for words.
WORDS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "the", "and", "ing", "ion", "that", "tion")


def _words() -> list[str]:
    to = alphabet("t2jp")[0]
    return [w.translate(str.maketrans(_LETTERS, to)) for w in WORDS]


def _segmenting(spark: SparkSession) -> Engine:
    return Engine(spark, lx.Lexicon()).with_words([lx.UserWord(w, 10 * len(w), "n") for w in _words()])


def cut_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token comes, over all turns."""
    tokens = _segmenting(spark).cut(F.regexp_replace(_han("t2jp"), f"[^{alphabet('t2jp')[0]}]", "."), mode="full")
    return _docs(spark, sf_dir, "conversations").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (delimiter_profile, split_ranges, punct_to_corner, punct_to_curly, convert_by_column, utf8_truncate, strip_newlines, script_detect, script_auto_convert, config_dim, slot_dim, lexicon_stats, overlay_append, overlay_override, userdict_validate, dictionary_lookup, tfidf_top10, tfidf_tagged_top10, textrank_top10, cut_full)
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"split_inclusive": _split(True), "split_exclusive": _split(False)}
    out |= {f"{c}_documents": _convert(c) for c in CHAR_CONFIGS}
    out["t2jp_punct"] = _convert("t2jp", True)
    return out | {f.__name__: f for f in plain} | word_queries.queries() | source_queries.queries()


def _han_sql(name: str, text: str = "text") -> str:
    return f"translate(lower({text}), '{_LETTERS}', '{alphabet(name)[0]}')"


def _values(rows: list[tuple]) -> str:
    say = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "values " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


_TERMS = f"""select doc_id as id, unnest(regexp_extract_all(lower(translate(text, chr(13) || chr(10), '')), '{tx.EXCLUSIVE}')) as term from documents"""


def _tfidf_sql(test: str) -> str:
    return f"""with t as (select id, term from ({_TERMS}) where length(term) >= {kw.SHORTEST} and not regexp_matches(term, '{tx.DELIMITER}') and {test}),
n as (select id, term, count(*) as n from t group by id, term), total as (select count(distinct id) as docs from n), df as (select term, count(*) as df from n group by term),
w as (select id, n.term as keyword, n / sum(n) over (partition by id) * ln(docs::double / df) as weight from n join df on n.term = df.term, total),
r as (select *, row_number() over (partition by id order by weight desc, keyword) as rank from w)
select id as doc_id, rank::int as rank, keyword, round(weight, 6) as weight from r where rank <= 10"""


# Number, name, quotation marks and rounds of each configuration; the tables, and other names of tables.
_CONFIGS = """
1 s2t s STPhrases+STCharacters
2 s2tw s STPhrases+STCharacters TWVariantsPhrases+TWVariants
3 s2twp s STPhrases+STCharacters TWPhrases+TWVariantsPhrases+TWVariants
4 s2hk s STPhrases+STCharacters HKVariantsPhrases+HKVariants
5 t2s t TSPhrases+TSCharacters
6 t2tw s TWVariantsPhrases+TWVariants
7 t2twp s TWPhrases+TWVariantsPhrases+TWVariants
8 t2hk s HKVariantsPhrases+HKVariants
9 tw2s t TWVariantsRev+TWVariantsRevPhrases TSPhrases+TSCharacters
10 tw2sp t TWVariantsRev+TWVariantsRevPhrases TWPhrasesRev TSPhrases+TSCharacters
11 tw2t s TWVariantsRev+TWVariantsRevPhrases
12 tw2tp s TWVariantsRev+TWVariantsRevPhrases+TWPhrasesRev
13 hk2s t HKVariantsRevPhrases+HKVariantsRev TSPhrases+TSCharacters
14 hk2t s HKVariantsRevPhrases+HKVariantsRev
15 jp2t s JPSPhrases+JPSCharacters
16 t2jp s JPSCharactersRev
17 s2hkp s STPhrases+STCharacters HKPhrases+HKVariantsPhrases+HKVariants
18 hk2sp t HKPhrasesRev+HKVariantsRevPhrases+HKVariantsRev TSPhrases+TSCharacters
19 t2hkp s HKPhrases+HKVariantsPhrases+HKVariants
20 hk2tp s HKVariantsRevPhrases+HKVariantsRev+HKPhrasesRev
"""
_SLOTS = """
STCharacters STPhrases TSCharacters TSPhrases TWPhrases TWPhrasesRev TWVariants TWVariantsPhrases TWVariantsRev TWVariantsRevPhrases
HKPhrases HKPhrasesRev HKVariants HKVariantsPhrases HKVariantsRev HKVariantsRevPhrases JPSCharacters JPSCharactersRev JPSPhrases
JPShinjitaiCharacters=JPSCharacters JPShinjitaiCharactersRev=JPSCharactersRev JPShinjitaiPhrases=JPSPhrases
"""


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, pattern in (("split_inclusive", tx.INCLUSIVE), ("split_exclusive", tx.EXCLUSIVE)):
        out[name] = f"select doc_id, len(c)::bigint as n_chunks, sha256(array_to_string(c, '|')) as chunks_sha256 from (select doc_id, regexp_extract_all(text, '{pattern}') as c from documents)"
    for c in CHAR_CONFIGS:
        a, b = alphabet(c)
        out[f"{c}_documents"] = f"select doc_id, length(t)::bigint as n_chars, sha256(t) as text_sha256 from (select doc_id, translate({_han_sql(c)}, '{a}', '{b}') as t from documents)"
    a, b = alphabet("t2jp")
    out["t2jp_punct"] = f"select doc_id, length(t)::bigint as n_chars, sha256(t) as text_sha256 from (select doc_id, translate(translate({_han_sql('t2jp')}, '.,', '“”'), '{a}“”', '{b}「」') as t from documents)"
    out["delimiter_profile"] = f"select delimiter, count(*) as n from (select unnest(regexp_extract_all(text, '{tx.DELIMITER}')) as delimiter from documents) group by delimiter"
    out["split_ranges"] = f"""with c as (select conv_id, turn, regexp_extract_all(text, '{tx.INCLUSIVE}') as c from conversations),
e as (select conv_id, turn, i, strlen(c[i]) as size from (select conv_id, turn, c, unnest(range(1, len(c) + 1)) as i from c)),
s as (select *, sum(size) over (partition by conv_id, turn order by i) as stop from e)
select conv_id, turn, count(*) as n, sum(stop - size)::bigint as starts, max(stop)::bigint as n_bytes from s group by conv_id, turn"""
    out["punct_to_corner"] = "select doc_id, sha256(translate(translate(text, '.,!?', '“”‘’'), '“”‘’', '「」『』')) as text_sha256 from documents"
    out["punct_to_curly"] = "select doc_id, sha256(translate(translate(text, '.,!?', '「」『』'), '「」『』', '“”‘’')) as text_sha256 from documents"
    out["convert_by_column"] = f"select doc_id, sha256(case doc_id % 3 when 0 then translate({_han_sql('t2jp')}, '{a}', '{b}') when 1 then translate({_han_sql('t2jp')}, '{b}', '{a}') else 'Invalid config: t2mars' end) as text_sha256 from documents"
    out["utf8_truncate"] = f"""with d as (select doc_id, {_han_sql("t2jp")} as t from documents), c as (select doc_id, t, unnest(range(0, 201)) as n from d),
k as (select doc_id, t, max(n) as n from c where n <= length(t) and strlen(left(t, n)) <= 200 group by doc_id, t) select doc_id, strlen(left(t, n))::bigint as n_bytes, left(t, n) as prefix from k"""
    out["strip_newlines"] = "select doc_id, sha256(translate(text, chr(13) || chr(10), '')) as text_sha256 from documents"
    mixed = f"case doc_id % 3 when 0 then {_han_sql('t2jp')} when 1 then translate({_han_sql('t2jp')}, '{a}', '{b}') else text end"
    prefix = lambda t, n: f"(select left({t}, max(k)) from range(0, {n + 1}) r(k) where k <= length({t}) and strlen(left({t}, k)) <= {n})"
    script = f"""d as (select doc_id, {mixed} as t from documents),
p as (select doc_id, t, regexp_replace({prefix("t", tx.DETECT_FROM)}, '[!-/:-@\\[-`{{-~\\t\\n\\x0B\\f\\r 0-9A-Za-z_著]', '', 'g') as q from d),
s as (select doc_id, t, {prefix("q", tx.DETECT_IN)} as s from p),
x as (select doc_id, t, case when s <> translate(s, '{a}', '{b}') then 1 when s <> translate(s, '{b}', '{a}') then 2 else 0 end as script from s)"""
    out["script_detect"] = f"with {script} select doc_id, script from x"
    out["script_auto_convert"] = f"with {script} select doc_id, sha256(case script when 1 then translate(t, '{a}', '{b}') when 2 then translate(t, '{b}', '{a}') else t end) as text_sha256 from x"
    say = lambda x: x.split()
    rows = [(int(n), name, punct, i, j, slot) for n, name, punct, *rounds in map(say, _CONFIGS.strip().split("\n")) for i, r in enumerate(rounds) for j, slot in enumerate(r.split("+"))]
    out["config_dim"] = "select * from (" + _values(rows) + ") t(id, name, punct, round, priority, slot)"
    out["slot_dim"] = "select * from (" + _values([tuple(x.split("=")) if "=" in x else (x, x) for x in say(_SLOTS)]) + ") t(name, slot)"
    entries = _values([(s, k) for s, t in _lexicon().tables.items() for k in t])
    out["lexicon_stats"] = f"select slot, count(*) as entries, min(length(k))::int as min_len, max(length(k))::int as max_len, bit_or(1::bigint << (length(k) - 1)::int) as len_mask, 0 as n_long from ({entries}) t(slot, k) group by slot"
    base = "select distinct lang as slot, source || '0' as key, 'base' as value, -1 as seq from documents"
    change = "select lang as slot, source as key, n_chars::varchar as value, doc_id::int as seq from documents"
    last = "select slot, key, arg_max(value, seq) as value, length(key)::int as key_len from rows group by slot, key"
    out["overlay_append"] = f"with rows as ({base} union all {change}) {last}"
    out["overlay_override"] = f"with c as (select lang as l, max(doc_id)::int as f from documents where doc_id % 97 = 0 and lang <> 'en' group by lang), rows as (select r.* from ({base} union all {change}) r left join c on r.slot = c.l where f is null or seq >= f) {last}"
    out["userdict_validate"] = """select doc_id as line_no, case when doc_id % 5 < 2 then source else '' end as word, case when doc_id % 5 < 2 then n_chars else -1 end as freq, case when doc_id % 5 = 1 then lang else '' end as tag, doc_id % 5 < 2 as ok from documents where doc_id % 5 <> 3"""
    c, d = alphabet("t2tw")
    pairs = _values([(k, v) for k, v in {**_lexicon().table("TWVariants"), **_lexicon().table("TWVariantsPhrases")}.items()])
    out["dictionary_lookup"] = f"with t as (select token, count(*) as n from (select unnest(string_split({_han_sql('t2tw')}, '')) as token from conversations) where token <> '' group by token), p as (select * from ({pairs}) t(k, value)) select token, n, value from t left join p on token = k"
    out["tfidf_top10"] = _tfidf_sql("true")
    out["tfidf_tagged_top10"] = _tfidf_sql("length(term) > 5")
    words = _values([(w,) for w in _words()])
    out["cut_full"] = f"""with t as (select conv_id, turn, regexp_replace({_han_sql("t2jp")}, '[^{a}]', '.', 'g') as t from conversations),
p as (select t, unnest(range(1, length(t) + 1)) as i from t), w as (select w, length(w) as n from ({words}) x(w)),
k as (select substr(t, i, 1) as token from p union all select w as token from p, w where substr(t, i, n) = w) select token, count(*) as n from k group by token"""
    return out | word_queries.oracle_sql() | source_queries.oracle_sql()
