"""Queries over phrases and words, with tables made by rule, and SQL that segments and converts by enumeration."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.register import register
from .operators import keywords as kw
from .operators.engine import Engine
from .operators.matcher import Round
from .plans import configs
from .queries_base import spread_small
from .sources import lexicon as lx

_LETTERS = string.ascii_lowercase
# An ideograph for each letter, and others that tables turn those into.
FIRST = "一二三四五六七八九十百千山川水火木金土日月天地人口目"
SECOND = "東西南北春夏秋冬風雨雲雪花草竹石田心手足耳身大小多少"
# Letter groups that are phrases, and those that are user words, with counts.
PHRASES = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "the", "and", "ing", "ion", "that", "tion")
USER = {"ther": 50, "hing": 40, "ent": 60, "here": 30, "nde": 25}


def _spelled(word: str, alphabet: str = FIRST, shift: int = 0) -> str:
    return "".join(alphabet[(_LETTERS.index(c) + shift) % 26] for c in word)


def table(slot: str) -> dict[str, str]:
    """Entries of a slot, by its number: phrases of every second group, single characters of every third letter, and keys among what other
    rounds write. A value is as long as its key."""
    k = configs.SLOTS.index(slot)
    out = {_spelled(w): _spelled(w, SECOND, k) for j, w in enumerate(PHRASES) if (j + k) % 2 == 0}
    out |= {FIRST[i]: SECOND[(i + k) % 26] for i in range(26) if (i + k) % 3 == 0}
    out |= {SECOND[i]: FIRST[(i + k) % 26] for i in range(26) if (i + k) % 4 == 0}
    return out | {SECOND[i] + SECOND[(i + 1) % 26]: FIRST[i] + SECOND[i] for i in range(26) if (i + k) % 5 == 0}


def _lexicon(name: str | None) -> lx.Lexicon:
    slots = {s for r in configs.config(name).rounds for s in r} if name else set()
    made = lx.Lexicon().with_tables(lx.CustomTable(s, tuple(table(s).items())) for s in configs.SLOTS if s in slots)
    if not name:
        return made.with_words([*(lx.UserWord(_spelled(w), 10 * len(w), "v" if len(w) == 2 else None) for w in PHRASES), *(lx.UserWord(_spelled(w), n, "n") for w, n in USER.items())])
    return made.with_words(lx.UserWord(_spelled(w), n, "n") for w, n in USER.items())


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _text() -> Column:
    """Letters as ideographs, in runs of four at most, so that SQL can list the ways to cut one."""
    return F.translate(F.regexp_replace(F.lower("text"), "([a-z]{4})", "$1 "), _LETTERS, FIRST)


def _dotted() -> Column:
    return F.regexp_replace(_text(), f"[^{FIRST}]", ".")


def _sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _convert(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        converted = Engine(spark, _lexicon(name)).convert(_text(), name)
        return _docs(spark, sf_dir).select("doc_id", converted.alias("t")).select("doc_id", F.length("t").cast("long").alias("n_chars"), _sha(F.col("t")).alias("text_sha256"))

    return run


def convert_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration a row, all of one lexicon; a few are unknown."""
    name = F.when(F.col("doc_id") % 4 == 0, "T2S").when(F.col("doc_id") % 4 == 1, "t2tw").when(F.col("doc_id") % 4 == 2, "s2t").otherwise("no")
    engine = Engine(spark, lx.Lexicon().with_tables(lx.CustomTable(s, tuple(table(s).items())) for s in MIXED))
    return _docs(spark, sf_dir).select("doc_id", _sha(engine.convert_any(_text(), name)).alias("text_sha256"))


#: The slots of the configurations that ``convert_mixed`` names.
MIXED = ("STPhrases", "STCharacters", "TSPhrases", "TSCharacters", "TWVariantsPhrases", "TWVariants")


def cut_accurate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Engine(spark, _lexicon(None)).cut(_dotted())
    return _docs(spark, sf_dir).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), _sha(F.array_join("t", "/")).alias("tokens_sha256"))


def cut_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Engine(spark, _lexicon(None)).cut_and_join(_dotted(), "/", mode="search")
    return _docs(spark, sf_dir).select("doc_id", _sha(tokens).alias("tokens_sha256"))


def pos_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tx.format_tags(Engine(spark, _lexicon(None)).tag(_dotted()))
    return _docs(spark, sf_dir).select("doc_id", _sha(tagged).alias("tagged_sha256"))


def keywords_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords over the engine's own words, with tags, of both kinds of tag that words have here."""
    docs = _docs(spark, sf_dir).select("doc_id", _dotted().alias("t"))
    found = kw.keywords(Engine(spark, _lexicon(None)), docs, "doc_id", "t", "TFIDF", 8, ["n", "v"])
    return found.select(F.col("id").alias("doc_id"), F.posexplode("keywords").alias("rank", "k")).select("doc_id", "rank", "k.keyword", F.round("k.weight", 6).alias("weight"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    register(Engine(spark, _lexicon("t2tw").with_tables([lx.CustomTable("TSCharacters", tuple(zip(FIRST, SECOND))), lx.CustomTable("STCharacters", tuple(zip(SECOND, FIRST)))])))
    mixed = F.when(F.col("doc_id") % 2 == 0, _text()).otherwise(F.translate(_text(), FIRST, SECOND))
    _docs(spark, sf_dir).select("doc_id", mixed.alias("t"), F.translate("text", ".,", "“”").alias("q")).createOrReplaceTempView("han_documents")
    return spark.sql(
        """select doc_id, sha2(han_convert(if(doc_id % 2 = 0, t, ''), 'T2TW'), 256) as converted, han_detect(t) as script, sha2(han_to_corner(q), 256) as corner,
        sha2(han_punct(han_to_corner(q), 't2s'), 256) as curly, size(han_split(q)) as n_chunks, han_is_delimiter(left(q, 1)) as starts, han_convert(t, 'x') as unknown from han_documents"""
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"{c.name}_phrases": _convert(c.name) for c in configs.CONFIGS}
    return out | {f.__name__: f for f in (convert_mixed, cut_accurate, cut_search, pos_tag, keywords_tagged, sql_functions)}


def _list(xs: object) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(float(x)) for x in xs) + "]"


def _map(m: Mapping) -> str:
    return f"map({_list(m)}, {_list(m.values())})"


_SQL_TEXT = f"translate(regexp_replace(lower(text), '([a-z]{{4}})', '\\1 ', 'g'), '{_LETTERS}', '{FIRST}')"
_WAYS = [(n, *ls, *[0] * (4 - len(ls))) for n in range(1, 5) for ls in sorted({tuple(map(len, "".join(c + ("|" if m >> i & 1 else "") for i, c in enumerate("x" * n)).strip("|").split("|"))) for m in range(1 << (n - 1))})]


def _cut_sql(lexicon: lx.Lexicon, runs: str, name: str) -> str:
    """CTE ``name`` (r, t1 .. t4) of the best way to cut each run in ``runs`` (r): of all ways the one of the greatest product of frequencies, the
    longer word first among equals; a run that is a word is not cut."""
    words = lexicon.vocabulary()
    total = math.log(sum(f for f, _ in words.values()) + 1)
    weights = _map({w: math.log(f) - total for w, (f, _) in words.items()})
    parts = ", ".join(f"substr(r, 1 + {' + '.join(['0', *(f'l{j}' for j in range(1, i))])}, l{i}) as t{i}" for i in range(1, 5))
    value = lambda i: f"coalesce(w[t{i}], case length(t{i}) when 1 then {-total!r} when 0 then 0.0 end)"
    return f"""{name}_w as (select {weights} as w), {name}_c as (select r, l1, l2, l3, {parts} from {runs} join (values {", ".join(map(str, _WAYS))}) x(n, l1, l2, l3, l4) on n = length(r)),
{name}_s as (select *, {value(1)} + ({value(2)} + ({value(3)} + {value(4)})) as s, w[r] is not null and l1 = length(r) as whole from {name}_c, {name}_w),
{name} as (select r, t1, t2, t3, t4 from (select *, row_number() over (partition by r order by whole desc, s desc, l1 desc, l2 desc, l3 desc) as k from {name}_s where s is not null) where k = 1)"""


def _token_sql(t: str) -> str:
    """A token of four characters at most by the map ``m``: whole, or by the longest keys from left to right; by character if short."""
    one = lambda e: f"coalesce(m[{e}], {e})"

    def longest(at: int, left: int, n: int) -> str:
        if left < 2:
            return one(f"substr({t}, {at}, 1)") if left else "''"
        tried = " ".join(f"when m[substr({t}, {at}, {k})] is not null then m[substr({t}, {at}, {k})] || {longest(at + k, left - k, n)}" for k in range(left, 1, -1))
        return f"(case {tried} else {one(f'substr({t}, {at}, 1)')} || {longest(at + 1, left - 1, n)} end)"

    cases = f"when 0 then '' when 1 then {one(t)} when 2 then coalesce(m[{t}], {one(f'substr({t}, 1, 1)')} || {one(f'substr({t}, 2, 1)')})"
    return f"case length({t}) {cases} when 3 then {longest(1, 3, 3)} else {longest(1, 4, 4)} end"


def _rounds_sql(lexicon: lx.Lexicon, rounds: list[dict[str, str]], pieces: str, tag: str) -> str:
    """CTE ``<tag>_done`` (r, o): what the runs among ``pieces`` (p) become."""
    out, source = [], f"(select distinct p as r from {pieces} where p[1:1] in ({', '.join(repr(c) for c in FIRST + SECOND)}))"
    for i, m in enumerate(rounds):
        cut = _cut_sql(lexicon, source, f"{tag}{i}")
        out.append(f"{cut}, {tag}{i}_m as (select {_map(m)} as m), {tag}{i}_o as (select r, {' || '.join(_token_sql(f't{k}') for k in range(1, 5))} as o from {tag}{i}, {tag}{i}_m)")
        source = f"(select distinct o as r from {tag}{i}_o)"
    joined = f"{tag}0_o" + "".join(f" join (select r as r{i}, o as o{i} from {tag}{i}_o) on r{i} = {'o' if i == 1 else f'o{i - 1}'}" for i in range(1, len(rounds)))
    last = f"o{len(rounds) - 1}" if len(rounds) > 1 else "o"
    return ", ".join(out) + f", {tag}_done as (select r, {last} as done from {joined})"


_PIECES = f"""doc as (select doc_id, regexp_extract_all({_SQL_TEXT}, '[{FIRST}{SECOND}]+|[^{FIRST}{SECOND}]+') as ps from documents),
pieces as (select doc_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i from doc)"""


def _convert_sql(name: str) -> str:
    lexicon = _lexicon(name)
    rounds = [Round([dict(lexicon.table(s)) for s in r]).map for r in configs.config(name).rounds]
    return f"""with {_PIECES}, {_rounds_sql(lexicon, rounds, "pieces", "a")},
whole as (select doc_id, string_agg(coalesce(done, p), '' order by i) as t from pieces left join a_done on p = r group by doc_id)
select doc.doc_id, length(coalesce(t, ''))::bigint as n_chars, sha256(coalesce(t, '')) as text_sha256 from doc left join whole on doc.doc_id = whole.doc_id where ps is not null"""


def _tokens_sql() -> str:
    """CTEs up to ``token`` (doc_id, i, k, w): each word, in order."""
    text = f"regexp_replace({_SQL_TEXT}, '[^{FIRST}]', '.', 'g')"
    return f"""doc as (select doc_id, regexp_extract_all({text}, '[{FIRST}]+|[.]') as ps from documents), pieces as (select doc_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i from doc),
{_cut_sql(_lexicon(None), "(select distinct p as r from pieces where p <> '.')", "c")}, cuts as (select r, list_filter([t1, t2, t3, t4], lambda x: x <> '') as ws from c union all select '.', ['.']),
token as (select doc_id, i, unnest(range(1, len(ws) + 1)) as k, unnest(ws) as w from pieces join cuts on p = r)"""


def oracle_sql() -> dict[str, str]:
    out = {f"{c.name}_phrases": _convert_sql(c.name) for c in configs.CONFIGS}
    mixed = lx.Lexicon().with_tables(lx.CustomTable(s, tuple(table(s).items())) for s in MIXED)
    rounds = {n: [Round([dict(mixed.table(s)) for s in r]).map for r in configs.config(n).rounds] for n in ("t2s", "t2tw", "s2t")}
    done = ", ".join(_rounds_sql(mixed, m, f"(select p from pieces where doc_id % 4 = {i})", n) for i, (n, m) in enumerate(rounds.items()))
    cases = " ".join(f"when {i} then coalesce(x{i}.done, p)" for i in range(3))
    joins = " ".join(f"left join {n}_done x{i} on p = x{i}.r and doc_id % 4 = {i}" for i, n in enumerate(rounds))
    out["convert_mixed"] = f"""with {_PIECES}, {done}, whole as (select doc_id, string_agg(case doc_id % 4 {cases} end, '' order by i) as t from pieces {joins} where doc_id % 4 < 3 group by doc_id)
select doc.doc_id, sha256(case when doc.doc_id % 4 = 3 then 'Invalid config: no' else coalesce(t, '') end) as text_sha256 from doc left join whole on doc.doc_id = whole.doc_id"""
    words = _lexicon(None).vocabulary()
    out["cut_accurate"] = f"""with {_tokens_sql()} select doc_id, count(*) as n_tokens, sha256(string_agg(w, '/' order by i, k)) as tokens_sha256 from token group by doc_id"""
    known = ", ".join(f"'{w}'" for w in words)
    part = lambda n: f"case when length(w) > {n} then list_filter(list_transform(range(1, length(w) - {n - 2}), lambda j: substr(w, j, {n})), lambda x: x in ({known})) else [] end"
    out["cut_search"] = f"""with {_tokens_sql()}, kinds as (select w, array_to_string(list_concat({part(2)}, {part(3)}, [w]), '/') as s from (select distinct w from token))
select doc_id, sha256(string_agg(s, '/' order by i, k)) as tokens_sha256 from token join kinds on token.w = kinds.w group by doc_id"""
    tags = _map({w: t for w, (_, t) in words.items() if t} | {".": "m"})
    out["pos_tag"] = f"""with {_tokens_sql()}, tags as (select {tags} as m) select doc_id, sha256(string_agg(w || '/' || coalesce(m[w], 'x'), ' ' order by i, k)) as tagged_sha256 from token, tags group by doc_id"""
    kept = ", ".join(f"'{w}'" for w, (_, t) in words.items() if t in ("n", "v"))
    out["keywords_tagged"] = f"""with {_tokens_sql()}, n as (select doc_id, w, count(*) as n from token where w in ({kept}) group by doc_id, w), total as (select count(distinct doc_id) as docs from n),
df as (select w, count(*) as df from n group by w), x as (select doc_id, n.w as keyword, n / sum(n) over (partition by doc_id) * ln(docs::double / df) as weight from n join df on n.w = df.w, total),
r as (select *, row_number() over (partition by doc_id order by weight desc, keyword) - 1 as rank from x) select doc_id, rank::int as rank, keyword, round(weight, 6) as weight from r where rank < 8"""
    lexicon = _lexicon("t2tw").with_tables([lx.CustomTable("TSCharacters", tuple(zip(FIRST, SECOND))), lx.CustomTable("STCharacters", tuple(zip(SECOND, FIRST)))])
    m = [Round([dict(lexicon.table(s)) for s in configs.config("t2tw").rounds[0]]).map]
    prefix = lambda t, n: f"(select left({t}, max(k)) from range(0, {n + 1}) r(k) where k <= length({t}) and strlen(left({t}, k)) <= {n})"
    out["sql_functions"] = f"""with {_PIECES}, {_rounds_sql(lexicon, m, "pieces", "a")},
whole as (select doc_id, string_agg(coalesce(done, p), '' order by i) as t from pieces left join a_done on p = r where doc_id % 2 = 0 group by doc_id),
d as (select doc_id, case when doc_id % 2 = 0 then {_SQL_TEXT} else translate({_SQL_TEXT}, '{FIRST}', '{SECOND}') end as t, translate(text, '.,', '“”') as q from documents),
p as (select *, regexp_replace({prefix("t", tx.DETECT_FROM)}, '[!-/:-@\\[-`{{-~\\t\\n\\x0B\\f\\r 0-9A-Za-z_著]', '', 'g') as s from d), s as (select doc_id, t, q, {prefix("s", tx.DETECT_IN)} as s from p)
select s.doc_id, sha256(coalesce(whole.t, '')) as converted, case when s <> translate(s, '{FIRST}', '{SECOND}') then 1 when s <> translate(s, '{SECOND}', '{FIRST}') then 2 else 0 end as script,
sha256(translate(q, '“”‘’', '「」『』')) as corner, sha256(translate(translate(q, '“”‘’', '「」『』'), '「」『』', '“”‘’')) as curly, len(regexp_extract_all(q, '{tx.INCLUSIVE}'))::int as n_chunks,
regexp_matches(left(q, 1), '^{tx.DELIMITER}$') as starts, 'Invalid config: x' as unknown from s left join whole on s.doc_id = whole.doc_id"""
    return out
