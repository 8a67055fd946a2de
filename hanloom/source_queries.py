"""Queries over sources, sinks and lexicon checks."""

from __future__ import annotations

import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import HanloomError
from .functions import text as tx
from .operators import keywords as kw
from .operators.converter import Converter
from .operators.engine import Engine
from .plans import configs
from .queries_base import spread_small
from .sources import files, office
from .sources import lexicon as lx
from .streaming import convert as streams
from .word_queries import FIRST, SECOND, table

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def _folder(spark: SparkSession) -> str:
    """A new folder in the warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/hanloom-{uuid.uuid4().hex}"


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines of text files and read again."""
    path = _folder(spark)
    files.write_texts(_docs(spark, sf_dir).select(tx.strip_newlines(F.col("text")).alias("text")), path)
    return spark.read.text(path).groupBy(_sha(F.col("value")).alias("line_sha256")).agg(F.count("*").alias("n"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files read as documents: bytes and lines of all."""
    path = _folder(spark)
    files.write_texts(_docs(spark, sf_dir).select(tx.strip_newlines(F.col("text")).alias("text")), path)
    read = files.read_texts(spark, f"{path}/*.txt")
    return read.agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.length(F.regexp_replace("text", "[^\n]", ""))).alias("n_lines"))


def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in other charsets and back; a byte order mark goes on the way out of UTF-8."""
    wide = files.encode(F.concat(F.lit("﻿"), "text"), "UTF-16LE")
    return _docs(spark, sf_dir).select("doc_id", F.octet_length(wide).cast("long").alias("n_wide"), _sha(files.decode(wide, "UTF-16LE")).alias("wide_sha256"), F.sha2(files.encode(F.col("text"), "UTF-8"), 256).alias("utf8_sha256"))


def broken_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that aren't UTF-8 become U+FFFD."""
    broken = F.concat(F.encode(F.lit("a"), "UTF-8"), F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return _docs(spark, sf_dir).select("doc_id", _sha(files.decode(broken)).alias("text_sha256"))


def newlines_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\rz"))
    return _docs(spark, sf_dir).select("doc_id", _sha(tx.normalise_newlines(tx.strip_bom(odd))).alias("text_sha256"))


def joined_and_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.join_tokens(F.array("lang", "source"), "-").alias("joined"), tx.format_thousands(F.col("doc_id") * 12_345).alias("thousands"))


def config_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in any case, with spaces or unknown; which are configurations."""
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("S2"), F.upper("lang"))).when(F.col("doc_id") % 3 == 1, F.lit("T2Tw")).otherwise(F.lit(" t2s"))
    return _docs(spark, sf_dir).select(name.alias("name"), configs.is_config(name).alias("known")).groupBy("name", "known").agg(F.count("*").alias("n"))


def lexicon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a file and scanned: bad lines go, the last value of a key counts."""
    path = _folder(spark)
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), "source")).when(F.col("doc_id") % 5 == 1, F.lit("no tab")).when(F.col("doc_id") % 5 == 2, F.concat_ws("\t", F.concat("source", "lang"), F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("  w"))))
    line = line.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("\t"), "lang")).otherwise(F.concat_ws("\t", "lang", F.lit("x y")))
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(line.alias("l"), "doc_id").coalesce(1).sortWithinPartitions("doc_id").select(F.col("l").alias("value")).write.text(path)
    return lx.scan_table(spark, path, "STPhrases")


def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon as a compressed pack and back, as rows."""
    made = lx.Lexicon().with_tables(lx.CustomTable(s, tuple(table(s).items())) for s in configs.SLOTS)
    folder = tempfile.mkdtemp()  # the driver's own file
    try:
        lx.write_pack(made, f"{folder}/pack.zst")
        return lx.read_pack(f"{folder}/pack.zst").frame(spark)
    finally:
        shutil.rmtree(folder)


def _says(what: Callable[[], object]) -> str:
    try:
        return str(what())
    except HanloomError as e:
        return type(e).__name__


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of the driver say to good and bad values."""
    folder = tempfile.mkdtemp()
    good, twice, bad = (f"{folder}/{n}.txt" for n in ("good", "twice", "bad"))
    for path, text in ((good, "﻿a\tb c\n# x\n\nd\te\n"), (twice, "a\tb\na\tz\n"), (bad, "a b\n")):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    words = f"{folder}/words.txt"
    with open(words, "w", encoding="utf-8") as f:
        f.write("ab 5 n\n\ncd +7\n")
    base = lx.Lexicon().with_tables([lx.CustomTable("TWVariants", (("a", "1"), ("b", "2")))])
    c = Converter(base, "t2tw")
    rows = [
        ("spec", _says(lambda: lx.parse_spec(f"stphrases:Append:{good}").entries)), ("spec mode", _says(lambda: lx.parse_spec(f"STPhrases:add:{good}"))), ("spec slot", _says(lambda: lx.parse_spec(f"Phrases:append:{good}"))), ("spec file", _says(lambda: lx.parse_spec(f"STPhrases:append:{folder}/none"))),
        ("spec line", _says(lambda: lx.parse_spec(f"STPhrases:append:{bad}"))), ("last counts", _says(lambda: lx.read_custom(twice, "TSPhrases").entries)), ("words", _says(lambda: [(w.word, w.freq, w.tag) for w in lx.read_words(words)])), ("word line", _says(lambda: lx.parse_words("x y z w"))),
        ("no words", _says(lambda: lx.read_words(f"{folder}/none"))), ("empty key", _says(lambda: base.with_tables([lx.CustomTable("TWVariants", (("c", "3"), ("", "x")))]))), ("unchanged", _says(lambda: sorted(base.table("TWVariants").items()))),
        ("override", _says(lambda: sorted(base.with_tables([lx.CustomTable("TWVariants", (("c", "3"),), "override")]).table("twvariants").items()))), ("method", _says(lambda: (kw.method("TextRank"), kw.method("TFIDF"), kw.method("x")))), ("config", _says(lambda: (configs.config("S2TWP").id, configs.config(16).name))),
        ("no config", _says(lambda: configs.config("s2x"))), ("pack", _says(lambda: lx.from_pack(b"{}"))), ("newer pack", _says(lambda: lx.from_pack(b'{"schema_version": 99}'))), ("paths", _says(lambda: files.check_paths(good, f"{folder}/out"))), ("same path", _says(lambda: files.check_paths(good, good))), ("no path", _says(lambda: files.check_paths(f"{folder}/none", None))),
        ("charset", _says(lambda: files.check_charset("latin1"))), ("no charset", _says(lambda: files.check_charset("x-none"))), ("converter", _says(lambda: (c.get_config(), c.convert("ab"), c.convert("“a”", "t2tw", True), c.get_config()))), ("slot alias", configs.slot(" jpshinjitaiphrases ")),
    ]
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "about string, says string")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream: converted, written, and read again."""
    path = _folder(spark)
    engine = Engine(spark, lx.Lexicon().with_tables([lx.CustomTable("TWVariants", tuple(zip(FIRST, SECOND)))]))
    static = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", F.translate(F.lower("text"), _LETTERS, FIRST).alias("text"))
    query = streams.converted(engine, source, "t2tw").writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(path).select("doc_id", _sha(F.col("text")).alias("text_sha256"))


def _document(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in texts:
        out = []
        for t in b.column(1).to_pylist():
            box = io.BytesIO()
            with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:rFonts w:ascii="一"/><w:t>{escape(t or "")}</w:t>')
            out.append(box.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"{i}.docx" for i in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])


def office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in a document file, converted there; font names stay."""
    boxes = _docs(spark, sf_dir).select("doc_id", F.translate(F.lower("text"), _LETTERS, FIRST).alias("text")).mapInArrow(_document, "path string, content binary")
    pairs = tuple(zip(FIRST, SECOND))
    done = office.convert_files(boxes, lambda: Converter(lx.Lexicon().with_tables([lx.CustomTable("TWVariants", pairs)]), "t2tw").convert)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml").decode() for c in b.column(1).to_pylist()]
            cut = [(x.partition("/>")[0], x.partition("<w:t>")[2].removesuffix("</w:t>")) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in cut]), pa.array([unescape(t) for _, t in cut]), b.column(2)], ["path", "head", "text", "parts"])

    read = done.select("path", "content", "parts").mapInArrow(inside, "path string, head string, text string, parts int")
    return read.select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("doc_id"), "head", "parts", _sha(F.col("text")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (text_lines, text_files, charsets, broken_bytes, newlines_and_marks, joined_and_formatted, config_names, lexicon_table, pack_round_trip, checks, streamed, office_documents)}


# What the checks are to say.
_CHECKS = """
spec|(('a', 'b'), ('d', 'e'))
spec mode|EntryError
spec slot|SlotError
spec file|EntryError
spec line|EntryError
last counts|(('a', 'z'),)
words|[('ab', 5, 'n'), ('cd', 7, None)]
word line|UserWordError
no words|LexiconReadError
empty key|EntryError
unchanged|[('a', '1'), ('b', '2')]
override|[('c', '3')]
method|('textrank', 'tfidf', None)
config|(3, 't2jp')
no config|ConfigError
pack|LexiconReadError
newer pack|LexiconVersionError
paths|None
same path|DocumentError
no path|DocumentError
charset|ISO-8859-1
no charset|DocumentError
converter|('t2tw', '12', '「1」', 't2tw')
slot alias|JPSPhrases
"""


def oracle_sql() -> dict[str, str]:
    say = lambda x: "'" + x.replace("'", "''") + "'"
    stripped = "translate(text, chr(13) || chr(10), '')"
    turned = f"sha256(translate(translate(lower(text), '{_LETTERS}', '{FIRST}'), '{FIRST}', '{SECOND}'))"
    entries = ", ".join(f"('{s}', '{k}', '{v}', {len(k)})" for s in configs.SLOTS for k, v in table(s).items())
    return {
        "text_lines": f"select sha256({stripped}) as line_sha256, count(*) as n from documents where text is not null group by 1",
        "text_files": f"select sum(strlen({stripped}) + 1)::bigint as n_bytes, count(*)::bigint as n_lines from documents where text is not null",
        "charsets": "select doc_id, 2 * length(text) + 2 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))::bigint as n_wide, sha256(text) as wide_sha256, sha256(text) as utf8_sha256 from documents",
        "broken_bytes": "select doc_id, sha256('a' || chr(65533) || text || chr(65533)) as text_sha256 from documents",
        "newlines_and_marks": "select doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) || 'z') as text_sha256 from documents",
        "joined_and_formatted": "select doc_id, concat_ws('-', lang, source) as joined, format('{:,}', doc_id * 12345) as thousands from documents",
        "config_names": "select name, name in ('T2Tw') or lower(name) in ('s2t', 's2tw', 's2hk') as known, count(*) as n from (select case doc_id % 3 when 0 then 'S2' || upper(lang) when 1 then 'T2Tw' else ' t2s' end as name from documents) group by 1, 2",
        "lexicon_table": """with l as (select doc_id, case when doc_id % 5 = 2 then source || lang else lang end as key, case when doc_id % 5 = 2 then 'v' || doc_id else 'x' end as value from documents where doc_id % 5 in (2, 4) and lang is not null and source is not null)
select 'STPhrases' as slot, key, arg_max(value, doc_id) as value, length(key)::int as key_len from l group by key""",
        "pack_round_trip": f"select * from (values {entries}) t(slot, key, value, key_len)",
        "checks": "select * from (values " + ", ".join(f"({say(a)}, {say(b)})" for a, b in (x.split("|") for x in _CHECKS.strip().split("\n"))) + ") t(about, says)",
        "streamed": f"select doc_id, {turned} as text_sha256 from documents",
        "office_documents": f"""select doc_id, '<w:rFonts w:ascii="一"' as head, 1 as parts, {turned} as text_sha256 from documents""",
    }
