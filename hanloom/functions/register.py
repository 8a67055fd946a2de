"""The operators as SQL functions of a session."""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.engine import Engine
from ..operators.keywords import rank_terms
from ..plans.configs import CONFIGS
from .text import CORNER, CURLY, DELIMITER, DETECT_FROM, DETECT_IN, INCLUSIVE, NOT_HAN


def _detector(traditional: frozenset[str], simplified: frozenset[str]):
    """The same test as ``text.detect_script``, for SQL."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            seen = set(re.sub(NOT_HAN, "", t.encode()[:DETECT_FROM].decode(errors="ignore")).encode()[:DETECT_IN].decode(errors="ignore"))
            return 1 if seen & traditional else 2 if seen & simplified else 0

        return pa.array(map(one, texts.to_pylist()), pa.int32())

    return run


def register(engine: Engine, prefix: str = "han_") -> list[str]:
    """Registers ``<prefix>convert(text, config)``, detect, cut, cut_search, cut_all, tag, and the table functions segment
    and keywords. Functions that the engine's own expressions cover come as SQL functions: split, to_corner, to_curly, punct (by
    configuration), is_delimiter. Returns the names."""
    spark, segmenter = engine.spark, engine._segmenter()
    differing = [frozenset(k for k, v in engine.lexicon.table(s).items() if len(k) == 1 and k != v[:1]) for s in ("TSCharacters", "STCharacters")]

    @udtf(returnType="pos: int, word: string, tag: string", useArrow=True)
    class Segment:
        def eval(self, text: str):
            for i, (w, p) in enumerate(segmenter().tag(text or "")):
                yield i, w, p

    @udtf(returnType="rank: int, keyword: string, weight: double", useArrow=True)
    class Keywords:
        def eval(self, text: str, k: int):
            words = [w for w in segmenter().cut(text or "") if len(w) > 1]
            for i, (w, x) in enumerate(rank_terms(words, k), 1):
                yield i, w, x

    scalar = {"convert": engine.convert_udf(CONFIGS, "Invalid config: "), "detect": _detector(*differing), "cut": engine.cut_udf(), "cut_search": engine.cut_udf(mode="search"), "cut_all": engine.cut_udf(mode="full"), "tag": engine.tag_udf()}
    for name, f in scalar.items():
        spark.udf.register(prefix + name, f)
    for name, f in (("segment", Segment), ("keywords", Keywords)):
        spark.udtf.register(prefix + name, f)
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    style = lambda s: ", ".join(f"'{c.name}'" for c in CONFIGS if c.punct == s)
    own = {
        "to_corner(text STRING)": ("STRING", f"translate(text, '{quote(CURLY)}', '{CORNER}')"),
        "to_curly(text STRING)": ("STRING", f"translate(text, '{CORNER}', '{quote(CURLY)}')"),
        "punct(text STRING, config STRING)": ("STRING", f"CASE WHEN lower(config) IN ({style('s')}) THEN translate(text, '{quote(CURLY)}', '{CORNER}') WHEN lower(config) IN ({style('t')}) THEN translate(text, '{CORNER}', '{quote(CURLY)}') ELSE text END"),
        "split(text STRING)": ("ARRAY<STRING>", f"regexp_extract_all(text, '{quote(INCLUSIVE)}', 0)"),
        "is_delimiter(c STRING)": ("BOOLEAN", f"c rlike '^{quote(DELIMITER)}$'"),
    }
    for head, (kind, body) in own.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS {kind} RETURN {body}")
    return [prefix + n for n in (*scalar, "segment", "keywords", *(h.partition("(")[0] for h in own))]
