"""Keyword ranking over documents as relational plans: TF-IDF and TextRank, with or without tags and weights."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .engine import Engine

# The tags that keywords usually have.
POS_KEYWORDS = ("n", "nr", "ns", "nt", "nz", "v", "vn")
METHODS = ("tfidf", "textrank")
SPAN, DAMPING, ITERATIONS, SHORTEST = 5, 0.85, 10, 2


def method(name: str) -> str | None:
    """In either case; None if there is no such method."""
    return name.lower() if name.lower() in METHODS else None


def terms(engine: Engine, docs: DataFrame, id_col: str, text_col: str, allowed: Sequence[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(id, pos, term): words of ``shortest`` characters or more that hold no delimiter; with ``allowed`` only of those tags."""
    text = tx.strip_newlines(F.col(text_col))
    tags = [a for a in allowed or () if a.strip()]
    if tags:
        rows = docs.select(F.col(id_col).alias("id"), F.posexplode(engine.tag(text)).alias("pos", "t")).where(F.col("t.tag").isin(tags)).select("id", "pos", F.col("t.word").alias("term"))
    else:
        rows = docs.select(F.col(id_col).alias("id"), F.posexplode(engine.cut(text)).alias("pos", "term"))
    return rows.where((F.length("term") >= shortest) & ~F.col("term").rlike(tx.DELIMITER))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(id, rank, keyword, weight): by weight down, then by keyword."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "keyword"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "keyword", "weight")


def tfidf(tokens: DataFrame, k: int, idf: DataFrame | None = None) -> DataFrame:
    """``tokens`` (id, term). Weight: share of the document's terms times ln(N / df) of the corpus, or the weight in ``idf`` (term, idf), the
    median of those for terms it lacks. Counts are summed before they are exchanged."""
    n = tokens.groupBy("id", "term").agg(F.count("*").alias("n"))
    if idf is None:
        # Both read the counts, too, so that the three uses of ``n`` are one and the same exchange, which runs once.
        total = n.groupBy("id").agg(F.sum("n").alias("size")).where("size > 0").agg(F.count("*").alias("docs"))
        idf = n.groupBy("term").agg(F.count("*").alias("df"), F.max("n").alias("most")).where("most > 0")
        idf = idf.crossJoin(F.broadcast(total)).select("term", F.log(F.col("docs") / F.col("df")).alias("idf"))  # one row
        weighed = n.join(idf, "term")
    else:
        middle = idf.agg(F.median("idf").alias("middle"))
        weighed = n.join(idf, "term", "left").crossJoin(F.broadcast(middle)).withColumn("idf", F.coalesce("idf", "middle"))
    size = F.sum("n").over(Window.partitionBy("id"))
    return top(weighed.select("id", F.col("term").alias("keyword"), (F.col("n") / size * F.col("idf")).alias("weight")), k)


def rank_terms(words: Sequence[str], k: int, span: int = SPAN, damping: float = DAMPING, iterations: int = ITERATIONS) -> list[tuple[str, float]]:
    """TextRank over one document: words that stand less than ``span`` apart are linked, as often as they do."""
    links: dict[str, dict[str, float]] = {w: {} for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + span]:
            if a != b:
                links[a][b] = links[a].get(b, 0) + 1
                links[b][a] = links[b].get(a, 0) + 1
    out = {w: sum(x.values()) for w, x in links.items()}
    score = dict.fromkeys(links, 1.0)
    shares = [(w, [(o, x / out[o]) for o, x in sorted(links[w].items())]) for w in sorted(links)]
    for _ in range(iterations):
        for w, near in shares:
            score[w] = 1 - damping + damping * sum([x * score[o] for o, x in near])
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def textrank(tokens: DataFrame, k: int, span: int = SPAN, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``tokens`` (id, pos, term). A document's graph is no larger than its text, so each is ranked in one Arrow call."""
    words = tokens.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))

    @F.arrow_udf("array<struct<keyword:string,weight:double>>")
    def run(rows: pa.Array) -> pa.Array:
        found = [rank_terms(w, k, span, damping, iterations) for w in rows.to_pylist()]
        at = pa.array([0, *accumulate(map(len, found))], pa.int32())
        flat = [x for f in found for x in f]
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.float64())], ["keyword", "weight"]))

    return words.select("id", F.posexplode(run("words")).alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), "x.keyword", "x.weight")


def keywords(engine: Engine, docs: DataFrame, id_col: str, text_col: str, how: str, k: int, allowed: Sequence[str] | None = None, idf: DataFrame | None = None) -> DataFrame:
    """(id, keywords: array of keyword and weight) for every document with terms. Raises for an unknown method."""
    name = method(how)
    if name is None:
        raise ValueError(f"unknown method: {how}")
    tokens = terms(engine, docs, id_col, text_col, allowed)
    ranked = tfidf(tokens, k, idf) if name == "tfidf" else textrank(tokens, k)
    return ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword", "weight"))), lambda x: F.struct(x["keyword"].alias("keyword"), x["weight"].alias("weight"))).alias("keywords"))
