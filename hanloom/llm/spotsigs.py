"""SpotSigs: chains of content words that follow common words are a document's signatures; sets of them are its fingerprint."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, map_arrow, slices, text_or_empty
from .components import connected_components

#: Content words in a chain; likeness of near-duplicates.
CHAIN, LIKE = 2, 0.8
# Common words of English, French, German and Spanish, at which signatures are anchored.
ANCHORS = tuple(
    "the a an of and to in is was are be that this it for on with as at by or from not he she they "
    "le la les un une des du de et est en que qui dans pour par sur au aux avec ce il elle pas ne "
    "der die das den dem ein eine und ist zu von mit auf für im nicht sich es auch "
    "el los las una del y en que por con para se su lo al es como más".split()
)
_WORDS = re.compile(r"[^\W\d_]+")


def signatures(text: str, anchors: frozenset[str] = frozenset(ANCHORS), chain: int = CHAIN) -> np.ndarray:
    """Sorted different 32-bit signatures. A text without a chain has one, of all its words, or, if it has none, of itself; an empty
    text has none. Equal texts have equal signatures."""
    words = _WORDS.findall(text.lower())
    found = set()
    ahead: list[str] = []  # content words behind this place, nearest last
    for w in reversed(words):
        if w not in anchors:
            ahead.append(w)
        elif len(ahead) >= chain:
            found.add(f"{w} {' '.join(ahead[: -chain - 1 : -1])}")
    if not found and text:
        found.add(" ".join(words) or text)
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) for s in found), np.uint32, len(found)))


def to_string(sigs: np.ndarray) -> str:
    """Base 64 of the sorted signatures, little-endian unsigned 32-bit integers."""
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two fingerprints, 1 for two empty ones; 0 at once if their lengths don't allow ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    like = both / (len(a) + len(b) - both)
    return like if like >= least else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_string(signatures(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).transform(map_arrow, run, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by a likeness of ``like`` or more; the smallest doc_id names the class.

    Equal fingerprints are one node. A node stands in the partition of its set length, and of the next one, whose lengths lie
    within the ratio ``like``; there it is met through its rarest signatures (of two sets as alike, the rarest
    n - ceil(like * n) + 1 of each share one). Pairs that meet are compared once, lengths first. Empty fingerprints link only to
    each other; a null doc_id takes the class of its fingerprint.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "spotsigs")
    prints = ws.save(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = ws.save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [from_string(f) for f in b.column(1).to_pylist()]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n).astype(np.int64)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint32)]).astype(np.int64))], ["node", "n", "sig"])

    sigs = ws.save(nodes.select("node", "fingerprint").transform(map_arrow, spread, "node long, n long, sig long"), "signatures")
    counted = ws.save(sigs.groupBy("sig").count(), "signature-counts")
    order = Window.partitionBy("node").orderBy("count", "sig")
    rare = sigs.join(counted, "sig").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("n") - F.ceil(F.lit(like) * F.col("n")) + 1)
    length_class = F.floor(F.log("n") / -float(np.log(like)))
    keyed = ws.save(rare.where("count > 1").select("node", "n", "sig", F.explode(F.array(length_class, length_class + 1)).alias("part")), "rare-signatures")
    other = keyed.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    pairs = keyed.join(other, ["sig", "part"]).where((F.col("b") < F.col("node")) & (F.least("n", "n_b") >= like * F.greatest("n", "n_b"))).select(F.col("node").alias("a"), "b").distinct()
    left, right = (nodes.select(F.col("node").alias(k), F.col("fingerprint").alias(f"f_{k}")) for k in "ab")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f, g = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([jaccard(from_string(x), from_string(y), like) >= like for x, y in zip(f, g, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    edges = pairs.join(left, "a").join(right, "b").select("a", "b", "f_a", "f_b").transform(map_arrow, verify, "a long, b long")
    found = connected_components(spark, edges, ws)
    groups = ws.save(nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id")), "groups")
    ws.remove("nodes", "signatures", "signature-counts", "rare-signatures")
    return prints.join(groups, "fingerprint", "left").select("doc_id", "component_id")


def _place(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the bounds, which fall, are over ``key``: first by blocks, then in one block, so that a row meets two roots of them."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    row = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    over = lambda xs: F.size(F.filter(xs, lambda b: b > key))
    block = over(row([b[0] for b in blocks])) - 1
    return F.when(block < 0, 0).otherwise(block * size + over(F.get(F.array(*map(row, blocks)), block)))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): a row per row of ``docs``.

    ``edited`` is the text with its last third (rounded down, code points) replaced by as many of the next document's first, or all
    it has; the next one is that with the next smaller doc_id, after the smallest the first. A null text counts as empty, a null
    doc_id as the smallest; rows that repeat a doc_id follow one another in order of text.

    Documents are dealt into ranges of ids, by quantiles over all ids. The first of a range goes to the range before as well,
    so that each range is read once, in order, with no more than one row kept. No text goes to the driver.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    place = _place(F.col("k"), bounds)
    heads = dict(docs.select(key.alias("k")).select("k", place.alias("place")).groupBy("place").agg(F.max("k")).collect())  # one for each range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    head = F.array(*[F.lit(heads.get(p)).cast("long") for p in range(len(bounds) + 1)])
    to = F.array(*[F.lit(before.get(p)).cast("int") for p in range(len(bounds) + 1)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), text_or_empty(text_col).alias("text")).select("doc_id", "k", "text", place.alias("own"))
    dealt = F.when(F.get(head, F.col("own")) == F.col("k"), F.array(F.struct(F.col("own").alias("place"), F.lit(False).alias("guest")), F.struct(F.get(to, F.col("own")).alias("place"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("place"), F.lit(False).alias("guest"))))
    rows = rows.select("doc_id", "k", "text", F.explode(dealt).alias("d")).select("doc_id", "k", "text", "d.place", "d.guest")
    rows = rows.repartition("place").sortWithinPartitions("place", "guest", F.desc("k"), "text").select("doc_id", "text", "place", "guest")

    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(now: tuple, text: str, sigs: np.ndarray) -> tuple:
        doc_id, own, mine = now
        third = len(own) // 3
        edited = own[: len(own) - third] + text[:third]
        changed = signatures(edited)
        return doc_id, len(own), edited, to_string(mine), to_string(changed), jaccard(mine, changed), jaccard(mine, sigs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, at = None, None
        for b in slices(batches, 2 << 20):
            out = []
            for doc_id, text, place, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting is None and guest:
                    continue  # more rows of the next range's first id
                sigs = signatures(text)
                if waiting is not None and place == at:
                    out.append(finish(waiting, text, sigs))
                waiting, at = (None, None) if guest else ((doc_id, text, sigs), place)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    return rows.transform(map_arrow, run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
