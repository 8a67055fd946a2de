"""Token counts from a digest cache: only texts that no cached pair of content and tokenizer digest covers are encoded."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, once, slices, text_or_empty

LIMIT = 4096
#: Words of a generation of counts that a worker keeps, at most; it keeps two, and no longer words than this.
_KEPT, _LONGEST = 1 << 16, 64
_CHUNK = re.compile("[ ▁]+[^ ▁]*")
CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"


class _Words(dict):
    """Counts of words met, in two generations: when the young one is full it becomes the old one, and words met again move over."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.old: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            # The library puts one space before a text, so the chunk loses one. A lone space after the last word is a piece by itself.
            n = len(self.model.encode(chunk[1:])) if len(chunk) > 1 else 1
        if len(chunk) <= _LONGEST:
            if len(self) >= _KEPT:
                self.old = dict(self)
                self.clear()
            self[chunk] = n
        return n


class PieceCounter:
    """Counts as the library does. If no piece holds a space after another character and the model leaves texts as they are, no merge
    crosses the start of a word, and the count of a text is the sum over its words; else each text is encoded whole."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = "ﬁ  　A ́\n\t\x00​ x "
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize(probe) == "▁" + probe.replace(" ", "▁") and len(self.model.encode("  ")) > 0
        self.words = _Words(self.model)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return list(map(len, self.model.encode(texts, num_threads=1)))
        get = self.words.__getitem__
        return [sum(map(get, _CHUNK.findall(" " + t))) if t else 0 for t in texts]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def count_tokens(docs: DataFrame, model_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row per row of ``docs``.

    ``cache``: a folder of (content digest, tokenizer digest, count) that all executors share; it is made if absent. Digests with
    no row there for this tokenizer are made distinct, without their texts; one document of each brings its text, which is encoded
    once and whose count is appended; then all rows are joined to the counts. A cache that holds a digest more than once, from two
    jobs at a time, gives each row once all the same. The normalisation is: null is empty. (Any other would change what the library
    gives.) Empty text: 0 bytes, 0 tokens. Texts are never cut. A null doc_id and repeated rows stay as they are; other columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    proto = Path(model_path).read_bytes()
    tokenizer = hashlib.sha256(proto).digest()
    shared = spark.sparkContext.broadcast(proto)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("content"))

    misses = rows.groupBy("content").agg(F.min("doc_id").alias("at"))
    if _exists(spark, cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(tokenizer))
        misses = misses.join(known.select("content"), "content", "left_anti")
    misses = misses.withColumnRenamed("content", "miss").hint("shuffle_hash")  # texts stream past the misses and are not sorted
    fresh = rows.join(misses, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("content") == F.col("miss")), "left_semi").select("content", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("pieces", tokenizer), lambda: PieceCounter(shared.value))
        seen: set[bytes] = set()  # of rows that repeat an id and its text one is enough; they come to one task
        for b in slices(batches):
            new = [i for i, c in enumerate(b.column(0).to_pylist()) if c not in seen and not seen.add(c)]
            b = b if len(new) == b.num_rows else b.take(pa.array(new, pa.int64()))
            n = counter.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokenizer] * len(n), pa.binary()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    fresh.transform(map_arrow, run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(tokenizer)).select("content", "n_tokens")
    if counts.groupBy("content").count().where("count > 1").limit(1).count():
        counts = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return out.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
