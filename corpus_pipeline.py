"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, BPE; each stage calls one operator.

All stages take nulls in any column, repeated rows and empty tables: each row is decided by itself or by its text, and an empty table stays
empty. Columns keep their names and types, whatever they are, in all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanloom.llm import bpe, decontam, langid, secrets, simhash
from hanloom.llm.common import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go, and with them those whose text is null or has no letter. Equal rows go or stay together; if
    no document has a language, only those without a letter go."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five-word likeness 0.8 or more, the document with the smallest doc_id stays, in all rows that repeat it.
    Texts without a word are duplicates of each other. Documents without a doc_id stay."""
    return simhash.one_of_each(docs, words=5, like=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; an item of fewer than ten words is one window. Null and empty texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "pipeline-decontam"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, overlapping ones together; n_chars follows. Null texts stay null, other texts as they are."""
    ledger = secrets.BlobLedger(spark, Workspace(spark, "pipeline-secrets").path("ledger"))
    ledger.scan(docs)
    text, findings = F.col("row.text"), F.col("findings")
    masked = secrets.redact(text, findings)
    changed = {"text": masked, "n_chars": F.when(F.size(findings) > 0, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return ledger.locate(docs).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, little-endian unsigned 32-bit integers, and the digest of what they decode to; none for a null or empty text."""
    model = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe.compile_lexicon(docs, model, Workspace(spark, "pipeline-bpe"))
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), model, lexicon)
    return out.select("doc_id", "lang", "source", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("encoding", encoding)]

#: Language models can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again. Of that folder, only what the last one
    returned stays."""
    ws, before = Workspace(spark, "pipeline"), ""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Workspace.temporary():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.remove(before)
        before = name
    return docs
