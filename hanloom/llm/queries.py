"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, langid, licenses, lm_score, secrets, simhash, spotsigs, token_counts
from .common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, Workspace(spark, "secrets").path("ledger"))
    ledger.scan(docs)
    f = F.col("findings")
    counts = [secrets.count_of(f, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return ledger.locate(docs, columns=["doc_id"]).select("row.doc_id", *counts, F.sha2(secrets.spans(f, secrets.BASE), 256).alias("base_sha256"), secrets.spans(f).alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "token-counts")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ws.path("cache"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.compare_edited(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_score.score(docs, lm_score.good_ids(_table(spark, sf_dir, "labels")), Workspace(spark, "lm-score"))
    return found.select("row.doc_id", "n_tokens", "target_loss", "background_loss", "difference")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Workspace(spark, "decontam"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"])), ",")
    return found.select("row.doc_id", F.array_join("sentences.id", ",").alias("sentences"), F.array_join(F.array_sort(F.array_distinct("licences.licence")), ",").alias("licences"), spans.alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs)).select("row.doc_id", "lang_pred", "score", "rejected")
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe.compile_lexicon(docs, model, Workspace(spark, "bpe"))
    found = bpe.encode(docs.select("doc_id", "text"), model, lexicon)
    return found.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_simhash, op4_spotsigs, op5_lm_score, op6_html_extraction, op7_decontamination, op8_license_scan, op9_language_id, op10_bpe)}


def _rule_sql(rule: secrets.Rule, k: int) -> str:
    """Rows (doc_id, k, kind, s, e) of one rule."""
    p = rule.pattern.replace("'", "''")
    ends = "list_sum(list_transform(gaps[1:i], lambda x: length(x)::bigint)) + list_sum(list_transform(whole[1:i], lambda x: length(x)::bigint))"
    return f"""select doc_id, {k} as k, '{rule.kind}' as kind, (e - length(whole[i]))::bigint as s, e from (
      select doc_id, whole, i, val, ({ends})::bigint as e from (
        select doc_id, whole, gaps, val, unnest(range(1, len(whole) + 1)) as i from (
          select doc_id, regexp_extract_all(t, '{p}') as whole, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', {rule.group}) as val
          from docs where regexp_matches(t, '{p}')))) where length(val[i]) >= {rule.least}"""


_SECRETS = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
hits as ({" union all ".join(_rule_sql(r, k) for k, r in enumerate(secrets.RULES))}),
found as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {secrets.BASE}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from hits group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join found f on d.doc_id = f.doc_id"""

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_DECONTAMINATION = f"""
with item as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(len(w), {decontam.WINDOW}) as n, array_to_string(w[i:i + least(len(w), {decontam.WINDOW}) - 1], ' ') as key
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), {decontam.WINDOW}) + 2)) as i from item where len(w) > 0)),
doc as (select doc_id, {_WORDS} as w from documents),
lens as (select distinct n from iw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as key from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, lens where len(w) >= n)),
hit as (select doc_id, dw.n, i, item_id from dw join iw on dw.key = iw.key and dw.n = iw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit where item_id is not null) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc d left join words w on d.doc_id = w.doc_id left join items t on d.doc_id = t.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _SECRETS, "op7_decontamination": _DECONTAMINATION}
