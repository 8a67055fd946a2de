"""Secret scans over all versions of all paths, with a ledger of the blobs and rule versions that were scanned. DataFrame operations only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap and whose group ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The key as far as its END line; without one as far as lines of base 64 go, a short last line included; a header alone otherwise.
_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[\x20\t\r\n]*Proc-Type:[\x20-\x7E]*[\x20\t\r\n]*DEK-Info:[A-Za-z0-9,\x20-]*)?[A-Za-z0-9+/=\x20\t\r\n\\:,\"'>#*|]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:[\x20\t\r\n]*Proc-Type:[\x20-\x7E]*[\x20\t\r\n]*DEK-Info:[A-Za-z0-9,\x20-]*)?[\x20\t\r\n\\nr]{0,8}[A-Za-z0-9+/=]{16,}(?:[A-Za-z0-9+/=\x20\t\r\n\\]*[A-Za-z0-9+/=]{16,})?(?:\r?\n[A-Za-z0-9+/=]{1,15}(?:\n|$))?)?"
)
#: The first three are the base rules. A run of hex digits that is too short can hold no longer match, so the bound stands in the pattern.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", _KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3

_FINDING = "struct<start:int,rule:int,end:int,kind:string,version:string>"
LEDGER = f"blob binary, versions array<string>, findings array<{_FINDING}>"


def blob_of(text: Column) -> Column:
    """The content address."""
    return F.unhex(F.sha2(text, 256))


def _matches(text: Column, k: int, rule: Rule) -> Column:
    """Per match, the code points between it and the one before, and its own. The text falls into as many pieces as matches and one."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("n"), value.alias("v")), lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["v"].alias("v")))
    return F.filter(rows, lambda x: x["n"].isNotNull())


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of the ledger for ``blobs`` (blob, text, seen: rule versions that are scanned already, distinct by blob).

    Positions are sums over the pieces and matches before; they are windows over the matches of one blob and rule.
    """
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,n:int,v:int>>")
    todo = [~F.array_contains("seen", r.version) for r in rules]
    found = F.concat(*[F.when(t & F.col("text").rlike(r.pattern), _matches(F.col("text"), k, r)).otherwise(none) for k, (r, t) in enumerate(zip(rules, todo, strict=True))])
    versions = F.filter(F.array(*[F.when(t, F.lit(r.version)) for r, t in zip(rules, todo, strict=True)]), lambda x: x.isNotNull())
    rows = blobs.select("blob", versions.alias("versions"), F.explode_outer(found).alias("m")).select("blob", "versions", "m.*")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end)
    table = [F.array(*[F.lit(x) for x in column]) for column in ([r.least for r in rules], [r.kind for r in rules], [r.version for r in rules])]
    least, kind, version = (F.get(t, F.col("rule")) for t in table)
    finding = F.when(F.col("v") >= least, F.struct((F.col("end") - F.col("n")).cast("int").alias("start"), F.col("rule"), F.col("end"), kind.alias("kind"), version.alias("version")).cast(_FINDING))
    return rows.groupBy("blob").agg(F.first("versions").alias("versions"), F.array_sort(F.collect_list(finding)).alias("findings"))


class BlobLedger:
    """A folder with a row for every blob scanned: its address, the rule versions, what they found. A scan appends; a row holds the
    findings together with the note that the scan was made, so a job that breaks off leaves neither without the other."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path, tuple(rules)

    def _exists(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], T._parse_datatype_string(LEDGER))
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scans the blobs of ``versions`` for the rules of which the ledger has no scan of them."""
        text = text_or_empty(text_col)
        blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        if self._exists():
            current = F.array(*[F.lit(r.version) for r in self.rules])
            seen = self.rows().groupBy("blob").agg(F.array_intersect(F.flatten(F.collect_list("versions")), current).alias("seen"))
            blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size("seen") < len(self.rules))
        else:
            blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
        scan_blobs(blobs, self.rules).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """(blob, findings): for each blob those of the current rules, by start and then rule; one row a blob."""
        current = {r.version: k for k, r in enumerate(self.rules)}
        order = F.create_map(*[F.lit(x) for pair in current.items() for x in pair])
        keep = F.filter("findings", lambda x: x["version"].isin(list(current)))
        placed = F.transform(keep, lambda x: F.struct(x["start"].alias("start"), order[x["version"]].alias("rule"), x["end"].alias("end"), x["kind"].alias("kind"), x["version"].alias("version")))
        return self.rows().select("blob", placed.alias("findings"))

    def locate(self, versions: DataFrame, text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
        """(row, findings) for every row of ``versions``: ``row`` holds ``columns``, or all, whatever their names; findings is an array, empty where
        nothing is found. Columns that aren't needed, texts above all, are better left out: rows are joined by content.

        A null text counts as empty. Every row comes out once, repeated rows too. All blobs must be scanned before. Blobs that
        were scanned more than once, under different rule versions, are put together first.
        """
        found = self.findings().where(F.size("findings") > 0)
        if found.groupBy("blob").count().where("count > 1").limit(1).count():
            found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
        rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in columns or versions.columns]).alias("row"), blob_of(text_or_empty(text_col)).alias("at"))
        # Merged whatever the sizes, so that the plan is the same at any scale.
        out = rows.join(found.hint("merge"), rows["at"] == found["blob"], "left")
        return out.select("row", F.coalesce("findings", F.array().cast(f"array<{_FINDING}>")).alias("findings"))


def spans(findings: Column, rules: int | None = None) -> Column:
    """``kind:start:end`` of the findings, or of those of the first ``rules`` rules, comma-joined."""
    kept = findings if rules is None else F.filter(findings, lambda x: x["rule"] < rules)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """``text`` with a mask in place of each run of overlapping findings."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.when(x["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], fresh).alias("out"))

    done = F.aggregate(findings, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(findings) == 0, text).otherwise(done)
