"""Lexicons: conversion tables and user words, read, checked, overlaid and written."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EntryError, LexiconReadError, LexiconVersionError, UserWordError
from ..plans.configs import SLOTS, slot
from . import fixed

#: The newest schema of packs; keys hold this many characters at most.
SCHEMA, LONGEST_KEY = 3, 65_535
LEXICON = "slot string, key string, value string, key_len int"
OVERLAY = "seq int, slot string, mode string, key string, value string"
# File names of slots that differ from the slot's, and the two slots of older packs.
FILES = {"JPSCharacters": "JPShinjitaiCharacters", "JPSCharactersRev": "JPShinjitaiCharactersRev", "JPSPhrases": "JPShinjitaiPhrases"}
LEGACY = ("jp_variants", "jp_variants_rev")


def pack_name(name: str) -> str:
    """The name of a slot in a pack: STCharacters is st_characters."""
    return re.sub(r"(?<=[A-Z]{2})(?=[A-Z][a-z])|(?<=[a-z])(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True)
class UserWord:
    word: str
    freq: int
    tag: str | None = None


@dataclass(frozen=True)
class CustomTable:
    """Entries for a slot; "append" adds them, "override" empties the slot first."""

    slot: str
    entries: tuple[tuple[str, str], ...]
    mode: str = "append"


@dataclass(frozen=True)
class Lexicon:
    """Tables by slot and user words. Never changed in place: what adds to it gives a new one, or raises and leaves it."""

    tables: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    words: tuple[UserWord, ...] = ()
    legacy: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    version: int = SCHEMA

    def table(self, name: str) -> Mapping[str, str]:
        return self.tables.get(slot(name), {})

    def with_tables(self, specs: Iterable[CustomTable]) -> Lexicon:
        """Overlays in order; the last entry of a key wins. All are checked before any counts."""
        checked = []
        for s in specs:
            mode = s.mode.lower()
            if mode not in ("append", "override"):
                raise EntryError(f"unknown mode: {s.mode}")
            for k, v in s.entries:
                if not k or not v:
                    raise EntryError(f"{s.slot}: empty key or value")
                if len(k) > LONGEST_KEY:
                    raise EntryError(f"{s.slot}: a key of {len(k)} characters")
            checked.append((slot(s.slot), mode, s.entries))
        tables = {k: dict(v) for k, v in self.tables.items()}
        for name, mode, entries in checked:
            if mode == "override":
                tables[name] = {}
            tables.setdefault(name, {}).update(entries)
        return replace(self, tables=tables)

    def with_words(self, words: Iterable[UserWord]) -> Lexicon:
        words = tuple(words)
        if any(not w.word for w in words):
            raise UserWordError("an empty word")
        return replace(self, words=tuple({w.word: w for w in (*self.words, *words)}.values()))

    def vocabulary(self) -> dict[str, tuple[int, str | None]]:
        """Words for segmentation, with count and tag: keys and values of two characters or more, and the user words."""
        out: dict[str, tuple[int, str | None]] = {}
        for table in self.tables.values():
            for pair in table.items():
                out.update((w, (2, None)) for w in pair if len(w) > 1)
        return out | {w.word: (w.freq, w.tag) for w in self.words}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, k, v, len(k)) for s, t in self.tables.items() for k, v in t.items()], LEXICON)


def builtin() -> Lexicon:
    """The short tables that come with the package."""
    return Lexicon({s: dict(fixed.pairs(s)) for s in SLOTS if fixed.pairs(s)})


def parse_table(text: str, source: str = "", strict: bool = False, bom: str = "data") -> tuple[dict[str, str], list[str]]:
    """Lines of key, tab and values, of which the first counts; blank lines and those that start with # are skipped.

    ``bom``: a byte order mark is taken off the first "data" line, or off the first "line" of the file, before comments are told.
    Lines that aren't valid are named in the second result and skipped; ``strict``: the first one raises.
    """
    table: dict[str, str] = {}
    bad: list[str] = []
    waiting = bom == "data"
    for number, line in enumerate(text.split("\n"), 1):
        s = line.rstrip()
        if bom == "line" and number == 1:
            s = s.removeprefix("﻿")
        if not s or s.startswith("#"):
            continue
        if waiting:
            s, waiting = s.removeprefix("﻿"), False
            if not s:
                continue
        key, tab, rest = s.partition("\t")
        value = next(iter(rest.split()), "")
        wrong = "no tab" if not tab else "empty key or value" if not key or not value else "key too long" if len(key) > LONGEST_KEY else ""
        if wrong:
            bad.append(f"{source}:{number}: {wrong}")
            if strict:
                raise EntryError(bad[-1])
        else:
            table[key] = value
    return table, bad


def read_custom(path: str, slot_name: str, mode: str = "append") -> CustomTable:
    """A custom file, strictly."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise LexiconReadError(f"{path}: {e}") from e
    return CustomTable(slot(slot_name), tuple(parse_table(text, path, strict=True, bom="line")[0].items()), mode)


def parse_spec(spec: str) -> CustomTable:
    """``SLOT:MODE:FILE``."""
    parts = spec.split(":", 2)
    if len(parts) != 3 or parts[1].lower() not in ("append", "override") or not os.path.isfile(parts[2]):
        raise EntryError(f"not SLOT:append|override:FILE, or no such file: {spec}")
    return read_custom(parts[2], parts[0], parts[1].lower())


def read_folder(path: str, base: Lexicon | None = None) -> Lexicon:
    """``<slot>.txt`` files of a folder over ``base`` (the built-in tables); slots without a file stay."""
    tables = dict((base or builtin()).tables)
    if not os.path.isdir(path):
        raise LexiconReadError(f"no such folder: {path}")
    for name in SLOTS:
        for file in (name, FILES.get(name)):
            if file and os.path.isfile(f"{path}/{file}.txt"):
                tables[name] = parse_table(Path(f"{path}/{file}.txt").read_text(encoding="utf-8"), file)[0]
                break
    return Lexicon(tables)


def scan_table(spark: SparkSession, path: str, slot_name: str) -> DataFrame:
    """A large table as a DataFrame (slot, key, value, key_len), leniently: bad lines are dropped, of a key the last value counts."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(place.alias("at"), F.rtrim("value").alias("s"))
    lines = lines.where((F.col("s") != "") & ~F.startswith("s", F.lit("#")))
    # A byte order mark goes off the first line of data of a file only.
    first = lines.groupBy(F.col("at.file").alias("of")).agg(F.min("at").alias("first"))
    rows = lines.join(first, F.col("at.file") == F.col("of")).select("at", F.when(F.col("at") == F.col("first"), F.regexp_replace("s", "^\\x{FEFF}", "")).otherwise(F.col("s")).alias("s"))
    rows = rows.where(F.contains("s", F.lit("\t")))
    part = F.split("s", "\t", 2)
    value = F.split(F.trim(F.regexp_replace(part[1], "\\s+", " ")), " ")[0]
    rows = rows.select(F.lit(slot(slot_name)).alias("slot"), part[0].alias("key"), value.alias("value"), "at").where("key <> '' and value <> ''")
    return rows.groupBy("slot", "key").agg(F.max_by("value", "at").alias("value")).withColumn("key_len", F.length("key"))


def parse_words(text: str, source: str = "") -> list[UserWord]:
    """Lines of word, count and perhaps a tag; blank lines are skipped. Anything else raises with its line number."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        parts = line.split()
        if not parts:
            continue
        if len(parts) not in (2, 3) or not re.fullmatch(r"\+?[0-9]+", parts[1]) or int(parts[1]) >= 1 << 64:
            raise UserWordError(f"{source}:{number}: not word, count and tag: {line}")
        out.append(UserWord(parts[0], int(parts[1]), parts[2] if len(parts) == 3 else None))
    return out


def read_words(path: str) -> list[UserWord]:
    try:
        return parse_words(Path(path).read_text(encoding="utf-8"), path)
    except OSError as e:
        raise LexiconReadError(f"{path}: {e}") from e


def validate_words(lines: DataFrame) -> DataFrame:
    """(line_no, line) to (line_no, word, freq, tag, ok); blank lines go. The same test as ``parse_words``, for word lists as tables; a count
    must fit a long."""
    part = F.split(F.trim(F.regexp_replace("line", "\\s+", " ")), " ")
    freq = F.get(part, F.lit(1))
    good = F.size(part).isin(2, 3) & F.coalesce(freq.rlike("^\\+?[0-9]+$"), F.lit(False))
    number = F.regexp_replace(freq, "^\\+", "").try_cast("bigint")
    ok = good & number.isNotNull()
    rows = lines.where(F.trim(F.regexp_replace("line", "\\s+", " ")) != "")
    return rows.select("line_no", F.when(ok, part[0]).alias("word"), F.when(ok, number).alias("freq"), F.when(ok, F.get(part, F.lit(2))).alias("tag"), ok.alias("ok"))


def key_stats(lexicon: DataFrame) -> DataFrame:
    """(slot, entries, min_len, max_len, len_mask, long_lengths): bit n - 1 of the mask is set if a key has n <= 64 characters."""
    short = F.when(F.col("key_len") <= 64, F.expr("shiftleft(1L, key_len - 1)"))
    return lexicon.groupBy("slot").agg(
        F.count("*").alias("entries"), F.min("key_len").alias("min_len"), F.max("key_len").alias("max_len"), F.coalesce(F.bit_or(short), F.lit(0)).alias("len_mask"),
        F.array_sort(F.collect_set(F.when(F.col("key_len") > 64, F.col("key_len")))).alias("long_lengths"),
    )


def overlay(lexicon: DataFrame, changes: DataFrame) -> DataFrame:
    """``lexicon`` (slot, key, value) under ``changes`` (seq, slot, mode, key, value). An override empties its slot as it stands then; of a key the
    last change counts."""
    cleared = changes.where("mode = 'override'").groupBy("slot").agg(F.max("seq").alias("from_seq"))
    rows = lexicon.select(F.lit(-1).alias("seq"), "slot", "key", "value").unionByName(changes.select("seq", "slot", "key", "value"))
    rows = rows.join(cleared, "slot", "left").where(F.col("from_seq").isNull() | (F.col("seq") >= F.col("from_seq")))
    last = F.row_number().over(Window.partitionBy("slot", "key").orderBy(F.desc("seq"), F.desc("value")))
    return rows.withColumn("_n", last).where("_n = 1 and key is not null").select("slot", "key", "value", F.length("key").alias("key_len"))


def to_pack(lexicon: Lexicon, pretty: bool = False) -> bytes:
    """A pack as JSON, keys in order."""
    out: dict = {"schema_version": lexicon.version}
    for name in SLOTS:
        table = lexicon.table(name)
        sizes = {len(k) for k in table}
        mask = sum(1 << (n - 1) for n in sizes if n <= 64)
        out[pack_name(name)] = {"map": dict(sorted(table.items())), "min_len": min(sizes, default=0), "max_len": max(sizes, default=0), "key_len_mask": mask, "long_lengths": sorted(n for n in sizes if n > 64)}
    return json.dumps(out, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")).encode()


def write_pack(lexicon: Lexicon, path: str, pretty: bool = False, compressed: bool = True) -> None:
    data = to_pack(lexicon, pretty)
    if compressed:
        import zstandard

        data = zstandard.ZstdCompressor(level=19).compress(data)
    Path(path).write_bytes(data)


def from_pack(data: bytes) -> Lexicon:
    """A pack, compressed or not. Key lengths are worked out anew. Slots that older packs lack are empty; unknown ones raise."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        except zstandard.ZstdError as e:
            raise LexiconReadError(f"can't unpack: {e}") from e
    try:
        raw = json.loads(data)
        version = int(raw.pop("schema_version"))
        if version > SCHEMA:
            raise LexiconVersionError(version, SCHEMA)
        tables = {k: {str(a): str(b) for a, b in v["map"].items()} for k, v in raw.items()}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        if isinstance(e, LexiconVersionError):
            raise
        raise LexiconReadError(f"not a pack: {e}") from e
    names = {pack_name(s): s for s in SLOTS}
    if unknown := tables.keys() - names.keys() - set(LEGACY):
        raise LexiconReadError(f"unknown slots: {sorted(unknown)}")
    return Lexicon({names[k]: v for k, v in tables.items() if k in names}, legacy={k: v for k, v in tables.items() if k in LEGACY}, version=version)


def read_pack(path: str) -> Lexicon:
    try:
        return from_pack(Path(path).read_bytes())
    except OSError as e:
        raise LexiconReadError(f"{path}: {e}") from e


def derive_han_tables(spark: SparkSession, base: Lexicon) -> Lexicon:
    """``base`` with STCharacters and TSCharacters where it lacks them, by rule: every ideograph of the two main blocks through the
    character transliterators of the ICU library that Spark brings. One value a character; no phrases. The driver does this once."""
    cls = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator
    han = [chr(c) for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000)) for c in range(a, b)]
    tables = dict(base.tables)
    for name, rule in (("STCharacters", "Simplified-Traditional"), ("TSCharacters", "Traditional-Simplified")):
        if not tables.get(name):
            mapped = cls.getInstance(rule).transliterate("\n".join(han)).split("\n")
            tables[name] = {k: v for k, v in zip(han, mapped, strict=True) if k != v and len(v) == 1}
    return replace(base, tables=tables)


def resolve(specs: Sequence[str], words: Sequence[str], base: Lexicon) -> Lexicon:
    """User word files first, then custom tables."""
    for path in words:
        base = base.with_words(read_words(path))
    return base.with_tables(parse_spec(s) for s in specs)


