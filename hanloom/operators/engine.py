"""The engine: a lexicon bound to a session, and its operators over columns and DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import text as tx
from ..plans.configs import CONFIGS, Config, config
from ..sources.lexicon import CustomTable, Lexicon, UserWord, builtin
from .matcher import Round, convert, phrase_pattern
from .segment import HmmModel, Segmenter

_HAN = re.compile("[〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_TAGGED = "array<struct<word:string,tag:string>>"
#: Up to so many phrases are looked for by the engine, so that only texts that hold one go to a worker.
NATIVE_PHRASES = 2_000
#: Bytes of a batch between the JVM and a worker, unless the session sets it: texts are long.
BATCH = "4m"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A table of a lookup is broadcast up to this many entries.
BROADCAST_ROWS = 100_000


def lists(rows: list[list[str] | None], *columns: list[str]) -> pa.ListArray:
    """An array of lists: of strings, or of structs of word and tag if ``columns`` has the flat tags."""
    flat = pa.array([x for r in rows if r is not None for x in r], pa.string())
    values = pa.StructArray.from_arrays([flat, pa.array(columns[0], pa.string())], ["word", "tag"]) if columns else flat
    at = list(accumulate((len(r) if r is not None else 0 for r in rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


class Engine:
    """Immutable: what changes the lexicon gives a new engine. Lexicons travel to executors by broadcast; a worker builds its matcher
    once for each."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon | None = None, hmm: HmmModel | None = None):
        self.spark, self.lexicon, self.hmm = spark, lexicon if lexicon is not None else builtin(), hmm
        self._shared = None
        if spark.conf.get(_ARROW, None) is None:
            spark.conf.set(_ARROW, BATCH)

    def with_tables(self, specs: Iterable[CustomTable]) -> Engine:
        return Engine(self.spark, self.lexicon.with_tables(specs), self.hmm)

    def with_words(self, words: Iterable[UserWord]) -> Engine:
        return Engine(self.spark, self.lexicon.with_words(words), self.hmm)

    def with_lexicon(self, lexicon: Lexicon) -> Engine:
        return Engine(self.spark, lexicon, self.hmm)

    def _segmenter(self):
        """A function that gives the worker's segmenter; built once for each function's life in a worker."""
        if self._shared is None:
            model = (self.hmm.start, self.hmm.move, self.hmm.emit, self.hmm.unseen) if self.hmm else None
            self._shared = self.spark.sparkContext.broadcast((self.lexicon.vocabulary(), model))
        shared, made = self._shared, []

        def get() -> Segmenter:
            if not made:
                vocabulary, model = shared.value
                made.append(Segmenter(vocabulary, HmmModel(*model) if model else None))
            return made[0]

        return get

    def rounds(self, value: str | int | Config) -> list[list[dict[str, str]]]:
        """The tables of a configuration's rounds; packs of older schemas lend their legacy tables to the Japanese ones."""
        c = config(value)
        out = [[dict(self.lexicon.table(s)) for s in r] for r in c.rounds]
        if self.lexicon.version < 3:
            if c.name == "jp2t" and self.lexicon.legacy.get("jp_variants_rev"):
                out[0].append(dict(self.lexicon.legacy["jp_variants_rev"]))
            if c.name == "t2jp" and not out[0][0] and self.lexicon.legacy.get("jp_variants"):
                out[0].append(dict(self.lexicon.legacy["jp_variants"]))
        return out

    def convert(self, text: Column | str, value: str | int | Config, punct: bool = False) -> Column:
        """The text in another script; null stays null. Without a key of several characters in it, a text doesn't depend on segmentation:
        it is mapped by the engine. The others run, all rounds together, in one Arrow function. Raises for an unknown configuration."""
        c = config(value)
        text = F.col(text) if isinstance(text, str) else text
        out = self._converted(text, F.lit(c.name), [c])
        return tx.punctuation(out, c.punct) if punct else out

    def _converted(self, text: Column, name: Column, configs: list[Config]) -> Column:
        """``text`` by the configuration that ``name`` names, in lower case, which must be one of ``configs``."""
        own, worker = [], F.lit(False)
        for c in configs:
            parts = [Round(r).native(NATIVE_PHRASES) for r in self.rounds(c)]
            is_c = name == c.name
            if None in parts:
                worker = worker | is_c
                continue
            now, phrase = text, F.lit(False)
            for single, phrases in parts:
                phrase = phrase | now.rlike(phrase_pattern(phrases)) if phrases else phrase
                now = tx.map_characters(now, single)
            own.append((is_c, now))
            worker = worker | (is_c & phrase) if any(p for _, p in parts) else worker
        needed = [c for c in configs if any(len(k) > 1 or len(v) > 1 for r in self.rounds(c) for t in r for k, v in t.items())]
        out = F.lit(None).cast("string")
        for is_c, now in own:
            out = F.when(is_c, now).otherwise(out)
        # Only those texts go to the worker; of the others a null does.
        return F.when(worker, self.convert_udf(needed)(F.when(worker, text), name)).otherwise(out) if needed else out

    def convert_udf(self, configs: Iterable[Config] = CONFIGS, otherwise: str | None = None):
        """An Arrow function of text and the name of a configuration, in any case. Of an unknown name the result is ``otherwise`` and the name, or
        null."""
        tables = self.spark.sparkContext.broadcast({c.name: self.rounds(c) for c in configs})
        segmenter, made = self._segmenter(), {}

        @F.arrow_udf("string")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            cut = segmenter().cut_chunk

            def one(text: str | None, name: str | None) -> str | None:
                if text is None or name is None:
                    return None
                found = tables.value.get(name.lower())
                if found is None:
                    return None if otherwise is None else otherwise + name
                if name.lower() not in made:  # where every key has an ideograph, a text without one has no key
                    made[name.lower()] = [Round(r) for r in found], all(_HAN.search(k) for r in found for t in r for k in t)
                rounds, han = made[name.lower()]
                return text if han and not _HAN.search(text) else convert(text, rounds, cut)

            for texts, names in batches:
                yield pa.array(map(one, texts.to_pylist(), names.to_pylist()), pa.string())

        return run

    def convert_any(self, text: Column, name: Column, punct: bool = False) -> Column:
        """By a column of configuration names, in any case; for an unknown one the result says so. One worker function for all."""
        low = F.lower(name)
        out = self._converted(text, low, list(CONFIGS))
        if punct:
            for style in ("s", "t"):
                out = F.when(low.isin([c.name for c in CONFIGS if c.punct == style]), tx.punctuation(out, style)).otherwise(out)
        return F.when(low.isin([c.name for c in CONFIGS]), out).otherwise(F.concat(F.lit("Invalid config: "), name))

    def convert_auto(self, text: Column) -> Column:
        """Traditional becomes simplified, simplified traditional; other text stays."""
        script = self.detect_script(text)
        name = F.when(script == 1, "t2s").when(script == 2, "s2t")
        return F.when(name.isNotNull(), self._converted(text, name, [config("t2s"), config("s2t")])).otherwise(text)

    def detect_script(self, text: Column) -> Column:
        return tx.detect_script(text, self.lexicon.table("TSCharacters"), self.lexicon.table("STCharacters"))

    def simplify_characters(self, text: Column) -> Column:
        return self._characters(text, "TSCharacters")

    def traditionalise_characters(self, text: Column) -> Column:
        return self._characters(text, "STCharacters")

    def _characters(self, text: Column, slot: str) -> Column:
        table = {k: v for k, v in self.lexicon.table(slot).items() if len(k) == 1}
        if all(len(v) == 1 for v in table.values()):
            return tx.map_characters(text, table)

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array((None if t is None else "".join([table.get(c, c) for c in t]) for t in texts.to_pylist()), pa.string())

        return run(text)

    def cut(self, text: Column, hmm: bool = False, mode: str = "cut") -> Column:
        """Tokens in order, delimiters with them. ``mode``: cut, search or full."""
        return self.cut_udf(hmm, mode)(text)

    def cut_udf(self, hmm: bool = False, mode: str = "cut"):
        if mode not in ("cut", "search", "full", "all"):
            raise ConfigError(f"unknown mode: {mode}")
        segmenter = self._segmenter()

        @F.arrow_udf("array<string>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            s = segmenter()
            f = s.full if mode in ("full", "all") else (lambda t: s.search(t, hmm)) if mode == "search" else (lambda t: s.cut(t, hmm))
            for b in batches:
                yield lists([None if t is None else f(t) for t in b.to_pylist()])

        return run

    def tag(self, text: Column, hmm: bool = False) -> Column:
        return self.tag_udf(hmm)(text)

    def tag_udf(self, hmm: bool = False):
        segmenter = self._segmenter()

        @F.arrow_udf(_TAGGED)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            s = segmenter()
            for b in batches:
                rows = [None if t is None else s.cut(t, hmm) for t in b.to_pylist()]
                yield lists(rows, s.tags_of([w for r in rows if r is not None for w in r]))

        return run

    def cut_and_join(self, text: Column, delimiter: str = " ", hmm: bool = False, mode: str = "cut") -> Column:
        return F.array_join(self.cut(text, hmm, mode), delimiter)

    def lookup(self, tokens: DataFrame, slots: list[str], token_col: str = "token") -> DataFrame:
        """``tokens`` with ``value``: from the first of the slots that has the token, null if none has. The lexicon is broadcast up to
        BROADCAST_ROWS entries."""
        rows = list(Round([self.lexicon.table(s) for s in slots]).map.items())
        table = self.spark.createDataFrame(rows, "_key string, value string")
        table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
        return tokens.join(table, F.col(token_col) == F.col("_key"), "left").drop("_key")
