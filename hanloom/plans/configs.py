"""Conversion configurations and lexicon slots as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, SlotError

# The tables of a lexicon.
SLOTS = (
    "STCharacters", "STPhrases", "TSCharacters", "TSPhrases", "TWPhrases", "TWPhrasesRev", "HKPhrases", "HKPhrasesRev", "TWVariants", "TWVariantsPhrases",
    "TWVariantsRev", "TWVariantsRevPhrases", "HKVariants", "HKVariantsPhrases", "HKVariantsRev", "HKVariantsRevPhrases", "JPSCharacters", "JPSCharactersRev", "JPSPhrases",
)
# Other names of slots.
SLOT_ALIASES = {"JPShinjitaiCharacters": "JPSCharacters", "JPShinjitaiCharactersRev": "JPSCharactersRev", "JPShinjitaiPhrases": "JPSPhrases"}

_NAMES = {s: s for s in SLOTS} | SLOT_ALIASES
_FOLDED = {n.lower(): s for n, s in _NAMES.items()}


def slot(name: str, exact: bool = False) -> str:
    """The canonical name; spaces around it and ASCII case don't matter unless ``exact``."""
    found = _NAMES.get(name) if exact else _FOLDED.get(name.strip(" \t\r\n").lower())
    if found is None:
        raise SlotError(f"unknown slot: {name}")
    return found


def slot_column(name: Column) -> Column:
    """As ``slot``, for a column; null where there is no such slot."""
    return F.create_map(*[F.lit(x) for pair in _FOLDED.items() for x in pair])[F.lower(F.trim(name))]


@dataclass(frozen=True)
class Config:
    """Rounds run one after another; in a round the first table that has a key wins. ``punct``: the quotation marks it writes."""

    id: int
    name: str
    rounds: tuple[tuple[str, ...], ...]
    punct: str


_ST, _TS = ("STPhrases", "STCharacters"), ("TSPhrases", "TSCharacters")
_TW, _HK = ("TWVariantsPhrases", "TWVariants"), ("HKVariantsPhrases", "HKVariants")
_TW_BACK, _HK_BACK = ("TWVariantsRev", "TWVariantsRevPhrases"), ("HKVariantsRevPhrases", "HKVariantsRev")

# Number, name, rounds and style of every configuration, in listing order.
CONFIGS = (
    Config(1, "s2t", (_ST,), "s"),
    Config(2, "s2tw", (_ST, _TW), "s"),
    Config(3, "s2twp", (_ST, ("TWPhrases", *_TW)), "s"),
    Config(4, "s2hk", (_ST, _HK), "s"),
    Config(17, "s2hkp", (_ST, ("HKPhrases", *_HK)), "s"),
    Config(5, "t2s", (_TS,), "t"),
    Config(6, "t2tw", (_TW,), "s"),
    Config(7, "t2twp", (("TWPhrases", *_TW),), "s"),
    Config(8, "t2hk", (_HK,), "s"),
    Config(19, "t2hkp", (("HKPhrases", *_HK),), "s"),
    Config(9, "tw2s", (_TW_BACK, _TS), "t"),
    Config(10, "tw2sp", (_TW_BACK, ("TWPhrasesRev",), _TS), "t"),
    Config(11, "tw2t", (_TW_BACK,), "s"),
    Config(12, "tw2tp", ((*_TW_BACK, "TWPhrasesRev"),), "s"),
    Config(13, "hk2s", (_HK_BACK, _TS), "t"),
    Config(18, "hk2sp", (("HKPhrasesRev", *_HK_BACK), _TS), "t"),
    Config(14, "hk2t", (_HK_BACK,), "s"),
    Config(20, "hk2tp", ((*_HK_BACK, "HKPhrasesRev"),), "s"),
    Config(15, "jp2t", (("JPSPhrases", "JPSCharacters"),), "s"),
    Config(16, "t2jp", (("JPSCharactersRev",),), "s"),
)
BY_NAME = {c.name: c for c in CONFIGS}
BY_ID = {c.id: c for c in CONFIGS}


def config(value: str | int | Config) -> Config:
    """By name, in either ASCII case and without trimming, or by number."""
    if isinstance(value, Config):
        return value
    found = BY_ID.get(value) if isinstance(value, int) else BY_NAME.get(value.lower()) if isinstance(value, str) and value.isascii() else None
    if found is None:
        raise ConfigError(f"Invalid config: {value}")
    return found


def is_config(name: Column) -> Column:
    return F.lower(name).isin(list(BY_NAME))


def config_table(spark: SparkSession) -> DataFrame:
    """(id, name, rounds, punct)."""
    return spark.createDataFrame([(c.id, c.name, [list(r) for r in c.rounds], c.punct) for c in CONFIGS], "id int, name string, rounds array<array<string>>, punct string")


def slot_table(spark: SparkSession) -> DataFrame:
    """(name, slot): every name that is understood."""
    return spark.createDataFrame(sorted(_NAMES.items()), "name string, slot string")
