"""Text functions that stay in the engine: each takes and gives columns; null gives null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiters.
DELIMITER_CHARACTERS = " \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_{}|~＝、。“”‘’『』「」﹁﹂—－（）《》〈〉？！…／＼︒︑︔︓︿﹀︹︺︙︐［﹇］﹈︕︖︰︳︴︽︾︵︶｛︷｝︸﹃﹄【︻】︼　～．，；："


def _ranges(characters: str) -> tuple[tuple[int, int], ...]:
    """Runs of neighbouring code points."""
    out: list[tuple[int, int]] = []
    for c in sorted(set(map(ord, characters))):
        if out and c == out[-1][1] + 1:
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return tuple(out)


DELIMITERS = _ranges(DELIMITER_CHARACTERS)
_INSIDE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in DELIMITERS)
#: Character classes for Java's and RE2's patterns.
DELIMITER, OTHER = f"[{_INSIDE}]", f"[^{_INSIDE}]"
INCLUSIVE, EXCLUSIVE = f"{OTHER}*{DELIMITER}|{OTHER}+", f"{DELIMITER}|{OTHER}+"
# Quotation marks of the two styles; what script detection leaves out; its two bounds in bytes.
CURLY, CORNER = "“”‘’", "「」『』"
NOT_HAN = r"[!-/:-@\[-`{-~\t\n\x0B\f\r 0-9A-Za-z_著]"
DETECT_FROM, DETECT_IN = 1000, 200


def is_delimiter(char: Column) -> Column:
    return char.rlike(f"^{DELIMITER}$") & (F.length(char) == 1)


def split_chunks(text: Column, inclusive: bool = True) -> Column:
    """The chunks of ``text`` in order. Inclusive: a delimiter ends its chunk; else it is a chunk by itself. Empty text has none."""
    return F.regexp_extract_all(text, F.lit(INCLUSIVE if inclusive else EXCLUSIVE), F.lit(0))


def split_ranges(text: Column, inclusive: bool = True) -> Column:
    """Half-open byte ranges of the chunks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        end = acc["at"] + n
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.transform(split_chunks(text, inclusive), F.octet_length), start, step, lambda acc: acc["out"])


def punctuation(text: Column, style: str) -> Column:
    """Style "s": curly quotation marks become corner ones; "t": back; any other leaves the text."""
    if style == "s":
        return F.translate(text, CURLY, CORNER)
    return F.translate(text, CORNER, CURLY) if style == "t" else text


def map_characters(text: Column, table: Mapping[str, str]) -> Column:
    """Each character by ``table``, whose keys and values are single characters."""
    table = {k: v for k, v in table.items() if k != v}
    if any(len(k) != 1 or len(v) != 1 for k, v in table.items()):
        raise ValueError("keys and values must be single characters")
    return F.translate(text, "".join(table), "".join(table.values())) if table else text


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most ``most`` bytes."""
    raw = F.encode(text, "UTF-8")
    # A character has four bytes at most, so one of four cuts falls between two of them.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(0, most - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts, F.lit("")))


def detect_script(text: Column, to_simplified: Mapping[str, str], to_traditional: Mapping[str, str]) -> Column:
    """1: traditional, 2: simplified, 0: neither; traditional wins where both occur. Looks at the first 1000 bytes, less ASCII, and of
    those at 200."""
    seen = truncate_utf8(F.regexp_replace(truncate_utf8(text, DETECT_FROM), NOT_HAN, ""), DETECT_IN)
    one = lambda t: {k: v[:1] for k, v in t.items() if len(k) == 1 and k != v}  # noqa: E731  what matters is that it differs
    return F.when(seen != map_characters(seen, one(to_simplified)), 1).when(seen != map_characters(seen, one(to_traditional)), 2).when(text.isNotNull(), 0)


def strip_newlines(text: Column) -> Column:
    return F.translate(text, "\r\n", "")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def join_tokens(tokens: Column, delimiter: str = " ") -> Column:
    return F.array_join(tokens, delimiter)


def format_tags(tagged: Column, delimiter: str = " ", separator: str = "/") -> Column:
    """word, separator and tag of each pair, joined."""
    return F.array_join(F.transform(tagged, lambda x: F.concat(x["word"], F.lit(separator), x["tag"])), delimiter)


def keep_tags(tagged: Column, allowed: list[str] | None) -> Column:
    """The pairs whose tag is allowed; none, or only blank ones, given: all."""
    allowed = [a for a in allowed or [] if a.strip()]
    return F.filter(tagged, lambda x: x["tag"].isin(allowed)) if allowed else tagged


def format_thousands(n: Column) -> Column:
    return F.format_number(n, 0)
