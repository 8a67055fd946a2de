"""Phrase matching inside one text; pure Python, run by Arrow functions on executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from ..functions.text import DELIMITER_CHARACTERS, DELIMITERS

#: The longest window that is matched within a token, in characters.
WINDOW = 64
#: Chunks up to this length are kept, so many of them.
MEMO_LENGTH, MEMO_SIZE = 24, 1 << 16
_CLASS = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in DELIMITERS)
_CHUNK = re.compile(f"[^{_CLASS}]*[{_CLASS}]|[^{_CLASS}]+")
IS_DELIMITER = frozenset(DELIMITER_CHARACTERS)


def chunks(text: str) -> list[str]:
    return _CHUNK.findall(text)


def _plain(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):X}}}"


def phrase_pattern(keys: Iterable[str]) -> str:
    """A pattern of Java's that finds any of ``keys``, told apart by their first characters."""
    rest: dict[str, list[str]] = {}
    for k in sorted(keys):
        rest.setdefault(k[0], []).append("".join(map(_plain, k[1:])))
    return f"(?=[{''.join(map(_plain, rest))}])(?:{'|'.join(f'{_plain(c)}(?:{"|".join(ends)})' for c, ends in rest.items())})"


class Round:
    """The tables of one round as one map: for a key, the first table that has it decides."""

    def __init__(self, tables: Sequence[Mapping[str, str]]):
        self.map: dict[str, str] = {}
        self.memo: dict[str, str] = {}
        for table in reversed(tables):
            self.map.update(table)
        self.longest = min(WINDOW, max(map(len, self.map), default=0))
        self.lengths = sorted({len(k) for k in self.map if len(k) <= WINDOW}, reverse=True)

    def native(self, most: int) -> tuple[dict[str, str], list[str]] | None:
        """What single characters become, and the longer keys, ``most`` at most: a text that holds none of those is mapped by character. None where
        characters become several, or delimiters are keys."""
        single = {k: v for k, v in self.map.items() if len(k) == 1}
        phrases = [k for k in self.map if len(k) > 1]
        if len(phrases) > most or any(len(v) != 1 for v in single.values()) or IS_DELIMITER.intersection(single):
            return None
        return single, phrases

    def by_character(self, text: str) -> str:
        get = self.map.get
        return "".join([get(c, c) for c in text])

    def by_longest(self, token: str) -> str:
        """From left to right the longest key that starts here; a character that starts none stays."""
        out, at, n, get = [], 0, len(token), self.map.get
        while at < n:
            for size in self.lengths:
                if size <= n - at and (value := get(token[at : at + size])) is not None:
                    out.append(value)
                    at += size
                    break
            else:
                out.append(token[at])
                at += 1
        return "".join(out)

    def token(self, token: str) -> str:
        if len(token) == 1:
            return token if token in IS_DELIMITER else self.map.get(token, token)
        if (whole := self.map.get(token)) is not None:
            return whole
        return self.by_character(token) if len(token) < 3 else self.by_longest(token)

    def chunk(self, chunk: str, cut: Callable[[str], list[str]]) -> str:
        """Short chunks come again and again; what becomes of them is kept, for one and the same ``cut``."""
        if (known := self.memo.get(chunk)) is not None:
            return known
        out = "".join([self.token(t) for t in cut(chunk)])
        if len(chunk) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[chunk] = out
        return out


def convert(text: str, rounds: Iterable[Round], cut: Callable[[str], list[str]]) -> str:
    """Each round over the result of the one before. A key is found inside a token only, never across two. A round without any key
    leaves the text. A round object goes with one ``cut``."""
    for r in rounds:
        if r.map:
            text = "".join([r.chunk(c, cut) for c in chunks(text)])
    return text
