"""Word segmentation: accurate, search and full modes, and tags."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from ..errors import LexiconReadError
from .matcher import chunks

#: Runs that are kept whole where no lexicon word covers them.
_HAN = "〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_RUN = re.compile(rf"[{_HAN}]+|[A-Za-z0-9]+(?:\.[0-9]+)?%?|\s+|.", re.S)
#: Chunks up to this length are kept, so many of them.
MEMO_LENGTH, MEMO_SIZE = 24, 1 << 16
_IS_HAN = re.compile(rf"[{_HAN}]")
_NUMBER, _LATIN = re.compile(r"[0-9.]+%?"), re.compile(r"[A-Za-z0-9]+")


class _Tags(dict):
    """Tags of words met, so many at most."""

    def __init__(self, words: Mapping[str, tuple[int, str | None]]):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> str:
        tag = self.words.get(word, (0, None))[1] or ("m" if _NUMBER.fullmatch(word) else "eng" if _LATIN.fullmatch(word) else "x")
        if len(self) >= MEMO_SIZE:
            self.clear()
        self[word] = tag
        return tag


class HmmModel:
    """Begin, middle, end and single states of characters: log probabilities of start, transition and emission."""

    def __init__(self, start: Mapping[str, float], move: Mapping[str, Mapping[str, float]], emit: Mapping[str, Mapping[str, float]], unseen: float = -20.0):
        self.start, self.move, self.emit, self.unseen = start, move, emit, unseen

    @classmethod
    def read(cls, path: str) -> HmmModel:
        """A JSON file of ``start`` (state to log probability), ``move`` (state to state), ``emit`` (state to character) and perhaps ``unseen``."""
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            return cls(raw["start"], raw["move"], raw["emit"], float(raw.get("unseen", -20.0)))
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            raise LexiconReadError(f"{path}: not a model: {e}") from e

    def cut(self, run: str) -> list[str]:
        """Viterbi; a state follows only where ``move`` has it."""
        score = {s: self.start.get(s, -1e9) + self.emit.get(s, {}).get(run[0], self.unseen) for s in "BMES"}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            best = {s: max((score[p] + self.move[p][s], p) for p in "BMES" if s in self.move.get(p, {})) for s in "BMES" if any(s in self.move.get(p, {}) for p in "BMES")}
            score = {s: best[s][0] + self.emit.get(s, {}).get(c, self.unseen) if s in best else -1e18 for s in "BMES"}
            back.append({s: b[1] for s, b in best.items()})
        state = max("ES", key=lambda s: score[s])
        states = [state]
        for b in reversed(back):
            states.append(state := b[state])
        states.reverse()
        out, at = [], 0
        for i, s in enumerate(states):
            if s in "ES":
                out.append(run[at : i + 1])
                at = i + 1
        return out + ([run[at:]] if at < len(run) else [])


class Segmenter:
    """``vocabulary``: word to (count, tag). The words of a chunk are those whose product of frequencies is greatest; a character that is no
    word counts once. Ties go to the longer word. With a model, runs of single characters that no word covers are cut by it."""

    def __init__(self, vocabulary: Mapping[str, tuple[int, str | None]], hmm: HmmModel | None = None):
        self.words = dict(vocabulary)
        self.hmm = hmm
        self.memo: tuple[dict[str, list[str]], dict[str, list[str]]] = {}, {}
        self.tags = _Tags(self.words)
        self.total = math.log(max(1, sum(f for f, _ in self.words.values())) + 1)
        self.weight = {w: math.log(max(1, f)) - self.total for w, (f, _) in self.words.items()}
        self.prefixes = {w[:i] for w in self.words for i in range(1, len(w))}
        self.mixed = any(not _IS_HAN.match(w[0]) or not _IS_HAN.match(w[-1]) for w in self.words if len(w) > 1)

    def _starts(self, run: str, i: int) -> list[int]:
        """Ends of the lexicon words of two characters or more that start at i."""
        out, j = [], i + 1
        while j < len(run) and (run[i:j] in self.prefixes):
            j += 1
            if run[i:j] in self.words:
                out.append(j)
        return out

    def _run(self, run: str, hmm: bool) -> list[str]:
        n = len(run)
        score, end = [0.0] * (n + 1), [n] * (n + 1)
        weight, prefixes, single = self.weight.get, self.prefixes, -self.total
        for i in range(n - 1, -1, -1):
            c = run[i]
            best, to = weight(c, single) + score[i + 1], i + 1
            if c in prefixes:
                for j in self._starts(run, i):
                    if (x := self.weight[run[i:j]] + score[j]) >= best:
                        best, to = x, j
            score[i], end[i] = best, to
        out, at, loose = [], 0, ""
        while at < n:
            word = run[at : end[at]]
            at = end[at]
            if hmm and self.hmm and len(word) == 1 and word not in self.words:
                loose += word
                continue
            out += self._loose(loose)
            loose = ""
            out.append(word)
        return out + self._loose(loose)

    def _loose(self, run: str) -> list[str]:
        return [] if not run else [run] if len(run) == 1 or not self.hmm else self.hmm.cut(run)

    def _chunk(self, chunk: str, hmm: bool) -> list[str]:
        """Short chunks come again and again; what they fall into is kept."""
        if len(chunk) > MEMO_LENGTH:
            return self._fresh(chunk, hmm)
        memo = self.memo[hmm]
        found = memo.get(chunk)
        if found is None:
            if len(memo) >= MEMO_SIZE:
                memo.clear()
            found = memo[chunk] = self._fresh(chunk, hmm)
        return found

    def _fresh(self, chunk: str, hmm: bool) -> list[str]:
        if chunk in self.words:
            return [chunk]
        out = []
        for run in _RUN.findall(chunk):
            out += [run] if run in self.words or not _IS_HAN.match(run) else self._run(run, hmm)
        return self._joined(out) if self.mixed else out

    def _joined(self, tokens: list[str]) -> list[str]:
        """Lexicon words that mix scripts, put together again: the longest first."""
        out, i = [], 0
        while i < len(tokens):
            text, take = tokens[i], 1
            whole, j = text, i + 1
            while j < len(tokens) and whole in self.prefixes:
                whole += tokens[j]
                j += 1
                if whole in self.words:
                    text, take = whole, j - i
            out.append(text)
            i += take
        return out

    def cut(self, text: str, hmm: bool = False) -> list[str]:
        """Delimiters are tokens too; nothing is lost."""
        out: list[str] = []
        get = self.memo[hmm].get
        for chunk in chunks(text):
            out += get(chunk) or self._chunk(chunk, hmm)
        return out

    def cut_chunk(self, chunk: str) -> list[str]:
        return self._chunk(chunk, True)

    def search(self, text: str, hmm: bool = False) -> list[str]:
        """Before a word, the lexicon words of two and then of three characters inside it."""
        out = []
        for word in self.cut(text, hmm):
            for size in (2, 3):
                if len(word) > size:
                    out += [word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in self.words]
            out.append(word)
        return out

    def full(self, text: str) -> list[str]:
        """Every lexicon word at every place, shorter first; single characters as well, even where a longer word covers them."""
        out = []
        for chunk in chunks(text):
            for run in _RUN.findall(chunk):
                if not _IS_HAN.match(run):
                    out.append(run)
                    continue
                for i in range(len(run)):
                    out += [run[i], *(run[i:j] for j in self._starts(run, i))]
        return out

    def tag(self, text: str, hmm: bool = False) -> list[tuple[str, str]]:
        """Tags of the lexicon; else m for numbers, eng for Latin words, x for the rest."""
        words = self.cut(text, hmm)
        return list(zip(words, self.tags_of(words), strict=True))

    def tags_of(self, words: list[str]) -> list[str]:
        return list(map(self.tags.__getitem__, words))
