"""One text at a time on the driver, with a configuration that stays set; for single documents and notebooks."""

from __future__ import annotations

from ..functions.text import CORNER, CURLY
from ..plans.configs import Config, config
from ..sources.lexicon import Lexicon, builtin
from .matcher import Round, convert
from .segment import Segmenter


class Converter:
    """``convert`` with a configuration of its own leaves the one that is set. An unknown configuration raises."""

    def __init__(self, lexicon: Lexicon | None = None, value: str | int | Config = "s2t"):
        self.lexicon = lexicon if lexicon is not None else builtin()
        self.segmenter = Segmenter(self.lexicon.vocabulary())
        self._rounds: dict[str, list[Round]] = {}
        self.set_config(value)

    def set_config(self, value: str | int | Config) -> None:
        self._config = config(value)

    def get_config(self) -> str:
        return self._config.name

    def convert(self, text: str, value: str | int | Config | None = None, punct: bool = False) -> str:
        c = self._config if value is None else config(value)
        if c.name not in self._rounds:
            self._rounds[c.name] = [Round([self.lexicon.table(s) for s in r]) for r in c.rounds]
        out = convert(text, self._rounds[c.name], self.segmenter.cut_chunk)
        return out.translate(str.maketrans(*((CURLY, CORNER) if c.punct == "s" else (CORNER, CURLY)))) if punct else out
