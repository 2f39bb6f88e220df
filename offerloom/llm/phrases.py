"""Whole-word phrases in text, found with one Aho-Corasick automaton.

Text is normalised as bytes: A-Z is lower-cased, everything in ASCII that is no letter or digit separates words,
bytes above 0x7F belong to words.  Words are joined by one blank with a blank at both ends, so that a phrase
with blanks around it matches whole words only.  The automaton reads the bytes as Latin-1 characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np

from offerloom.llm.common import ship

ship(__name__)

#: The words of the contracts in text whose A-Z is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def joined(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


class Phrases:
    """Phrases with a number each.  The automaton is built where it is used, once per process."""

    def __init__(self, phrases: list[list[bytes]]):
        self.phrases = phrases
        self._automaton = None

    def __getstate__(self):
        return {"phrases": self.phrases, "_automaton": None}

    def _built(self):
        if self._automaton is None:
            automaton = ahocorasick.Automaton()
            for number, words in enumerate(self.phrases):
                automaton.add_word(joined(words), number)
            automaton.make_automaton()
            self._automaton = automaton
        return self._automaton

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(number of the phrase, its first word) of every place, phrases distinct."""
        if not words or not self.phrases:
            return
        text = joined(words)
        blanks = None
        for end, number in self._built().iter(text):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
            last = int(np.searchsorted(blanks, end)) - 1
            yield number, last - len(self.phrases[number]) + 1


def char_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the text as given."""
    return [m.span() for m in WORD.finditer(text.translate(UPPER))]
