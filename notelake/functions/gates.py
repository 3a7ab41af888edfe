"""Which of many patterns a text can match, from one pass over a batch of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick

#: Characters that are joined and searched at once; a longer text is searched alone.
AT_ONCE = 4 << 20


def folded(text: str) -> str:
    """The text in a case that ignores what ``re.IGNORECASE`` ignores for ASCII letters."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").casefold()


def _portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The folded texts (null: empty) in lists of ``AT_ONCE`` characters or one text."""
    held, size = [], 0
    for t in texts:
        low = folded(t) if t else ""
        if held and size + len(low) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(low)
        size += len(low)
    if held:
        yield held


class Patterns:
    """Compiled patterns with their anchors: folded strings (without NUL) of which every match holds one.

    An automaton finds the anchors of all patterns in one pass, so what a text costs depends on
    its length and the anchors in it, not on the number of patterns.  A pattern without anchors
    is tried on every text.
    """

    def __init__(self, patterns: Sequence[str], anchors: Sequence[Sequence[str]], flags: Sequence[int] | None = None):
        self.compiled = [re.compile(p, f) for p, f in zip(patterns, flags or [0] * len(patterns), strict=True)]
        self.always, bits = 0, {}
        for i, (_, some) in enumerate(zip(patterns, anchors, strict=True)):
            self.always |= (not some) << i
            for s in some:
                bits[s] = bits.get(s, 0) | 1 << i
        self.automaton = ahocorasick.Automaton()
        for s, b in bits.items():
            self.automaton.add_word(s, b)
        if bits:
            self.automaton.make_automaton()

    def possible(self, texts: Iterable[str | None]) -> Iterator[int]:
        """For each text, the patterns to try on it: bit i for pattern i."""
        for part in _portions(texts):
            found = [self.always] * len(part)
            k, end = 0, len(part[0])
            for at, b in self.automaton.iter("\0".join(part)) if len(self.automaton) else ():
                while at > end:
                    k += 1
                    end += 1 + len(part[k])
                found[k] |= b
            yield from found
