"""Cutting a text where a byte-level BPE pre-tokenizer always cuts, and remembering frequent chunks.

A single space between two characters that are not white space always starts a new
pre-token, so a text is the concatenation of such chunks and so are its ids. Frequent
chunks repeat; a bounded two-generation memory keeps their ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """Parts between lone spaces. Every part but the first has lost its leading space."""
    words = text.split()
    if len(text) - sum(map(len, words)) == len(words) - 1:  # all white space is single characters between words
        return text.split(" ")
    return _LONE_SPACE.split(text)


class Memory(dict):
    """key -> make(key), for at most ``2 * size`` recent keys."""

    def __init__(self, make: Callable[[str], bytes], size: int = 3 << 17, longest: int = 256):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Chunker:
    """Ids of a text as packed bytes, block by block."""

    def __init__(self, make: Callable[[str], bytes], specials: dict[str, bytes]):
        self.first, self.spaced = Memory(make), Memory(lambda word: make(" " + word))
        self.specials = specials
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def blocks(self, text: str, letters: int = 1 << 17) -> Iterator[bytes]:
        """Packed ids of ``text``, of about ``letters`` letters at a time."""
        if self.cut is None or not any(x in text for x in self.specials):
            yield from self._plain(text, 0, len(text), letters)
            return
        at = 0
        for found in self.cut.finditer(text):
            yield from self._plain(text, at, found.start(), letters)
            yield self.specials[found.group()]
            at = found.end()
        yield from self._plain(text, at, len(text), letters)

    def _plain(self, text: str, at: int, end: int, letters: int) -> Iterator[bytes]:
        """A part without special tokens, cut at lone spaces."""
        first = True
        while at < end:
            cut = _LONE_SPACE.search(text, at + letters, end) if at + letters < end else None
            upto = cut.start() if cut else end
            parts = words_of(text[at:upto])
            yield (self.first if first else self.spaced)[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))
            at, first = upto + 1, False
