"""Splitting a text where the public byte-level pre-tokeniser always splits, so that results can be kept by chunk.

The pattern's matches take a blank only as their first character, or belong to a run of white space. So a match starts at
each single space between two characters that aren't white space, and what is matched between two such spaces doesn't
depend on what lies outside. Texts with other white space next to a space are split by the caller's own means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import compress
from operator import not_

#: Longer chunks are not kept: a text without blanks is one chunk.
LONG = 64
#: Texts are looked at together up to so many, or so many characters.
TEXTS, CHARACTERS = 256, 1_000_000


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of bounded size; a longer text is a list of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and (len(held) == TEXTS or size + len(t) > CHARACTERS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class ChunkCache:
    """Values by chunk, for many texts. Two generations of at most limit chunks: what isn't met again goes with the older."""

    def __init__(self, limit: int):
        self.limit, self.known, self.older = limit, {}, {}

    def values(self, texts: list[str], make: Callable[[list[str]], list]) -> list[list | None]:
        """For each text the values of its chunks in order, or None if it can't be split this way.

        make gets the chunks that aren't known, of all texts at once; all but a text's first begin with a blank. They are
        kept without that blank, a text's first chunk with one, so that the two don't meet.
        """
        known, older, parts, found, new = self.known, self.older, [], [], set()
        for text in texts:
            first, *rest = text.split(" ")
            if (first and first[-1].isspace() and rest) or not all(rest):
                parts.append(None)
                found.append(None)
                continue
            if first:
                rest.insert(0, " " + first)
            parts.append(rest)
            found.append(list(map(known.get, rest)))
            # a value is never empty
            new.update(compress(rest, map(not_, found[-1])))
        ask = []
        for c in new:
            if (v := older.get(c)) is not None:
                known[c] = v
            # next to the space that splits there must be no other white space
            elif c[0] == " " or not c[0].isspace():
                ask.append(c)
        known.update(zip(ask, make([c[1:] if c[0] == " " else " " + c for c in ask])))
        found = [list(map(known.get, rest)) if v is not None and None in v else v for rest, v in zip(parts, found)]
        for c in ask:
            if len(c) > LONG:
                del known[c]
        if len(known) > self.limit:
            self.older, self.known = known, {}
        return [None if v is None or None in v else v for v in found]
