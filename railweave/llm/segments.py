"""Cutting text where the usual byte-level BPE pre-tokeniser always has a piece boundary.

A single space or line feed between two characters that are not white space always starts a
piece of its own or of the word behind it, and no look-ahead reaches over it. So a text may
be cut before such a space, and on both sides of such a line feed, and the parts tokenised
apart: the ids in order are those of the whole text. Most parts are words that come again
and again, which a bounded memo then answers.
"""

import re

#: White space next to white space: there the look-ahead for a last space matters.
CLOSE = re.compile(r"\s\s")
#: Zero-width cuts that stay safe in texts that have such places.
CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")


class Memo(dict):
    """A dict that makes missing values and keeps those of short keys, in two generations.

    When the young one is full it becomes the old one; what is asked for again comes back,
    so common words stay and at most 2 x `entries` values are held.
    """

    def __init__(self, make, entries: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def parts(text: str) -> tuple[list[str], list[str], int]:
    """(parts as they are, words that have one space before them, line feeds by themselves), in no order."""
    if CLOSE.search(text):
        return CUTS.split(text), [], 0
    heads, tails, feeds = [], [], -1
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        heads.append(first)
        tails += rest
        feeds += 1
    return heads, tails, feeds
