"""Byte-pair encodings through their prefixes.

The encoding of a text's prefix ends in exactly one token, so a table with the last token of every prefix holds
the encodings of all prefixes at once: a token t that matches at the end of a prefix is its last token if and only
if t can follow the last token of the prefix before t, that is if the two tokens, joined and encoded anew,
come out as themselves. Nothing is merged in the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick


class PairTest:
    """Whether two tokens stay apart when encoded together; ``ranks`` orders the merges (lowest first).

    ``merge(a, b)`` gives the rank of joining two adjacent strings, or None.
    """

    def __init__(self, merge: Callable[[str, str], int | None], most: int = 300_000):
        self.merge, self.most, self.known = merge, most, {}

    def encode(self, text: str) -> list[str]:
        """The merges as they are defined, for short strings only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.merge(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def __call__(self, left: str, right: str) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[left, right] = self.encode(left + right) == [left, right]
        return found


class PrefixTable:
    """Encodes strings by the last tokens of their prefixes."""

    def __init__(self, tokens: list[str], merge: Callable[[str, str], int | None]):
        self.apart = PairTest(merge)
        self.automaton = ahocorasick.Automaton()
        for token in tokens:
            if len(token) > 1 and self.apart.encode(token) == [token]:  # a token that no merges reach never occurs
                self.automaton.add_word(token, (token, len(token)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def last_tokens(self, text: str) -> list[str]:
        """last[i]: the last token of text[: i + 1]. Single characters are tokens, known or not."""
        last = list(text)
        if not len(self.automaton):
            return last
        apart, known, done = self.apart, self.apart.known.get, -1
        for end, (token, size) in self.automaton.iter(text):  # by end, the longest first
            if end == done:
                continue
            start = end + 1 - size
            if start:
                left = last[start - 1]
                found = known((left, token))
                if found is None:
                    found = apart(left, token)
                if not found:
                    continue
            last[end], done = token, end
        return last

    def encode(self, text: str) -> list[str]:
        """The tokens, recovered backwards from the last one."""
        last, i, out = self.last_tokens(text), len(text), []
        while i:
            token = last[i - 1]
            out.append(token)
            i -= len(token)
        return out[::-1]
