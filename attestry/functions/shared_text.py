"""The longest text that a frame's lines share with its captions, one row per frame.

The captions of a frame make one suffix automaton, in which every state knows the first
caption that holds its pieces; each line is walked through it once. Time is linear in the
texts, however many captions and lines there are. Lines without a pair of characters in
common with any caption are left out before.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import fold_text

DIGIT = re.compile(r"\d")


class Pieces:
    """Suffix automaton of several texts; ``first`` of a state is the first text that has it."""

    def __init__(self, texts: list[str]):
        self.length, self.link, self.next, self.first = [0], [-1], [{}], [len(texts)]
        for n, text in enumerate(texts):
            last = 0
            for letter in text:
                last = self._extended(last, letter)
                self.first[last] = min(self.first[last], n)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            self.first[up] = min(self.first[up], self.first[state])

    def _state(self, length: int, link: int, onward: dict[str, int], first: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, state: int, letter: str, target: int) -> int:
        """A copy of ``target`` for the shorter pieces that reach it from ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]), self.first[target])
        while state >= 0 and self.next[state].get(letter) == target:
            self.next[state][letter] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def _extended(self, last: int, letter: str) -> int:
        target = self.next[last].get(letter)
        if target is not None:  # an earlier text has it
            return target if self.length[target] == self.length[last] + 1 else self._split(last, letter, target)
        new, state = self._state(self.length[last] + 1, 0, {}, self.first[0]), last
        while state >= 0 and letter not in self.next[state]:
            self.next[state][letter] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][letter]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, letter, target)
        return new

    def longest(self, line: str) -> tuple[int, int, int]:
        """Length of the longest piece shared with ``line``, the first text that shares one as
        long, and where its first such piece ends in the line."""
        state = size = best = end = 0
        first = self.first[0]
        for at, letter in enumerate(line, 1):
            while state and letter not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if letter in self.next[state]:
                state = self.next[state][letter]
                size += 1
            if size > best or (size == best and size and self.first[state] < first):
                best, first, end = size, self.first[state], at
        return best, first, end


def short_piece(line: str, text: str) -> str:
    """The first longest piece of three or two characters that both have."""
    for size in (3, 2):
        there = {text[i : i + size] for i in range(len(text) - size + 1)}
        for i in range(len(line) - size + 1):
            if line[i : i + size] in there:
                return line[i : i + size]
    return ""


def best_shared(lines: list[str], texts: list[str]) -> tuple[str, int, int] | None:
    """The longest useful shared text with its line and caption, the first of either on ties:
    four characters, or two if what a line and a caption share first has a digit."""
    pairs = {t[i : i + 2] for t in texts for i in range(len(t) - 1)}
    near = [n for n, line in enumerate(lines) if any(line[i : i + 2] in pairs for i in range(len(line) - 1))]
    if not near:
        return None
    pieces = Pieces(texts)
    walked = [(*pieces.longest(lines[n]), n) for n in near]
    size, text, end, line = max(walked, key=lambda w: (w[0], -w[3]))
    if size >= 4:
        return lines[line][end - size : end], line, text
    short = [(short_piece(lines[n], t), n, m) for n in near for m, t in enumerate(texts)]
    return max((x for x in short if len(x[0]) >= 2 and DIGIT.search(x[0])), key=lambda x: (len(x[0]), -x[1], -x[2]), default=None)


SHARED = pa.struct([("shared", pa.string()), ("line", pa.int32()), ("text", pa.int32())])


def shared_text(lines: Column, texts: Column) -> Column:
    """``best_shared`` of two arrays of raw texts: struct of (shared, line, text), places from 0."""

    @F.arrow_udf("struct<shared:string,line:int,text:int>")
    def best(lines: pa.Array, texts: pa.Array) -> pa.Array:
        known: dict[str, str] = {}

        def folded(values: list[str | None] | None) -> list[str]:
            return [known[v] if v in known else known.setdefault(v, fold_text(v)) for v in (x or "" for x in values or ())]

        found = (best_shared(folded(a.as_py()), folded(b.as_py())) for a, b in zip(lines, texts, strict=True))
        return pa.array([None if x is None else dict(zip(("shared", "line", "text"), x)) for x in found], SHARED)

    return best.asNondeterministic()(lines, texts)
