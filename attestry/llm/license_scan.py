"""License scans: Aho-Corasick over folded words and over raw text, with a shunting-yard
evaluator for and/or/with licence expressions.

One automaton runs over each text's folded words joined by single blanks and finds notice
phrases; a second one finds identifier tags (``SPDX-License-Identifier:`` and the like) in
the raw text, after which the expression is parsed. Base phrases count every place where
their words stand consecutively.

Defined results: a null or blank text has no words, no places and score 0. Overlapping
places all count. An expression that does not parse adds the label ``unparsed``. Rows are
independent. Extra columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_row, folded_words

#: Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases: label and how surely the phrase alone states terms.
NOTICES = {
    "mit license": ("mit", 0.9),
    "apache license": ("apache", 0.9),
    "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "gnu general public license": ("gpl", 0.95),
    "creative commons": ("cc", 0.7),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.6),
    "the unlicense": ("unlicense", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "without prior written permission": ("reserved", 0.6),
}
BASE_SURE = {"cc-by": 0.7, "gpl": 0.9, "reserved": 0.8}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
STEP = re.compile(rf"[ \t]*({TOKEN.pattern})")
#: Operators by how tightly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>")
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def postfix(expression: str) -> list[str]:
    """The expression in postfix order, by shunting-yard; ValueError if it is malformed."""
    out, waiting, operand = [], [], True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word in BINDS:
            if operand:
                raise ValueError(f"operator {token} has no left side")
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ValueError("( follows a licence")
            waiting.append(token)
        elif token == ")":
            if operand:
                raise ValueError(") follows an operator")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(") without (")
            waiting.pop()
        else:
            if not operand:
                raise ValueError("two licences in a row")
            out.append(word)
            operand = False
    if operand:
        raise ValueError("incomplete")
    while waiting:
        if (top := waiting.pop()) == "(":
            raise ValueError("( without )")
        out.append(top)
    return out


def choices(expression: str) -> list[frozenset[str]]:
    """The sets of licences, any one of which satisfies the expression. ``with`` binds an
    exception to its licence, ``and`` joins sets, ``or`` offers alternatives. There may be
    exponentially many, so the scan takes ``leaves`` instead."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix(expression):
        if token not in BINDS:
            stack.append([frozenset([token])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif token == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:
            (a,), (b,) = (left[0], right[0]) if len(left) == len(right) == 1 and len(left[0]) == len(right[0]) == 1 else ((None,), (None,))
            if a is None:
                raise ValueError("with joins one licence and one exception")
            stack.append([frozenset([f"{a} with {b}"])])
    return stack.pop()


def leaves(expression: str) -> list[str]:
    """The licences that an expression is built from, each with its exception where it has one;
    ValueError if it is malformed. Walks the parsed expression once, without expanding it."""
    found: dict[str, None] = {}
    stack: list[str | None] = []  # a licence, or None for a compound
    for token in postfix(expression):
        if token not in BINDS:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left is None or right is None or " with " in left or " with " in right:
                raise ValueError("with joins one licence and one exception")
            stack.append(f"{left} with {right}")
        else:
            found |= dict.fromkeys(x for x in (left, right) if x is not None)
            stack.append(None)
    if stack[0] is not None:
        found[stack[0]] = None
    return list(found)


def _leading_expression(text: str, at: int) -> str:
    """The longest run of tokens from ``at`` that can be an expression: it ends before a second
    licence in a row, which is the prose after the tag, and before the next tag, so that no
    text is read for two tags."""
    kept, operand, depth = [], True, 0
    while step := STEP.match(text, at):
        token, at = step[1], step.end()
        word = token.lower()
        if word in TAGS:
            break
        if word in BINDS:
            if operand:
                break
            operand = True
        elif token == "(":
            if not operand:
                break
            depth += 1
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif not operand:
            break
        else:
            operand = False
        kept.append(token)
    return " ".join(kept)


def automata():
    """The automata of phrases and of tags; built once for each task."""
    phrases = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES]:
        phrases.add_word(f" {phrase} ", phrase)
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None, phrases, tags) -> tuple:
    words = folded_words(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    # Latin-1 keeps one character for each byte; the phrases are ASCII.
    line = f" {b' '.join(words).decode('latin-1')} "
    base, first, last, labels, surety, expressions = set(), None, None, set(), 0.0, []
    count, counted_to, place = 0, 0, 0
    for end, phrase in phrases.iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE:
            base.add(BASE[phrase])
            surety = max(surety, BASE_SURE[BASE[phrase]])
            count += 1
            # Words before the place: its blanks so far; places of one phrase length may step back.
            if start < counted_to:
                counted_to, place = 0, 0
            place += line.count(" ", counted_to, start)
            counted_to = start
            first = place if first is None else min(first, place)
            last = place if last is None else max(last, place)
        if phrase in NOTICES:
            label, sure = NOTICES[phrase]
            labels.add(label)
            surety = max(surety, sure)
    lower = text.encode("utf-8", "surrogatepass").lower().decode("latin-1")
    if "license-" in lower or "licence-" in lower:
        for end, _ in tags.iter(lower):
            expression = _leading_expression(lower, end + 1)
            surety = max(surety, 1.0)
            try:
                labels.update(leaves(expression))
                expressions.append(expression)
            except ValueError:
                labels.add("unparsed")
    every = base | labels
    return (len(words), count, first, last, ",".join(sorted(base)), ",".join(sorted(every)),
            surety, expressions)


def license_scan(docs: DataFrame) -> DataFrame:
    """The scan of every row of ``docs`` (doc_id, text)."""
    names = ARROW.names[1:]

    def mapped(batches):
        phrases, tags = automata()

        def run(rows):
            found = [scan(t, phrases, tags) for t in rows["text"]]
            return {"doc_id": rows["doc_id"]} | {name: [f[k] for f in found] for k, name in enumerate(names)}

        yield from by_row(run, ARROW)(batches)

    return docs.select("doc_id", "text").mapInArrow(mapped, SCHEMA)
