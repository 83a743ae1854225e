"""Secret scans by grammar inference.

Formats of credentials are learned, not listed: labelled credentials are written as runs
of character classes, a prefix tree with frequencies is built from them, and statistically
compatible states are merged (Hoeffding bound) into a probabilistic automaton. A second
automaton is learned from the background: candidate-shaped runs that no base match touches,
which are ordinary long words and numbers but for a few. Every candidate of every text is scored by
its log-likelihood ratio a class symbol; those above ``least_ratio`` become spans of kind
``learned`` beside the fixed base kinds.

The labelled credentials are a bounded, hash-chosen sample of base matches of the corpus
(``sample`` of each kind) and its background likewise; the automata are a few hundred
states whatever the corpus size. Everything else covers all texts whole.

Defined results: a null or empty text has no spans. A learned span never overlaps a base
span. Rows are independent. Extra columns are ignored. With no labelled credentials
(an empty table) only base spans are found, and likewise with no background: then no run
of at most 512 characters is left to be judged. Examples to learn from have 8 to 512 characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row

#: Fixed patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "learned")
HINTS = ("passw", "secret", "token", "api")
#: What may be a credential: an ASCII run of 16 or more. The likelihood ratio alone decides.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("base_sha256", pa.string()), ("spans", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Runs that may be credentials and overlap no base span."""
    # Spans that begin before a candidate ends, and the furthest end among them, tell an overlap.
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        near = bisect_left(starts, m.end())
        if not near or ends[near - 1] <= m.start():
            yield m


def symbols(value: str) -> list[str]:
    """A credential as class symbols: up to four leading characters as they are (formats
    have fixed heads), then runs of a class, long ones by length in powers of two."""
    out = list(value[:4])
    for run in re.findall(r"[0-9a-f]+|[0-9]+|[a-z]+|[A-Z0-9]+|[A-Z]+|[A-Za-z0-9]+|[^A-Za-z0-9]+", value[4:]):
        kind = ("h" if re.fullmatch(r"[0-9a-f]*[0-9][0-9a-f]*", run) else "l" if run.islower() else "U" if run.isupper() else "n" if run.isdigit() else "p" if not run[0].isalnum() else "m")
        out.append(f"{kind}{min(len(run).bit_length(), 6)}")
    return out


class Automaton:
    """A probabilistic automaton merged from the prefix tree of its examples."""

    def __init__(self, examples: list[list[str]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.total: list[int] = [0]
        for example in examples:
            at = 0
            self.total[0] += 1
            for s in example:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.total.append(0)
                self.seen[at][s] = self.seen[at].get(s, 0) + 1
                at = self.next[at][s]
                self.total[at] += 1
            self.ends[at] += 1
        self.alphabet = len({s for e in examples for s in e}) + 1
        self._merge(alpha)

    def _differs(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        work = [(a, b)]
        while work:
            x, y = work.pop()
            if not self.total[x] or not self.total[y]:
                continue
            if self._differs(self.ends[x], self.total[x], self.ends[y], self.total[y], alpha):
                return False
            for s in self.seen[x].keys() | self.seen[y].keys():
                if self._differs(self.seen[x].get(s, 0), self.total[x], self.seen[y].get(s, 0), self.total[y], alpha):
                    return False
                if s in self.next[x] and s in self.next[y]:
                    work.append((self.next[x][s], self.next[y][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        work = [(into, tree)]
        while work:
            x, y = work.pop()
            self.ends[x] += self.ends[y]
            self.total[x] += self.total[y]
            for s, n in self.seen[y].items():
                self.seen[x][s] = self.seen[x].get(s, 0) + n
                if s in self.next[x]:
                    work.append((self.next[x][s], self.next[y][s]))
                else:
                    self.next[x][s] = self.next[y][s]

    def _merge(self, alpha: float) -> None:
        """Red-blue merging; a blue state joins the first compatible red one or turns red."""
        red = [0]
        is_red = {0}
        while True:
            blue = sorted((-self.total[t], q, s, t) for q in red for s, t in self.next[q].items() if t not in is_red)
            if not blue:
                break
            _, q, s, t = blue[0]
            for r in red:
                if self._compatible(r, t, alpha):
                    self.next[q][s] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                is_red.add(t)
        order = {q: k for k, q in enumerate(red)}
        self.states = [({s: (math.log((self.seen[q][s] + 0.5) / (self.total[q] + 0.5 * self.alphabet)), order[t]) for s, t in self.next[q].items()},
                        math.log(0.5 / (self.total[q] + 0.5 * self.alphabet)), math.log((self.ends[q] + 0.5) / (self.total[q] + 0.5 * self.alphabet)))
                       for q in red]
        del self.next, self.seen, self.ends, self.total

    def score(self, example: list[str]) -> float:
        """Log-likelihood for each symbol; an unknown step keeps the state."""
        at, total = 0, 0.0
        for s in example:
            steps, unknown, _ = self.states[at]
            cost, at = steps.get(s, (unknown, at))
            total += cost
        return (total + self.states[at][2]) / (len(example) + 1)


def learned_model(docs: DataFrame, sample: int) -> tuple[Automaton, Automaton] | None:
    """Automata of credentials and of the background, from at most ``sample`` examples of each."""

    def examples(batches):
        for batch in batches:
            kinds, values = [], []
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for start, kind, end in spans:
                    m = ASSIGN.match(text, start) if kind == 0 else None
                    kinds.append(1)
                    values.append(m[2] if m else text[start:end])
                for m in candidates(text, spans):
                    kinds.append(0)
                    values.append(m.group())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], ["kind", "value"])

    # A reservoir of fixed size: each of ``sample`` hash cells of a kind keeps its smallest
    # value, aggregated before the exchange, so the same values are chosen every time.
    found = docs.select("text").mapInArrow(examples, "kind int, value string").filter(F.length("value").between(8, 512))
    hashed = found.withColumn("h", F.xxhash64("value"))
    chosen = hashed.groupBy("kind", F.pmod("h", F.lit(sample)).alias("cell")).agg(F.min(F.struct("h", "value")).alias("least"))
    union = chosen.select("kind", "least.value")
    got = defaultdict(list)
    for r in sorted(union.collect()):
        got[r["kind"]].append(symbols(r["value"]))
    if not got[1] or not got[0]:
        return None
    return Automaton(got[1]), Automaton(got[0])


def secret_scan(docs: DataFrame, sample: int = 4096, least_ratio: float = 2.0) -> DataFrame:
    """Counts, digest of base spans and all spans of every row of ``docs`` (doc_id, text)."""
    model = learned_model(docs, sample)

    def spans(text: str | None) -> tuple:
        if not text:
            return 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""
        base = base_spans(text)
        every = list(base)
        if model:
            for m in candidates(text, base):
                parts = symbols(m.group())
                if model[0].score(parts) - model[1].score(parts) >= least_ratio:
                    every.append((m.start(), 3, m.end()))
        told = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        return *count, hashlib.sha256(told(base).encode()).hexdigest(), told(every)

    names = ARROW.names[1:]

    def run(rows):
        found = [spans(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {name: [f[k] for f in found] for k, name in enumerate(names)}

    return docs.select("doc_id", "text").mapInArrow(by_row(run, ARROW), SCHEMA)
