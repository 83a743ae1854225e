"""Token counts by a compiled finite-state tokenizer.

The splitting pattern of a byte-level BPE tokenizer is compiled into a deterministic
transducer over character classes: its states are the ways a piece can be open, and its
transitions say whether a new piece opens (``STEP``, ``OPENS``). Texts are laid end to end
and cut into chunks of ``CHUNK`` characters; every chunk is reduced to its state map
(entry state to exit state), the maps compose by a parallel prefix scan, and with all
entry states known the chunks are replayed side by side. A text of any length is thus
many chunks, not one long walk.

A second transducer, compiled lazily, carries each piece to its emitted-token count. Its
entries are pieces, keyed by 64-bit hashes; the library itself emits the counts of pieces
that are met for the first time. Added special tokens that the library recognises inside
texts are cut out first and count one each.

Defined results: a null or empty text has no bytes and no tokens. Rows are independent.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import mixed

CHUNK = 256
#: Known pieces a worker keeps before it starts afresh: 16 bytes each.
REMEMBER = 4_000_000

LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, ONE, TWO, LAST_SPACE, LAST_BLANK, NEW = range(11)
#: Open piece: none, blank run, lone non-space blank, lone space, letters, numbers, others, quote, quote and a letter, contraction.
NONE, RUN, TAIL, GAP, WORD, DIGITS, MARKS, MARK, HALF, DONE = range(10)
SYMBOLS, STATES = 11, 10


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece opens, by state and symbol.

    ONE is a letter that completes a contraction after a quote, TWO one that begins a
    two-letter contraction; LAST_* is a blank followed by a non-blank, NEW the first
    character of a text in its class.
    """
    step, opens = np.zeros((STATES, SYMBOLS), np.uint8), np.ones((STATES, SYMBOLS), np.uint8)
    for state in range(STATES):
        for symbol in range(SYMBOLS):
            to, new = {
                LETTER: (WORD, state not in (WORD, GAP)), ONE: (WORD, state not in (WORD, GAP)), TWO: (WORD, state not in (WORD, GAP)),
                NUMBER: (DIGITS, state not in (DIGITS, GAP)),
                OTHER: (MARKS, state not in (MARKS, GAP, MARK)),
                QUOTE: (MARKS, False) if state in (MARKS, GAP, MARK) else (MARK, True),
                SPACE: (RUN, state != RUN), BLANK: (RUN, state != RUN),
                LAST_SPACE: (GAP, True), LAST_BLANK: (TAIL, True), NEW: (NONE, True),
            }[symbol]
            if state == MARK and symbol == ONE:
                to, new = DONE, False
            if state == MARK and symbol == TWO:
                to, new = HALF, False
            if state == HALF:
                to, new = DONE, False
            step[state, symbol], opens[state, symbol] = to, new
    step[:, NEW] = NONE
    return step, opens


STEP, OPENS = _tables()


def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = regex.compile(pattern)
        for plane in range(17):
            every = "".join(chr(c) for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000)
            for m in found.finditer(every):
                table[ord(m.group())] = kind
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


class Counter:
    """A tokenizer file compiled for counting; one for each task."""

    def __init__(self, path: str, table: np.ndarray):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        splitter = settings["pre_tokenizer"] or {}
        if splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or splitter.get("add_prefix_space") or settings["normalizer"]:
            raise ValueError("only byte-level BPE files with the standard pattern, no prefix space and no normalizer are compiled")
        self.table = table
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t["content"] for t in settings["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint16)

    def segments(self, texts: list[str | None]) -> tuple[list[str], list[int], np.ndarray]:
        """Stretches between added tokens with their rows, and the added tokens of each row."""
        parts, rows, added = [], [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            if not text:
                continue
            pieces = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
            added[row] = len(pieces) - 1
            for piece in filter(None, pieces):
                parts.append(piece)
                rows.append(row)
        return parts, rows, added

    def tokens(self, texts: list[str | None]) -> np.ndarray:
        parts, rows, counts = self.segments(texts)
        if not parts:
            return counts
        # A leading NUL stands for the edge of each text; it is the symbol NEW.
        joined = "\0" + "\0".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        edges = np.concatenate([[0], np.cumsum(lengths + 1)])
        opens = self.opens(points, edges[:-1])
        opens[edges[:-1]] = True
        starts = np.flatnonzero(opens)
        bytes_ = joined.encode("utf-8", "surrogatepass")
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        begin, end = at[starts], at[np.append(starts[1:], len(points))]
        piece_rows = np.asarray(rows)[np.searchsorted(edges, starts, side="right") - 1]
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, edges[:-1])] = False  # the NUL edges
        begin, end, piece_rows = begin[real], end[real], piece_rows[real]
        emitted = self.emitted(bytes_, begin, end)
        return counts + np.bincount(piece_rows, weights=emitted, minlength=len(texts)).astype(np.int64)

    def opens(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where a piece opens."""
        symbols = self.table[points]
        symbols[edges] = NEW
        blank = (symbols == SPACE) | (symbols == BLANK)
        solid_next = np.zeros(len(points), bool)
        solid_next[:-1] = ~blank[1:] & (symbols[1:] != NEW)
        symbols[blank & solid_next] += LAST_SPACE - SPACE
        for quote in np.flatnonzero(points[:-1] == ord("'")).tolist():
            follow = "".join(map(chr, points[quote + 1 : quote + 3].tolist()))
            if symbols[quote] == QUOTE and follow:
                if follow[0] in "stmd":
                    symbols[quote + 1] = ONE
                elif follow in ("re", "ve", "ll") and symbols[quote + 2] != NEW:
                    symbols[quote + 1] = TWO
        chunks = -(-len(symbols) // CHUNK)
        padded = np.full(chunks * CHUNK, NEW, np.uint8)
        padded[: len(symbols)] = symbols
        lanes = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        flat, marks = STEP.ravel(), OPENS.ravel()
        # State map of every chunk: exit state by entry state.
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
        for symbol in lanes:
            maps = flat[maps * np.uint8(SYMBOLS) + symbol]
        # Inclusive prefix scan of map composition (doubling).
        reach = 1
        while reach < chunks:
            maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0) if chunks > reach else maps[:, reach:]
            reach *= 2
        state = np.concatenate([[NONE], maps[NONE, :-1]]).astype(np.uint8)
        out = np.empty((CHUNK, chunks), np.uint8)
        for i, symbol in enumerate(lanes):
            at = state * np.uint8(SYMBOLS) + symbol
            out[i] = marks[at]
            state = flat[at]
        return out.T.reshape(-1)[: len(symbols)].astype(bool)

    def emitted(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of every piece data[begin:end]."""
        keys = piece_hashes(data, begin, end)
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.uint16)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            known = self.keys[spot] == distinct
            counts[known] = self.counts[spot[known]]
        else:
            known = np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            b, e = begin[first[new]].tolist(), end[first[new]].tolist()
            pieces = [data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(b, e, strict=True)]
            fresh = np.array([len(x) for x in self.library.encode_batch(pieces, add_special_tokens=False)], np.int64)
            if fresh.max() > 0xFFFF:  # longer than the table holds: counted for this slice only
                wide = counts.astype(np.int64)
                wide[new] = fresh
                self._learn(distinct[new][fresh <= 0xFFFF], fresh[fresh <= 0xFFFF])
                return wide[at]
            counts[new] = fresh
            self._learn(distinct[new], fresh)
        return counts[at]

    def _learn(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(self.keys) + len(keys) > REMEMBER:
            self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint16)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.counts = np.insert(self.keys, at, keys), np.insert(self.counts, at, counts.astype(np.uint16))


POWER = np.uint64(0xD6E8FEB86659FD93)
LONG_PIECE = 512


def piece_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end]: byte values mixed to 64 bits, as a polynomial."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = table[np.frombuffer(data, np.uint8)]
    size, place = (end - begin).astype(np.int64), begin.astype(np.int64)
    out = size.astype(np.uint64)
    order = np.argsort(size, kind="stable")
    edge = int(np.searchsorted(size[order], LONG_PIECE, side="right"))
    for piece in order[edge:].tolist():
        out[piece] = xxhash.xxh64_intdigest(data[begin[piece] : end[piece]])
    left, depth = order[:edge], 0
    while True:  # one step for each byte position, over the pieces that are that long
        left = left[np.searchsorted(size[left], depth, side="right") :]
        if not len(left):
            return mixed(out)
        out[left] = (out[left] ^ values[place[left] + depth]) * POWER
        out[left] ^= out[left] >> np.uint64(29)
        depth += 1


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    ``path`` is the tokenizer's file, the same on every worker; ``chars`` bounds the text
    a worker lays end to end at once (a longer single text is laid alone).
    """

    packed = zlib.compress(classes().tobytes())

    def count(batches):
        tokenizer = Counter(path, np.frombuffer(zlib.decompress(packed), np.uint8))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start, held = 0, 0
            for row, text in enumerate(texts):
                held += len(text or "")
                if held >= chars or row == len(texts) - 1:
                    some = texts[start : row + 1]
                    tokens = tokenizer.tokens(some)
                    sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in some]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, len(some)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())],
                        ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                    start, held = row + 1, 0

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
