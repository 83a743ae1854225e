"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the id pairs it links.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model that
adds the space itself (B). Where a token of A and a token of B end at the same byte, the two
are linked, and the text is cut there: between cuts lie the smallest groups of tokens that
cover the same bytes. As no token is empty, a cut has one token of each side, so a text has
as many links as groups.

Both tokenizers cut a text before a single space, so a task aligns each different word once
and a text is the sum of its words.

First pass: documents are aligned by *packets* (hash classes of rows, as many as the counted
bytes of text ask for), and each packet gives its distinct pairs with their counts, packed by
bucket of the B id. The pairs of a bucket are merged over packets as a tree, and a *minimal
perfect hash* numbers them: levels of bit maps in which a key owns a bit that no other key of
its level hits, its number being the rank of that bit. Counts become dense vectors indexed by
that number and are summed as a tree again. The key kept at each number verifies a lookup,
so a pair that was never counted cannot take another's count. A bucket holds all pairs of
its B ids, hence also their highest counts.

Second pass: every packet asks the buckets for its distinct pairs, its documents are aligned
again, and their links look their counts up.

Bounds: a packet's text (``packet_bytes``, or one longer text), ``fan`` partial tables of a
bucket, whose size the two vocabularies limit. Nothing is broadcast or collected.

Defined results: a text that is null or empty, or whose tokens do not give its bytes back
(a text with U+2581, which B writes for a space), has no tokens: zeros and ''. Rows are independent; repeated rows
count as often as they occur; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import mixed

#: How a byte-level BPE splits a text before its merges (fixed by the format).
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 64
PACKET_BYTES = 4 << 20
FAN = 512
#: Characters that a worker aligns at once.
SLICE_CHARS = 1 << 20
#: Links of known words at which a task starts afresh: some hundred bytes each.
REMEMBER = 2_000_000
COMMA, BAR, SEMICOLON = b",|;"
#: A space beside other white space, or at the end.
ODD = re.compile(r"\s | (?:\s|\Z)")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, all others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairs:
    """A byte-level BPE file: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model, splitter = settings["model"], settings["pre_tokenizer"] or {}
        if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or settings["normalizer"]:
            raise ValueError("only byte-level BPE files with the standard pattern, no prefix space and no normalizer are read")
        special = {t["id"] for t in settings["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in entry): n for entry, n in model["vocab"].items() if n not in special}
        self.bytes = [b""] * (1 + max(ranks.values()))
        for entry, n in ranks.items():
            self.bytes[n] = entry
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        places = [model["vocab"][a + b] for a, b in merged]
        if all(x < y for x, y in zip(places, places[1:])) and len(places) + 256 == len(ranks):
            import tiktoken

            # Merges stand in the order of their ids, so ids are ranks.
            fast = tiktoken.Encoding("given", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [fast.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A piece model: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        #: No merge crosses from a character to a space after it.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers and the alignment of every word met so far; one for each task.

    Both tokenizers cut a text before a single space, so a text is aligned word by word, and
    a word (with the space before it) only once. A text in which a space stands beside other
    white space or at an end is one word as a whole.
    """

    def __init__(self, left: str, right: str):
        self.left, self.right = BytePairs(left), Pieces(right)
        self.width = [np.array([len(b) for b in side.bytes], np.int64) for side in (self.left, self.right)]
        self.right_size = len(self.right.bytes)
        most = max(map(len, self.width))
        self.digits = np.zeros((most, len(str(most))), np.uint8)
        for n in range(most):
            self.digits[n, : len(str(n))] = list(b"%d" % n)
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.row = np.zeros(0, np.int64)  # by number
        #: By row: tokens of A and of B, links, whether the bytes agree.
        self.sizes = np.zeros((3, 0), np.int64)
        self.fits = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.uint64)
        self.shown: list[bytes] = []

    def one_by_one(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of either side of all words, their numbers by word, and which words fit."""
        spaced = [" " + w for w in words]
        ids = self.left.encode(spaced), self.right.encode(words)
        fits = np.array([
            b"".join(map(self.left.bytes.__getitem__, a)) == b"".join(map(self.right.bytes.__getitem__, b)) == w.encode()
            for w, a, b in zip(spaced, *ids, strict=True)], bool)
        ids = tuple([x if ok else [] for x, ok in zip(side, fits.tolist(), strict=True)] for side in ids)
        counts = [np.fromiter(map(len, side), np.int64, len(side)) for side in ids]
        return [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, counts, strict=True)], counts, fits

    def at_once(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray] | None:
        """The same, A's from one text of all words; None where that cannot be taken apart again."""
        joined = " " + " ".join(words)
        data = joined.encode()
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
        left, right = self.left.encode([joined])[0], self.right.encode(words)
        sizes = np.fromiter(map(len, right), np.int64, len(right))
        flat = [np.array(left, np.int64), np.fromiter(chain.from_iterable(right), np.int64, int(sizes.sum()))]
        counts = []
        for side, width, ids in zip((self.left, self.right), self.width, flat, strict=True):
            upto = np.cumsum(width[ids])
            last = np.searchsorted(upto, ends)
            if upto[-1] != len(data) or not np.array_equal(upto[last], ends) or b"".join(map(side.bytes.__getitem__, ids.tolist())) != data:
                return None
            counts.append(np.diff(np.append(-1, last)))
        return (flat, counts, np.ones(len(words), bool)) if np.array_equal(counts[1], sizes) else None

    def learn(self, words: list[str], odd: set[str]) -> None:
        """Align new words, among them odd texts as one word each."""
        alone = np.array([w in odd or w[-1].isspace() or "▁" in w for w in words], bool)
        plain = [w for w, one in zip(words, alone.tolist(), strict=True) if not one]
        found = [self.at_once(plain)] if plain else []
        if found and found[0] is None:
            found, alone = [], np.ones(len(words), bool)
        if alone.any():
            found.append(self.one_by_one([w for w, one in zip(words, alone.tolist(), strict=True) if one]))
        rows = np.empty(len(words), np.int64)
        rows[np.argsort(alone, kind="stable")] = np.arange(len(words))
        self.row = np.append(self.row, len(self.shown) + rows)
        flat, counts = ([np.concatenate([f[part][side] for f in found]) for side in (0, 1)] for part in (0, 1))
        fits = np.concatenate([f[2] for f in found])
        ends = [np.cumsum(width[x]) for width, x in zip(self.width, flat, strict=True)]
        cuts = []
        for mine, other in (ends, ends[::-1]):
            there = np.zeros(int(mine[-1]) + 1 if len(mine) else 1, bool)
            there[other] = True
            cuts.append(np.flatnonzero(there[mine]))
        edges = np.searchsorted(cuts[0], np.concatenate([[0], np.cumsum(counts[0])]))
        self.sizes = np.concatenate([self.sizes, [*counts, np.diff(edges)]], axis=1)
        self.fits = np.append(self.fits, fits)
        self.first = np.append(self.first, self.first[-1] + edges[1:])
        self.pairs = np.append(self.pairs, (flat[0][cuts[0]] * self.right_size + flat[1][cuts[1]]).astype(np.uint64))
        self.shown += self.groups(flat, cuts, counts)

    def groups(self, flat: list[np.ndarray], cuts: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every word."""
        marks, places = [], []
        for side, other in ((0, 1), (1, 0)):
            last = np.zeros(len(flat[side]), np.int64)
            last[cuts[side]] = 1
            # Tokens of the other side up to the group before this one (A), or up to this one (B).
            groups = np.cumsum(last) - last + side
            places.append(np.arange(len(last)) + np.concatenate([[0], cuts[other] + 1])[groups])
            marks.append(np.where(last == 1, BAR if side == 0 else SEMICOLON, COMMA))
        shown = np.empty((len(flat[0]) + len(flat[1]), self.digits.shape[1] + 1), np.uint8)
        for ids, mark, place in zip(flat, marks, places, strict=True):
            shown[place, :-1] = self.digits[ids]
            shown[place, -1] = mark
        solid = shown != 0
        data = shown[solid].tobytes()
        upto = np.concatenate([[0], np.cumsum(solid.sum(axis=1))])[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])]
        return [data[s : e - 1] if e > s else b"" for s, e in zip(upto.tolist(), upto[1:].tolist())]

    def slices(self, texts: list[str | None]) -> Iterator[Alignment]:
        """The alignment of runs of texts."""
        start, held = 0, 0
        for row, text in enumerate(texts):
            held += len(text or "")
            if held >= SLICE_CHARS or row == len(texts) - 1:
                yield Alignment(self, texts[start : row + 1])
                start, held = row + 1, 0


class Alignment:
    """Some texts as the numbers of their words."""

    def __init__(self, by: Aligner, texts: list[str | None]):
        if len(by.pairs) > REMEMBER:
            by.forget()
        self.by = by
        whole = [not by.right.apart or ODD.search(" " + t) is not None for t in texts if t]
        words = [[t] if one else t.split(" ") for t, one in zip(filter(None, texts), whole, strict=True)]
        sizes = np.zeros(len(texts), np.int64)
        sizes[[k for k, t in enumerate(texts) if t]] = list(map(len, words))
        numbers = np.fromiter(map(by.number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        new = len(by.number) - len(by.row)
        if new:
            by.learn(list(islice(reversed(by.number), new))[::-1], {w[0] for w, one in zip(words, whole, strict=True) if one})
        self.words = by.row[numbers]
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        misfits = self.sums(~by.fits)
        if misfits.any():  # such a text has no tokens at all
            self.words = self.words[np.repeat(misfits == 0, sizes)]
            self.edges = np.concatenate([[0], np.cumsum(np.where(misfits == 0, sizes, 0))])
        #: The words that occur, how often, and their links one after another.
        times = np.bincount(self.words, minlength=len(by.shown))
        self.met = np.flatnonzero(times)
        self.times, self.n_links = times[self.met], by.sizes[2, self.met]
        upto = np.cumsum(self.n_links)
        self.pairs = by.pairs[np.repeat(by.first[self.met] - (upto - self.n_links), self.n_links) + np.arange(upto[-1] if len(upto) else 0)]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and how often each is linked here (a pair may come several times)."""
        return self.pairs, np.repeat(self.times, self.n_links)

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        """Sum over every text of a value that each known word has."""
        upto = np.concatenate([[0], np.cumsum(by_word[self.words], dtype=np.int64)])
        return upto[self.edges[1:]] - upto[self.edges[:-1]]

    def sums_of_links(self, by_link: np.ndarray) -> np.ndarray:
        """Sum over every text of a value for each of ``pairs``."""
        upto = np.concatenate([[0], np.cumsum(by_link, dtype=np.int64)])
        ends = np.cumsum(self.n_links)
        by_word = np.zeros(len(self.by.shown), np.int64)
        by_word[self.met] = upto[ends] - upto[ends - self.n_links]
        return self.sums(by_word)

    def digests(self) -> list[str]:
        """SHA-256 of every text's groups as ``a1,a2|b1;a3|b2``; '' without tokens."""
        parts = list(map(self.by.shown.__getitem__, self.words.tolist()))
        edges = self.edges.tolist()
        return [hashlib.sha256(b";".join(parts[s:e])).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])]


class PerfectHash:
    """Distinct 64-bit keys to the numbers from 0, one each.

    Level k maps the keys that no earlier level placed to twice as many bits; a key alone on
    its bit is placed there. A key's number is the rank of its bit over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.cumsum(bits) - 1 for bits in levels]

    @staticmethod
    def bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            at = cls.bit(left, len(levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; for a key that is not among them any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.bit(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.before[level] + self.ranks[level][at[here]]
            left = left[~here]
        return out

    def packed(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        start, levels = 4 * (count + 1), []
        for size in np.frombuffer(data, "<u4", count, 4).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), start))[:size].astype(bool))
            start += -(-size // 8)
        return cls(levels)


def _keys(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, values = every[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(values, first) if len(first) else values


def tree(rows: DataFrame, parts: int, fan: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row per bucket from rows (bucket, part, …): ``merge`` meets at most ``fan`` parts of
    a bucket at once, level by level."""
    while parts > 1:
        parts = -(-parts // fan)
        rows = rows.withColumn("part", F.expr(f"part div {fan}")).groupBy("bucket", "part").applyInArrow(merge, schema)
    return rows


def pair_table(questions: DataFrame, packets: int, fan: int = FAN) -> DataFrame:
    """(bucket, hash, keys, counts) of all pairs in ``questions`` (bucket, packet, keys, counts):
    keys and counts stand by the number that the bucket's minimal perfect hash gives a key."""

    counted, keyed, dense = ("bucket int, part long, keys binary, counts binary", "bucket int, part long, keys binary",
                             "bucket int, part long, counts binary")

    def one(table: pa.Table, **blobs: bytes) -> pa.Table:
        head = {name: table[name][:1].combine_chunks() for name in ("bucket", "part")}
        return pa.table(head | {name: pa.array([blob], pa.binary()) for name, blob in blobs.items()})

    def merged(table: pa.Table) -> pa.Table:
        keys, counts = summed([_keys(b) for b in table["keys"].to_pylist()], [_longs(b) for b in table["counts"].to_pylist()])
        return one(table, keys=keys.tobytes(), counts=counts.tobytes())

    def united(table: pa.Table) -> pa.Table:
        return one(table, keys=np.unique(np.concatenate([_keys(b) for b in table["keys"].to_pylist()])).tobytes())

    def numbered(table: pa.Table) -> pa.Table:
        keys = _keys(table["keys"][0].as_py())
        found = PerfectHash.of(keys)
        placed = np.empty_like(keys)
        placed[found.numbers(keys)] = keys
        return pa.table({"bucket": table["bucket"][:1].combine_chunks(), "hash": pa.array([found.packed()], pa.binary()),
                         "keys": pa.array([placed.tobytes()], pa.binary())})

    def vectors(some: pa.Table, known: pa.Table) -> pa.Table:
        found, placed = PerfectHash.unpacked(known["hash"][0].as_py()), _keys(known["keys"][0].as_py())
        vector = np.zeros(len(placed), np.int64)
        for keys, counts in zip(some["keys"].to_pylist(), some["counts"].to_pylist(), strict=True):
            np.add.at(vector, verified(found, placed, _keys(keys)), _longs(counts))
        return one(some, counts=vector.tobytes())

    def added(table: pa.Table) -> pa.Table:
        return one(table, counts=np.sum([_longs(b) for b in table["counts"].to_pylist()], axis=0).tobytes())

    parts = -(-packets // fan)
    first = written(
        questions.select("bucket", F.expr(f"packet div {fan}").alias("part"), "keys", "counts")
        .groupBy("bucket", "part").applyInArrow(merged, counted), "pair-counts")
    union = tree(first.select("bucket", "part", "keys"), parts, fan, united, keyed)
    hashes = written(union.groupBy("bucket").applyInArrow(numbered, "bucket int, hash binary, keys binary"), "pair-hashes")
    groups = -(-parts // fan)
    partial = (
        first.withColumn("part", F.expr(f"part div {fan}")).groupBy("bucket", "part")
        .cogroup(_for_each(hashes, groups).groupBy("bucket", "part")).applyInArrow(
            lambda some, known: vectors(some, known) if some.num_rows else _empty(dense), dense))
    counts = tree(partial, groups, fan, added, dense).select("bucket", "counts")
    return written(hashes.join(counts, "bucket"), "pair-table")


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def _for_each(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))


def verified(found: PerfectHash, placed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys that must be known."""
    at = found.numbers(keys)
    if not np.array_equal(placed[at], keys):
        raise ValueError("a pair is not in the table of pairs")
    return at


def aligned(docs: DataFrame, left: str, right: str, *, packet_bytes: int = PACKET_BYTES, buckets: int = BUCKETS,
            fan: int = FAN) -> DataFrame:
    """Alignment of every row of ``docs`` (doc_id, text); ``left`` is the byte-level BPE's file
    and ``right`` the piece model's, at the same place on every worker."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // packet_bytes))
    packets = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).alias("packet"), "doc_id", "text")

    loaded: list[Aligner] = []  # filled in each task

    def aligner() -> Aligner:
        if not loaded:
            loaded.append(Aligner(left, right))
        return loaded[0]

    def ask(group: pa.Table) -> pa.Table:
        by = aligner()
        found = [summed([keys], [counts]) for keys, counts in (some.counted() for some in by.slices(group["text"].to_pylist()))]
        keys, counts = summed([k for k, _ in found], [c for _, c in found])
        bucket = (mixed(keys % np.uint64(by.right_size)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, counts = keys[order], counts[order]
        there, at = np.unique(bucket[order], return_index=True)
        edges = [*at.tolist(), len(keys)]
        return pa.table({
            "packet": pa.array([group["packet"][0].as_py()] * len(there), pa.int64()),
            "bucket": pa.array(there, pa.int32()),
            "keys": pa.array([keys[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary()),
            "counts": pa.array([counts[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary()),
        })

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _empty(replies)
        found, placed = PerfectHash.unpacked(known["hash"][0].as_py()), _keys(known["keys"][0].as_py())
        counts = _longs(known["counts"][0].as_py())
        right_ids = (placed % np.uint64(right_size)).astype(np.int64)
        highest = np.zeros(right_size, np.int64)
        np.maximum.at(highest, right_ids, counts)
        best = counts == highest[right_ids]
        at = [verified(found, placed, _keys(b)) for b in asked["keys"].to_pylist()]
        return pa.table({
            "packet": asked["packet"].combine_chunks(), "keys": asked["keys"].combine_chunks(),
            "counts": pa.array([counts[x].tobytes() for x in at], pa.binary()),
            "best": pa.array([best[x].tobytes() for x in at], pa.binary()),
        })

    def look_up(group: pa.Table, told: pa.Table) -> pa.Table:
        by = aligner()
        keys = np.concatenate([np.empty(0, np.uint64), *map(_keys, told["keys"].to_pylist())])
        counts = np.concatenate([np.empty(0, np.int64), *map(_longs, told["counts"].to_pylist())])
        best = np.concatenate([np.empty(0, bool), *(np.frombuffer(b, bool) for b in told["best"].to_pylist())])
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        out: dict[str, list] = {name: [] for name in ("n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256")}
        for some in by.slices(group["text"].to_pylist()):
            at = np.searchsorted(keys, some.pairs)
            if not np.array_equal(keys[at], some.pairs):
                raise ValueError("a pair was not asked for")
            for name, by_word in zip(("n_a", "n_b", "n_groups"), by.sizes, strict=True):
                out[name].append(some.sums(by_word))
            out["n_best"].append(some.sums_of_links(best[at]))
            out["count_sum"].append(some.sums_of_links(counts[at]))
            out["groups_sha256"] += some.digests()
        columns = {name: pa.array(np.concatenate(v) if name != "groups_sha256" else v) for name, v in out.items()}
        return pa.table({"doc_id": group["doc_id"].cast(pa.int64()).combine_chunks(), **columns, "n_links": columns["n_groups"]}).select(
            [f.split()[0] for f in ALIGNED.split(", ")])

    import sentencepiece

    right_size = sentencepiece.SentencePieceProcessor(model_file=right).get_piece_size()
    replies = "packet long, keys binary, counts binary, best binary"
    questions = written(packets.groupBy("packet").applyInArrow(ask, "packet long, bucket int, keys binary, counts binary"), "pair-questions")
    table = pair_table(questions, many, fan)
    told = (
        questions.withColumn("part", F.expr(f"packet div {fan}")).groupBy("bucket", "part")
        .cogroup(_for_each(table, -(-many // fan)).groupBy("bucket", "part")).applyInArrow(reply, replies))
    return packets.groupBy("packet").cogroup(told.groupBy("packet")).applyInArrow(look_up, ALIGNED)
