"""Cross-tokenizer alignment against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attestry.llm.queries import vocabulary
from attestry.llm.token_alignment import PerfectHash, aligned, byte_alphabet, verified

LEFT, RIGHT = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = ["<|endoftext|> and </s><s>", "it's we'LL 12345 ½ ﬁ", "a  b   c\n\n\td ", "héllo wörld", "日本語テキスト", "👩‍👩‍👧 emoji‍", "a▁b", "▁", " ", "\x00\x01", "x" * 3000, " " * 500, "<0x41>", "a ", "a  ", " a", "  a  b c   ", "\n \n a", "a\u00a0 b", ", .  ,"]


def brute(rows):
    left, right = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    left.encode_special_tokens = True
    letters = byte_alphabet()
    docs, seen = [], Counter()
    for doc, text in rows:
        groups, links = [], []
        if text:
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
            bytes_a = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b, at = {}, {}, 0
                for k, x in enumerate(bytes_a):
                    ends_a[at := at + len(x)] = k
                at = 0
                for k, x in enumerate(bytes_b):
                    ends_b[at := at + len(x)] = k
                i = j = 0
                for cut in sorted(ends_a.keys() & ends_b.keys()):
                    links.append((a[ends_a[cut]], b[ends_b[cut]]))
                    groups.append(",".join(map(str, a[i : ends_a[cut] + 1])) + "|" + ",".join(map(str, b[j : ends_b[cut] + 1])))
                    i, j = ends_a[cut] + 1, ends_b[cut] + 1
                docs.append((doc, len(a), len(b), groups, links))
                seen.update(links)
                continue
        docs.append((doc, 0, 0, groups, links))
    best = defaultdict(int)
    for (_, b), n in seen.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc, n_a, n_b, len(groups), len(links), sum(seen[x] == best[x[1]] for x in links), sum(seen[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in docs)


def result(frame):
    return Counter(tuple(r) for r in frame.select(*COLUMNS).collect())


@pytest.mark.parametrize("options", [{}, {"packet_bytes": 3000, "fan": 2, "buckets": 3}])
def test_alignment(docs, rows, options):
    assert result(aligned(docs, LEFT, RIGHT, **options)) == brute([(i, t) for i, t, _ in rows])


def test_alignment_of_hard_texts(spark):
    rng = random.Random(8)
    blanks = ["".join(rng.choice([" ", " ", "\n", "a", "bc", "\u00a0", "1", "'s", ".", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = list(enumerate(HARD + blanks)) + [(50, HARD[1]), (50, HARD[1])]
    assert result(aligned(spark.createDataFrame(rows, "doc_id long, text string"), LEFT, RIGHT)) == brute(rows)


def test_alignment_of_nothing(nothing):
    assert aligned(nothing, LEFT, RIGHT).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).choice(1 << 40, 20_000, replace=False).astype(np.uint64)
    found = PerfectHash.unpacked(PerfectHash.of(keys).packed())
    numbers = found.numbers(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    placed = np.empty_like(keys)
    placed[numbers] = keys
    with pytest.raises(ValueError):
        verified(found, placed, np.array([1 << 41], np.uint64))
    assert len(PerfectHash.unpacked(PerfectHash.of(keys[:0]).packed()).numbers(keys[:2])) == 2
