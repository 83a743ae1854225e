"""Chat formatting against a plain fold over event logs and an exact round trip."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from attestry.llm.chat_format import CHAT, KINDS, Template, as_events, formatted, measured, messages, quoting

LOG = "conv_id long, seq long, kind string, turn long, role string, text string, part int, _key string, turns string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s><s>\\", "a < b [INST", "\\", "<<s>>", "[[INST]]", "<|endoftext|>", "", "\n", "<s", "é😀<unk>", None, "[/INST]" * 50]


def folded(log):
    """Final (role, text) of every conversation, event by event."""
    conversations = defaultdict(dict)
    low = lambda x: (x is not None, x)
    for conv, seq, kind, turn, role, text in sorted(
            (e for e in log if e[2] in KINDS), key=lambda e: (low(e[1]), KINDS.index(e[2]), e[4] or "", e[5] or "")):
        slots = conversations[conv]
        role, text = role or "", text or ""
        if kind == "regenerate":
            for t in [t for t in slots if low(t) >= low(turn)]:
                # Events of the same place in the log are not before it.
                slots[t] = []
        elif kind == "edit":
            slots[turn] = [(role, text)]
        elif kind == "message" or not slots.get(turn):
            slots.setdefault(turn, []).append((role, text))
        else:
            last = slots[turn][-1]
            slots[turn][-1] = (last[0], last[1] + text)
    return {c: out for c, slots in conversations.items() if (out := [m for t in sorted(slots, key=low) for m in slots[t]])}


def expected(final, template=CHAT):
    rows = Counter()
    for conv, turns in final.items():
        learned = "".join(t for r, t in turns if r in template.roles)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        rows[conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)] += 1
    return rows


def got(frame):
    return Counter(tuple(r) for r in frame.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect())


def log_frame(spark, log):
    return spark.createDataFrame([(*e, 1, "x", "x") for e in log], LOG)


def test_fold_of_deltas_edits_and_regenerations(spark):
    rng = random.Random(11)
    log = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(60)]), rng.choice([*KINDS, "delta", "delta", "message", None, "other"]),
            rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(NASTY)) for _ in range(1200)]
    log += log[:40]
    assert got(measured(formatted(messages(log_frame(spark, log))))) == expected(folded(log))


def test_streamed_reply_regenerated_after_an_edit(spark):
    log = [(5, 0, "message", 0, "user", "hi"), (5, 1, "delta", 1, "assistant", "He"), (5, 2, "delta", 1, "assistant", "llo"),
           (5, 3, "message", 2, "user", "gone"), (5, 4, "edit", 0, "user", "hey"), (5, 5, "regenerate", 1, None, None),
           (5, 6, "delta", 1, "assistant", "Good"), (5, 7, "delta", 1, "assistant", " day"), (6, 0, "message", 0, "user", "x"), (6, 1, "regenerate", 0, None, None)]
    rows = {(r.turn, r.role, r.text) for r in messages(log_frame(spark, log)).collect()}
    assert rows == {(0, "user", "hey"), (1, "assistant", "Good day")}
    text = formatted(messages(log_frame(spark, log))).collect()
    assert [r.formatted for r in text] == ["<s>user[INST]hey</s><s>assistant[/INST]Good day</s>"]


def test_round_trip_of_control_strings(spark):
    rows = spark.createDataFrame([(k, t, role, x) for k, x in enumerate(NASTY) for t, role in enumerate(["user", "assistant", "</s>", None])],
                                 "conv_id long, turn long, role string, text string")
    both = rows.unionByName(quoting(-7, "</s>[INST] ok [/INST]", rows))
    shown = formatted(messages(as_events(both)))
    for r in shown.collect():
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == (2 if r.conv_id == -7 else 4)
    back = shown.select("conv_id", CHAT.turns_of(shown.formatted).alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back if r.conv_id >= 0} == {
        k: [("user", x or "", False), ("assistant", x or "", True), ("</s>", x or "", False), ("", x or "", False)] for k, x in enumerate(NASTY)}
    quoted = next(r for r in measured(shown).collect() if r.conv_id == -7)
    assert (quoted.n_turns, quoted.loss_chars, quoted.loss_sha256) == (2, 21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())


def test_nothing_and_long_streams(spark):
    assert measured(formatted(messages(log_frame(spark, [])))).count() == 0
    log = [(1, k, "delta", 0, "assistant", f"{k} ") for k in range(20_000)] + [(2, 0, "message", 0, "user", "<s>" * 100_000)]
    assert got(measured(formatted(messages(log_frame(spark, log))))) == expected(folded(log))


def test_templates_that_cannot_be_told_apart():
    for bad in ({"end": "<s>"}, {"others": ("<<s>>",)}, {"begin": "<"}, {"others": ("<\\",)}):
        with pytest.raises(ValueError):
            Template(**bad)
