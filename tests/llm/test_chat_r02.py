"""Blocks with more turns than an array may hold."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tidewait.llm import chat


@pytest.mark.parametrize("per_range", [1 << 18, 20])
def test_crowded_blocks(spark, monkeypatch, per_range):
    """No conversation id, no turn number and repeated numbers: parts are bounded and together the whole block."""
    monkeypatch.setattr(chat, "RANGE_ROWS", per_range)
    rows = [(None, k % 9, "ab"[k % 2], f"text {k * 37 % 101}") for k in range(150)] + [(1, None, "ab"[k % 2], f"t{k}") for k in range(23)]
    rows += [(2, k, "a", "x") for k in range(8)] + [(3, 0, "a", "same")] * 30 + [(1, 3, "c", "one more")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.rotate_perspectives(table, most_turns=10).collect()
    want = defaultdict(list)
    for conv, turn, role, text in set(rows):
        turn = -1 if turn is None else turn
        for speaker in {r[2] for r in rows if r[0] == conv}:
            want[(conv, speaker, turn // 64)].append((turn, role, text))
    assert {(r.conv_id, r.speaker, r.block) for r in got} == set(want)
    for (conv, speaker, block), turns in want.items():
        parts = sorted((r for r in got if (r.conv_id, r.speaker, r.block) == (conv, speaker, block)), key=lambda r: r.part)
        turns.sort()
        assert [r.part for r in parts] == list(range(-(-len(turns) // 10)))
        for r in parts:
            some = turns[r.part * 10 : r.part * 10 + 10]
            heads = ["assistant" if role == speaker else f"user name={role}" for _, role, _ in some]
            assert r.text == "".join(f"<|im_start|>{h}\n{t}<|im_end|>\n" for h, (_, _, t) in zip(heads, some, strict=True))
            assert r.n_turns == len(some) and [r.text[m.start : m.end] for m in r.mask] == [f"{t}<|im_end|>" for _, role, t in some if role == speaker]
