"""Conversation repair against a plain search over (row, state) with whole audits as strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tillwatch.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, fault string, rows string"


def by_force(rows):
    """The contract's row for one conversation; rows: (turn, role, text) of the input, with their conv_id."""
    after = []
    for k, (conv, turn, role, text) in enumerate(rows):
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(way, text)
        role = "user" if way == 4 else role
        after += [(turn is not None, turn or 0, role.encode(), text.encode(), k, c, role, text) for c in range({0: 0, 3: 2}.get(way, 1))]
    after.sort(key=lambda r: r[:6])
    turns = [r[1] for r in after if r[0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for r in after:
        visible = re.findall("[^\x20\x09-\x0d]", r[7])
        faults.append("blank" if not visible else "duplicate" if r[6:] in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add(r[6:])
    initials = [r[6][:1] for r in after]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    after_ = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {s: (0, "", []) if s in ("", "a") else None for s in after_}
    long = {"u": "user", "a": "assistant"}

    def inserted(now):
        for _ in range(4):
            for s in after_:
                for to in "ua":
                    if to in after_[s] and now[to] is not None:
                        c, audit, out = now[to]
                        option = (c + 3, "I" + audit, [f"{long[to]}:", *out])
                        if now[s] is None or option[:2] < now[s][:2]:
                            now[s] = option
        return now

    best = inserted(best)
    for r, fault in reversed(list(zip(after, faults, strict=True))):
        now = {}
        for s in after_:
            options = []
            if best[s]:
                options.append((best[s][0] + 4, "D" + best[s][1], best[s][2]))
            if fault not in ("blank", "duplicate"):
                for to in after_[s]:
                    if best[to] is None:
                        continue
                    if r[6][:1] == to:
                        options.append((best[to][0] + 3 * (fault == "truncated"), "K" + best[to][1], [f"{r[6]}:{r[7]}", *best[to][2]]))
                    if to in long:
                        options.append((best[to][0] + 3 + 3 * (fault == "truncated"), "R" + best[to][1], [f"{long[to]}:{r[7]}", *best[to][2]]))
            now[s] = min(options, key=lambda o: o[:2]) if options else None
        best = inserted(now)
    cost, audit, out = best[""]
    if not after:
        cost, audit, out = 0, "", []
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[:4])
    return {conv: by_force(g) for conv, g in groups.items()}


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def made(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "agent", "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "no", "", None, " \n", "What?", "a b c!", "x\n", "é.", "Sure. \t"]
    return [(conv, rng.choice([None, t, t, t, t + 3]), rng.choice(roles), rng.choice([*texts, f"own {t}."]), "x", "y") for conv in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("chunk_rows", [1, 3, 65_536])
def test_repairs_against_brute_force(spark, chunk_rows):
    rows = made(chunk_rows, 120, 14) + [(None, 1, "user", "no id.", "x", "y"), (None, None, None, None, "x", "y")] + [(900, 1, "user", "same.", "x", "y")] * 5
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversations.audited(frame, chunk_rows)) == expected(rows)


def test_long_conversation_of_equal_rows_converges_in_few_rounds(spark):
    """Rows that must all go never converge by themselves: the costs of 300 chunks travel by doubling."""
    rows = [(1, t, "assistant", "", "x", "y") for t in range(600)] + [(1, 600 + t, ("user", "assistant")[t % 2], f"t{t}.", "x", "y") for t in range(41)]
    assert got(conversations.audited(spark.createDataFrame(rows, SCHEMA), 2)) == expected(rows)


def test_spanning_vectors_cover_what_can_follow():
    """Costs behind a chunk are a minimum over the spanning vectors, whatever rows follow."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        codes = rng.integers(0, conversations.CODES, (1, rng.integers(0, 9)))
        right = conversations.backward(codes, conversations.END[None, :])[0, 0]
        assert (right == (right[:, None] + conversations.SPAN).min(0)).all()


def test_empty_table(spark):
    assert conversations.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(queries.op11_conversation_repair(spark, sf)) == expected(rows)
