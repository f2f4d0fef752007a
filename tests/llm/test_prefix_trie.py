"""Prefix trees against plain Python, list ranking against a walk, odd conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tsprep.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs int"


def tree_by_hand(conversations):
    """``conversations``: id to list of (role, text)."""
    members, ends, children, parent_of = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
                parent_of[tuple(turns[:d])] = tuple(turns[: d - 1])
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for v in members:
        own = (len(members[v]) - 1) * (len(v[-1][1]) if v else 0)
        for d in range(len(v) + 1):
            leaves[v[:d]] += not children[v]
            saved[v[:d]] += own
    return sorted(
        (
            min(m), len(v), min(members[parent_of[v]]) if v else None, len(m), len(children[v]),
            leaves[v], saved[v], hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest(),
        )
        for v, m in members.items()
    )


def grouped(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in out.items()}


def rebuilt_by_hand(rows):
    own = grouped(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def found(frame):
    return sorted(map(tuple, frame.drop("enter", "exit").collect()), key=lambda r: (r[0], r[1]))


def random_rows(n, seed, roles=("user", "assistant"), most=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(0, 400)
        for t in range(rng.randrange(1, most)):
            text = "hot" if rng.random() < 0.5 else rng.choice(["a", "bb", "ccc", "日本", "", None])
            rows.append((c, t, rng.choice([*roles, None]), text, "x", 1))
    seen = {}
    for r in rows:
        seen[r[:2]] = r
    return list(seen.values())


def test_rebuilt_like_plain_python(spark):
    rows = random_rows(200, 1) + [
        (None, 0, "user", "no conversation", "x", 1),
        (500, None, "user", "null turn first", "x", 1),
        (500, 3, "user", "then three", "x", 1),
        (601, 5, "user", "no first of its hundred", "x", 1),
        (-3, 0, "user", "a negative id", "x", 1),
        (702, 0, None, "y" * 300_000, "x", 1),
        (700, 0, None, "y" * 300_000, "x", 1),
    ]
    turns = T.turns_in_order(spark.createDataFrame(rows, SCHEMA))
    wanted = {}
    own = grouped(rows)
    for c, listed in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        wanted[c] = own.get(base, [])[:h] + listed[h:]
    assert found(T.prefix_trie(T.rebuild(turns))) == tree_by_hand(wanted)


def test_small_blocks_and_cut_conversations(spark):
    """Many rounds of contraction with coins between them, and conversations in chunks."""
    rows = random_rows(60, 2) + [(7, t, "user", str(t % 3), "x", 1) for t in range(100, 160)]
    turns = T.as_they_are(T.turns_in_order(spark.createDataFrame(rows, SCHEMA), max_series_rows=9))
    got = T.prefix_trie(turns, block=64, max_series_rows=9)
    assert found(got) == tree_by_hand(grouped(rows))
    places = [p for r in got.collect() for p in (r["enter"], r["exit"])]
    assert sorted(places) == list(range(len(places)))


def test_ties_and_repeated_turns(spark):
    """Turns of equal number come in one order in all conversations, whatever the rows' order."""
    turns = [(0, "user", "b"), (0, "user", "a"), (0, "user", "a"), (1, "assistant", "c")]
    rows = [(c, *t, "x", 1) for c in (1, 2) for t in (turns if c == 1 else turns[::-1])]
    got = found(T.prefix_trie(T.as_they_are(T.turns_in_order(spark.createDataFrame(rows, SCHEMA)))))
    assert [r[1:5] for r in got] == [(d, None if d == 0 else 1, 2, int(d < 4)) for d in range(5)]


def test_turnless_and_empty(spark):
    lone = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(lone, 0, "user", "left out, as the first of the hundred is absent", "x", 1)]
    got = found(T.prefix_trie(T.rebuild(T.turns_in_order(spark.createDataFrame(rows, SCHEMA)))))
    assert got == tree_by_hand({lone: []}) and got[0][3] == 1
    none = T.prefix_trie(T.rebuild(T.turns_in_order(spark.createDataFrame([], SCHEMA))))
    assert none.collect() == []


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_list_ranking(spark, block):
    """A list in random order, the worst for blocks."""
    rng = np.random.default_rng(block)
    order = rng.permutation(60)
    weights = rng.integers(0, 9, (60, 2))
    after = {int(a): int(b) for a, b in zip(order, order[1:])}
    rows = [(int(a), after.get(int(a)), 1, int(weights[a, 0]), int(weights[a, 1])) for a in range(60)]
    arcs = spark.createDataFrame(rows, "arc bigint, succ bigint, rank bigint, leaves bigint, saved bigint")
    got = {r["arc"]: tuple(r)[1:] for r in T.rank_list(arcs, block).collect()}
    sums = np.zeros(2, int)
    for i, a in enumerate(order):
        assert got[int(a)] == (i, *sums)
        sums = sums + weights[a]


def test_contract_one_chain():
    arc = np.array([2, 5, 7, 9])
    head, offset, first, succ, total = T.contract(arc, np.array([7, 2, 30, -1]), np.array([[1], [2], [3], [4]]))
    assert head.tolist() == [1, 1, 1, 3] and offset[:, 0].tolist() == [2, 0, 3, 0]
    assert sorted(zip(first.tolist(), succ.tolist(), total[:, 0].tolist())) == [(1, 30, 6), (3, -1, 4)]
