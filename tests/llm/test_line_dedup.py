"""Repeated lines: odd rows, many lines, hot lines and a comparison with plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from tsprep.llm import line_dedup
from tsprep.llm.line_dedup import drop_repeated_lines, keep_bitmaps, line_digests

SCHEMA = "doc_id bigint, text string, n_dropped string, part int"
A = "a line that many documents share"


def key_of(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def by_hand(rows, min_chars=20, min_docs=3):
    docs = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key_of(line)) >= min_chars:
                docs[key_of(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if doc is None or len(docs[key_of(x)]) < min_docs or doc == max(docs[key_of(x)])
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, drop_repeated_lines(frame).collect()), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, f"{A}\nown line\n\n{A} ", "x", 1),
        (2, f"\t {A.upper()}\r\nshort\n", None, 2),
        (3, f"{A}", "x", 3),
        (3, f"first\n{A}\nsame id, other text", "x", 4),
        (4, f"x\n{A}\x0b", "x", 5),
        (4, f"x\n{A}\x0b", "x", 5),
        (5, None, "x", 6),
        (6, "", "x", 7),
        (7, "\n\n", "x", 8),
        (None, f"{A}\nno id", "x", 9),
        (8, "Ä line that no one else has, Äaaaaaaaaaa", "x", 10),
        (9, "ä line that no one else has, Äaaaaaaaaaa", "x", 11),
        (10, "a line with a hard space  ", "x", 12),
        (11, "exactly twenty chars\nnineteen characters", "x", 13),
        (12, "exactly twenty chars\nnineteen characters", "x", 13),
        (13, "exactly twenty chars\nnineteen characters", "x", 13),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == by_hand(rows)
    digests = {(r[0], r[3]) for r in line_digests(frame).collect()}
    assert digests == {(r[0], hashlib.sha256(r[3].encode()).hexdigest()) for r in by_hand(rows)}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_lines(none).collect() == []
    assert line_digests(none).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("hot_rows", [line_dedup.HOT_ROWS, 5])
def test_like_plain_python(spark, monkeypatch, hot_rows):
    """Very long documents, many shared lines, and hot lines on both ways."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    rng = random.Random(3)
    pool = [f"a shared line of the pool, number {i}" for i in range(300)]
    rows = []
    for i in range(60):
        n = 3_000 if i in (7, 50) else rng.randrange(1, 40)
        lines = [
            rng.choice(pool) if rng.random() < 0.6 else f"a line of its own {i} {j} and more"
            for j in range(n)
        ]
        rows.append((i * 7 % 61, "\n".join([A, *lines]), "x", 0))
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_bitmaps_hold_changed_words_only(spark):
    text = "\n".join([f"line number {i} of a long text" for i in range(200)])
    rows = [(i, f"{text}{i}\n{A}", "x", 0) for i in range(2)] + [(9, f"{A}\n{A}", "x", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in keep_bitmaps(frame).collect()}
    assert set(got) == {0, 1} and got[0]["n_dropped"] == 1
    assert [tuple(w) for w in got[0]["bitmap"]] == [(3, ~(1 << 8))]


def test_no_second_exchange_of_lines(spark, sf):
    """The window runs on the range partitioning; no Python anywhere."""
    rows = line_dedup.line_rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    plan = line_dedup.repeated_lines(rows)._jdf.queryExecution().executedPlan().toString()
    ranged = plan[plan.index("Window") :]
    assert ranged.count("Exchange") == 1 and "rangepartitioning(key" in ranged
    assert "Python" not in plan and "Pandas" not in plan
