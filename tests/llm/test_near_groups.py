"""Groups of near copies whose members do not link to the smallest one, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from tsprep.llm import minhash
from tsprep.llm.minhash import MinMax, near_duplicates, shingles, spanning_links, words

SCHEMA = "doc_id bigint, text string, kept string, component_id int"


def components_by_hand(texts):
    sets = {i: shingles(words(t)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def changed(rng, text, times):
    text = list(text)
    for _ in range(times):
        text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
    return text


def shapes():
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    chain = [base]
    for _ in range(40):
        chain.append(changed(rng, chain[-1], 2))
    hub = [f"h{rng.randrange(4000)}" for _ in range(150)]
    star = [changed(rng, hub, 4) for _ in range(40)]
    crowd = [f"c{rng.randrange(4000)}" for _ in range(150)]
    group = [changed(rng, crowd, 2 + i % 4) for i in range(80)]
    return {"chain": chain, "star": [*star, hub], "crowd": group}


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [" ".join(t) for group in shapes().values() for t in group]
    random.Random(6).shuffle(texts)
    numbered = dict(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in numbered.items()], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()}
    assert got == components_by_hand(numbered)


def test_spanning_links_join_every_component_once():
    """All members alike: 39 links for 40 members, not 780."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    scheme, fine = MinMax(), MinMax(2, 512)
    prints = [scheme.fingerprints(" ".join(changed(rng, base, 1)).encode().split()) for _ in range(40)]
    few = list(range(1, 40))
    rows = [(n, n, 0, n in few) for n in few] + [(n, n, 0, False) for n in range(40)]
    group = pd.DataFrame(rows, columns=["node", "root", "main", "few"])
    group["sketch"] = [fine.signature(prints[n]).astype(np.uint8).tobytes() for n in group["node"]]
    group["prints"] = [prints[n].tobytes() for n in group["node"]]
    a, b = spanning_links(group, 0.68, 75)
    assert len(a) == 39 and all(x > y for x, y in zip(a, b))
