"""The operators on small tables: odd rows, brute force, the tokenizers' own results, and SQL."""

import contextlib
import os
import random
import hashlib
import threading
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, mismatch
from tsprep.llm import queries
from tsprep.llm.backoff_lm import backoff_scores
from tsprep.llm.bpe_lexicon import Codec, Lexicon, Merger, compile_lexicon, encode_decode
from tsprep.llm.common import Memo
from tsprep.llm.components import connected_components
from tsprep.llm import cross_polytope
from tsprep.llm.cross_polytope import nearest
from tsprep.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tsprep.llm.html_content import extract, fit_weights, labelled_pages, main_text
from tsprep.llm.license_scan import TEMPLATES, scan_licenses
from tsprep.llm.minhash import near_duplicates, shingles, words
from tsprep.llm.packing import fill, pack
from tsprep.llm.quality_crf import Chain, FEATURES, fit_quality, marginals, score_quality
from tsprep.llm.token_counts import (
    PrefixCounts, count_tokens, longest_cut, token_prefixes, tokens_at, tokens_before, truncate,
)

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away again", "x", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs away again", None, 2),
    (3, None, "x", None),
    (4, "", "x", 4),
    (5, " \n\t ", "x", 5),
    (6, "two words", "x", 6),
    (7, LONG, "x", 7),
    (8, LONG + " tail", "x", 8),
    (9, "Ünïcode Σς 日本 <|endoftext|> don't  stop\n\nnow", "x", 9),
    (None, "no id here but five words at least", "x", 10),
    (2, "another text under an id that is taken", "x", 11),
]
COLUMNS = "doc_id bigint, text string, kept string, score bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    assert mismatch(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name]) is None


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (40, 40), (35, 31)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert dict(got) == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30, 35: 30}


def brute_groups(rows, percent=75):
    sets = [(i, shingles(words(t or ""))) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_chain_and_a_large_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(40):  # each two steps apart share less than the bar; the chain links them
        part = base[:]
        part[:n] = [f"z{i}" for i in range(n)]
        rows.append((100 - n, " ".join(part)))
    rows += [(200 + n, "same text in many copies of one group") for n in range(50)]
    want = brute_groups(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_odd_rows(odd, none):
    got = [tuple(r) for r in near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert (1, 9, 1, True) in got and (2, 9, 1, False) in got
    assert (3, 0, 3, True) in got and (6, 1, 6, True) in got
    assert (None, 4, None, True) in got and (2, 4, 1, False) in got
    assert [r[2] for r in got if r[0] == 8] == [7]
    assert near_duplicates(none).count() == 0


def test_exact_duplicates_odd_rows(odd, none):
    got = exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    same = hashlib.sha256(ODD[0][1].encode()).hexdigest()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["text_sha256"] == same} == {
        (1, 2, 2, False), (2, 2, 2, True)
    }
    assert {(r["doc_id"], r["kept"]) for r in got if r["doc_id"] in (3, 4)} == {(3, False), (4, True)}
    assert exact_duplicates(none).count() == 0


def test_weak_digest_gives_the_same_rows(spark, sf):
    docs = table(spark, sf, "documents")
    weak = exact_duplicates(docs, digest=lambda t: F.encode((F.length(t) % 7).cast("string"), "utf-8"))
    strong = exact_duplicates(docs)
    assert weak.exceptAll(strong).isEmpty() and strong.exceptAll(weak).isEmpty()


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a text"), (5, "a text"), (None, "b"), (None, "b"), (1, "a text")]
    stay = drop_exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, stay.collect()), key=str) == [(5, "a text"), (None, "b")]


def test_fill_finds_the_best_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        chosen = fill(counts, 60)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= 60)


def check_packing(pieces, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        at[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        place = 0
        for p in sorted(at.pop(doc), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (place, len(ids))
            place += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : place].tobytes())
        assert place == len(ids)
    assert not at
    for ps in sequences.values():
        end = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end == capacity or end < capacity and not end & (end - 1)


def test_packing(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(pack(docs).collect(), texts, 4096)
    check_packing(pack(docs, capacity=64, pool=8).collect(), texts, 64)
    one = odd.dropDuplicates(["doc_id"])
    check_packing(pack(one).collect(), {r["doc_id"]: r["text"] for r in one.collect()}, 4096)
    assert pack(none).count() == 0


def test_token_counts_and_prefixes(spark, sf, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted((r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in count_tokens(docs).collect())
    texts = [r["text"] or "" for r in docs.collect()]
    assert got == sorted((count(t), len(t.encode()), count(t) > 2048) for t in texts)
    assert count_tokens(none).count() == 0
    counts = PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("internationalization", "thwhating", "zzzzqqqq", "don", "!!!???"):
        assert counts.prefixes(word) == [count(word[:i]) for i in range(len(word) + 1)]
    for budget in (0, 1, 5, 50):
        for r in truncate(odd.where("doc_id <> 7"), budget).collect():
            assert count(r["text"]) <= budget
    kept = token_prefixes(odd).select("doc_id", tokens_before(F.lit(13)).alias("n"), tokens_before(F.lit(0)).alias("z"))
    assert {(r["n"], r["z"]) for r in kept.where("doc_id = 1").collect()} == {(count("The quick bro"[:9]), 0)}


CUT = [
    "漢字かな交じり文は空白なしで続く。次の文", "aGVsbG8gd29ybGQhIHRoaXMgaXMgYmFzZTY0Cg==",
    "  they'll we've you're don't 'll !!'s x'rex ", "ab<|endoftext|>cd!!<|endoftext|>", "Ünï ΣΑΣ e\u0301te\u0301 İstanbul",
    "하나 \u1112\u1161\u11ab naïve\n\ttabs", "\U0001f600\U0001f468\u200d\U0001f469 ok", "ﬁne ½ x²", "", " \n",
    "a <|endoftext|><|endoftext|>b",
]


def test_token_counts_at_every_character(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame(list(enumerate(CUT)), "doc_id bigint, text string")
    kept = token_prefixes(df).join(df, "doc_id")
    for r in kept.select("text", "inside", *(tokens_at(F.lit(n)).alias(f"n{n}") for n in (0, 3, 99))).collect():
        text = r["text"]
        assert r["inside"] == [count(text[:n]) for n in range(1, len(text) + 1)], text
        assert [r["n0"], r["n3"], r["n99"]] == [0, count(text[:3]), count(text)]
    for budget in (-1, 0, 3, 7):
        cuts = {r["doc_id"]: r["n"] for r in kept.select("doc_id", longest_cut(F.lit(budget)).alias("n")).collect()}
        for i, text in enumerate(CUT):
            fit = [n for n in range(len(text) + 1) if count(text[:n]) <= budget]
            assert cuts[i] == max(fit, default=0), (text, budget)
        whole = {r["doc_id"]: len(r["text"]) for r in truncate(df, budget).collect()}
        assert all(whole[i] == cuts[i] for i, text in enumerate(CUT) if budget >= 0)


def test_lexicon_is_minimal_and_exact(tmp_path):
    merger = Merger(public_tokenizers.path("byte_bpe_50k.json"))
    entries = {w.encode(): merger.encode(w) for w in (" walking", " talking", " talk", " wal", " a")}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(compile_lexicon(entries))
    lexicon = Lexicon(str(path))
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    assert lexicon.get(b" walk") is None and lexicon.get(b"") is None and lexicon.get(b" x") is None
    states = {w[:i] for w in entries for i in range(len(w) + 1)}
    assert np.frombuffer(lexicon.block, "<u4", 4)[1] < len(states)
    path.write_bytes(compile_lexicon({}))
    assert Lexicon(str(path)).get(b" a") is None


def test_codec(spark, sf, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        want.append((r["doc_id"], len(ids), *digests))
    assert sorted(map(tuple, encode_decode(docs, lexicon_words=300).collect()), key=str) == sorted(want, key=str)
    assert encode_decode(none).count() == 0
    merger = Merger(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x" * 3000, "a   b \n\n  c  ", "\x1c \x85y", " \n", "ab" * 400 + " 'll"):
        assert merger.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_main_text(spark, sf):
    rows = [
        (1, "u", None),
        (2, "u", ""),
        (3, "u", "just plain words"),
        (4, "u", "<nav><a>Menu</a></nav><article><h1>A&amp;B</h1><p>One  two\nthree <b>four</b></p>"
                 "<div class='ad'>buy this now</div><p>Last part here.</p></article>"
                 "<section class=comments><p>I like this very much indeed</p></section><footer>foot</footer>"),
        (4, "u", "<main><p>a b c d e<script>if (a<b) x()</script><p>f &lt;g&gt;</main>"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in main_text(df).collect()}
    assert got == {
        (1, "", 0), (2, "", 0), (3, "just plain words", 16),
        (4, "A&B\nOne two three four\nLast part here.", 38), (4, "a b c d e\nf <g>", 15),
    }
    weights = fit_weights(labelled_pages())
    for r in table(spark, sf, "pages").collect():
        text = extract(r["html"], weights)
        assert text and "<" not in text and "©" not in text and "track(" not in text


def test_main_text_beside_unseen_and_wrapping_elements():
    weights = fit_weights(labelled_pages())
    article = "<article><h1>Title here</h1>{}<p>First part of it.</p></article>"
    for unseen in (
        '<svg class="i"/>', "<math/>", "<svg-icon></svg-icon>", "<select-box></select-box>", "<button-x/>",
        "<p>a <button>Share</p>", "<div><select><option>No<option>Neither</div>", "<p><svg><g></p>",
        "<textarea><div></p></article></textarea>", "<iframe></div></article></iframe>",
        "<svg><title>No</title><style>p</style></svg>", "<p><textarea>open</p>", "<script>'</p>'</script >",
    ):
        got = extract(article.format(unseen), weights).replace("\na\n", "\n")
        assert got == "Title here\nFirst part of it.", unseen
    rest = "<nav><a>Menu</a></nav><div class=sidebar>Side <b>words</b></div>"
    many = "<p>" + "word " * 30 + "</p>"
    for before, after in (
        ('<html><body class="no-sidebar">', "</body></html>"),
        ('<html class="hidden js"><body class="page post content">', "</body></html>"),
        ("<form id=search>", "</form>"),
        ('<div class="layout sidebar-left header-top">', "</div>"),
    ):
        for inner in ("<article>" + many + "</article>", "<div>" + many + "</div>"):
            page = before + rest + inner + "<footer>Foot</footer>" + after
            assert extract(page, weights) == ("word " * 30).strip(), page
    comments = "<section class=comments>" + "<p>I like this very much indeed</p>" * 50 + "</section>"
    assert extract("<body><article>" + many + "</article>" + comments, weights) == ("word " * 30).strip()
    assert extract("<nav><a>Menu</a></nav><footer>Foot</footer>", weights) == ""


def test_quality(spark, sf, odd, none):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = fit_quality(docs, labels)
    got = score_quality(docs, chain).join(labels, "doc_id")
    held = got.where("held_out")
    assert held.where("quality = predicted").count() >= 0.9 * held.count() > 0
    ids = {r["doc_id"] for r in held.collect()}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)
    scores = score_quality(odd, chain).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert score_quality(none, chain).count() == 0
    empty = fit_quality(none, labels)
    assert {r["score"] for r in score_quality(odd, empty).collect()} == {0.5}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    total, single = 0.0, np.zeros((5, 2))
    for n in range(32):
        path = [n >> i & 1 for i in range(5)]
        weight = np.exp(
            sum(emit[i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        )
        total += weight
        for i, s in enumerate(path):
            single[i, s] += weight
    got, _, log_z = marginals(emit, move)
    assert np.allclose(got, single / total) and np.isclose(log_z, np.log(total))
    flat = Chain(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)))
    assert flat.score("a\nb") == pytest.approx(0.5)


def exact_neighbours(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            scored = [(-float(np.dot(v, w)), i) for i, w in rows if i != q]
            out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    want = exact_neighbours(rows, lambda q: q % 20 == 0, 20)
    got = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(dict(rows)[r["query_id"]], dict(rows)[r["vec_id"]])))
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_do_not_depend_on_the_chunk(spark, monkeypatch):
    """What a query meets must not change where a table outgrows its buckets."""
    rng, results = np.random.default_rng(8), []
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for chunk in (1_000, 4):
        monkeypatch.setattr(cross_polytope, "CHUNK", chunk)
        monkeypatch.setattr(cross_polytope, "QUERIES", chunk)
        found = nearest(df, F.col("vec_id") % 5 == 0, k=3, tables=2, probes=1)
        results.append(sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()))
    assert results[0] == results[1]


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, float(i), 2.0]) for i in range(5)]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [nan, 1.0, 1.0]), (203, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (204, []), (205, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = exact_neighbours([(i, np.array(v)) for i, v in rows], lambda q: q % 20 == 0, 5)
    assert got == want
    few = df.where("vec_id IN (0, 1, 101)")
    assert nearest(few, F.lit(True), k=5).count() == 6
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_need_few_copies_on_disk(spark, monkeypatch):
    """Copies of the vectors for 16 tables and 224 probes, all at once, outgrew the disk."""
    monkeypatch.setattr(cross_polytope, "MOVED", 0, raising=False)
    rng, most, over = np.random.default_rng(3), [0], threading.Event()
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").localCheckpoint()
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def on_disk():
        files = [f for d in dirs for f in Path(d).glob("*/shuffle_*")]
        return sum(os.stat(f).st_size for f in files if os.path.exists(f))

    def watch():
        while not over.wait(0.01):
            with contextlib.suppress(OSError):
                most[0] = max(most[0], on_disk())

    before = on_disk()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert nearest(df, F.col("vec_id") % 20 == 0, tables=8).count() == 2_000
    finally:
        over.set()
        watcher.join()
    assert 0 < most[0] - before < 6 * 2_000 * 256


def test_neighbours_from_cells_and_several_passes(spark, monkeypatch):
    """Buckets cut into cells, and tables taken a few at a time, lose no neighbours."""
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(120, 24))
    rows = [(f"n{i:05d}", (heart[i % 120] + 0.4 * rng.normal(size=24))) for i in range(3_000)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id string, embedding array<double>")
    results = []
    for whole, moved in ((10**6, 1 << 40), (10**6, 0), (16, 0)):
        monkeypatch.setattr(cross_polytope, "WHOLE", whole)
        monkeypatch.setattr(cross_polytope, "MOVED", moved)
        monkeypatch.setattr(cross_polytope, "MOVED_X", 0)
        found = nearest(df, F.col("vec_id").endswith("00"), k=10, tables=6).collect()
        results.append({(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found})
    assert results[0] == results[1]
    want = exact_neighbours(rows, lambda q: q.endswith("00"), 10)
    assert len(results[2]) == 10 * len(want)
    assert np.mean([i in want[q] for q, _, i, _ in results[2]]) >= 0.97


def meeting(x, q, bounds, k=5):
    """Pairs found where ``x`` is one bucket of ``cross_polytope`` that all of ``q`` probe, cut into cells."""
    search = cross_polytope._Search(x.shape[1], np.dtype("f8"), float(np.linalg.norm(x, axis=1).max()), k, 1, 1)
    search.whole = 10
    cell = search.cells.axes(cross_polytope.on_sphere(x, search.radius), 0, 1)[:, 0].astype(search.code)
    ends, asked = np.array([0, len(x)]), np.array([0, len(q)])
    heads = {"key": pa.array([0]), "n": pa.array([len(x)])}
    ids = pa.array(np.arange(len(x))[::-1])
    there = {"ids": cross_polytope._lists(ids, ends), "x": cross_polytope._bytes(x, ends), "cell": cross_polytope._bytes(cell, ends)}
    here = {
        "ids": cross_polytope._lists(pa.array(np.arange(len(q))), asked),
        "x": cross_polytope._bytes(q, asked), "bound": cross_polytope._bytes(bounds, asked),
    }
    found = cross_polytope._Meet(search, True)(pa.table(heads | there), pa.table(heads | here))
    out = defaultdict(list)
    for r in found.to_pylist():
        out[r["q"]].append((-r["score"], r["id"]))
    return {a: [i for _, i in sorted(b)] for a, b in out.items()}


def test_a_bucket_in_cells_without_bounds_and_with_ties():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(500, 16)), rng.integers(-1, 2, (500, 4)).astype(float)):
        x = x[(x != 0).any(axis=1)]
        q = x[::25].copy()
        want = {}
        for i, v in enumerate(q):
            score = sum(v[j] * x[:, j] for j in range(x.shape[1]))
            ids = np.arange(len(x))[::-1]
            want[i] = list(ids[np.lexsort((ids, -score))][:6])
        assert meeting(x, q, np.full(len(q), -np.inf)) == want


def test_cells_that_hold_no_neighbour_are_skipped():
    """A bound near the best leaves out most cells, and keeps the neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:200] + 0.05 * rng.normal(size=(200, 32))
    q /= np.linalg.norm(q, axis=1)[:, None]
    found = meeting(x, q, np.full(200, 0.9), k=0)
    right = sum(found.get(i) == [3_999 - i] for i in range(200))
    assert right >= 90 and all(len(v) == 1 for v in found.values())  # one table alone finds half at least


def test_licenses_odd_rows(spark, odd, none):
    body = "a b c " * 40
    rows = [
        (1, body + "Released under the MIT License." + body),
        (2, "released UNDER the\nmit-license"),
        (3, "Released under the BSD License."),
        (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."),
        (4, "Released under the MIT License"),
        (5, None),
        (6, "MIT"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("words", F.lit(1))
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(df).collect()}
    assert got == {(1, "mit"), (2, "mit"), (4, "cc-by-nc-4.0"), (4, "cc-by-4.0"), (4, "mit")}
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0


def test_licenses_interrupted_anywhere(spark):
    header = TEMPLATES["apache-2.0-header"].split()
    rows, want = [], {}
    for n in (1, 17, 40, 400):
        for at in (10, 20, 30):
            filler = [f"x{i}" for i in range(n)]
            rows.append((len(rows), " ".join(filler + header[:at] + filler + header[at:] + filler)))
            want[rows[-1][0]] = (31, 35)
    text = TEMPLATES["mit"]
    rows += [(1000 + n, "x " * (n % 40) + f"y{n} z{n} {text} u{n} v{n}") for n in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = scan_licenses(df).collect()
    assert {r["doc_id"]: (r["shared"], r["shingles"]) for r in got if r["license"] == "apache-2.0-header"} == want
    assert sum(r["license"] == "mit" for r in got) == 20_000
    assert scan_licenses(df.where("doc_id < 0"), {}).count() == 0


def test_licenses_bands_meet_damaged_notices(spark):
    """Full texts from a table, with words put in, changed and left out: no notice is missed."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(400)]
    bodies = {f"long{i}": rng.choices(vocabulary, k=n) for i, n in enumerate([12, 13, 20, 60, 300, 2_000])}
    templates = spark.createDataFrame([(k, " ".join(v)) for k, v in bodies.items()], "license string, body string")

    def runs(ws):
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    rows, want = [], set()
    for n in range(1_500):
        name = rng.choice(sorted(bodies))
        ws = [w for w in bodies[name]]
        for _ in range(rng.randint(0, max(1, len(ws) // 16))):
            at = rng.randrange(len(ws))
            ws[at : at + rng.randint(0, 1)] = [f"x{rng.random()}"] * rng.randint(0, 2)
        text = [f"y{n}"] * rng.randint(0, 9) + ws + [f"z{n}"] * rng.randint(0, 9)
        rows.append((n, " ".join(text).replace(".", "d")))
        held = runs(rows[-1][1].split())
        for k, v in bodies.items():
            shared, whole = len(runs(v) & held), len(runs(v))
            if shared * 100 >= 75 * whole:
                want.add((n, k, shared, whole))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = scan_licenses(df, templates).collect()
    assert {(r["doc_id"], r["license"], r["shared"], r["shingles"]) for r in got} == want
    assert len(want) > 700


def test_licenses_shingles_that_stand_apart(spark):
    """Six of eight shingles, each by itself, in any order: found more often than the docstring's bound."""
    body = [f"t{i}" for i in range(12)]
    rng, rows = random.Random(5), []
    for n in range(2_000):
        some = rng.sample(range(8), 6)
        rows.append((n, " ".join(f"x{n} " + " ".join(body[i : i + 5]) + f" y{n}" for i in some)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert scan_licenses(df, {"a": " ".join(body)}).count() > 0.97 * len(rows)


def test_backoff_by_hand(spark, none):
    rows = [(1, "a b a b"), (2, "A b c"), (3, None), (4, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1))
    for frequent in (1, 512):  # pairs counted after the shuffle, and before it
        got = {r["doc_id"]: r for r in backoff_scores(df, frequent=frequent).collect()}
        a, b, c = 3, 3, 2
        ab = np.log(3 / a)
        want = np.log(a / 8) + 2 * ab + np.log(0.4 * a / 8)
        assert got[1]["log_score"] == pytest.approx(want)
        assert got[2]["log_score"] == pytest.approx(np.log(a / 8) + ab + np.log(0.4 * c / 8))
        assert got[4]["mean_log_score"] == pytest.approx(np.log(c / 8)) and got[3]["n_words"] == 0
        assert got[3]["mean_log_score"] is None
    small = {r["doc_id"]: r["n_unknown"] for r in backoff_scores(df, vocabulary=1).collect()}
    assert small == {1: 2, 2: 2, 3: 0, 4: 1}
    assert backoff_scores(none).count() == 0


def brute_scores(rows, order, min_count=2, alpha=0.4):
    grams, out, total = defaultdict(int), {}, 0
    split = {i: words(t or "") for i, t in rows}
    for ws in split.values():
        total += len(ws)
        for k in range(1, order + 1):
            for i in range(len(ws) - k + 1):
                grams[tuple(ws[i : i + k])] += 1
    for doc, ws in split.items():
        score = 0.0
        for i in range(len(ws)):
            k = min(order, i + 1)
            while k > 1 and grams[tuple(ws[i + 1 - k : i + 1])] < min_count:
                k, score = k - 1, score + np.log(alpha)
            gram = tuple(ws[i + 1 - k : i + 1])
            score += np.log(grams[gram] / (grams[gram[:-1]] if k > 1 else total))
        out[doc] = (len(ws), 0, pytest.approx(score))
    return out


def test_backoff_over_all_words_and_orders(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 5 = 0")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for order in (1, 2, 3):  # a few words numbered, the others met by hash
        got = backoff_scores(docs, order=order, numbered=20, frequent=10).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_unknown"], r["log_score"]) for r in got}
        assert got == brute_scores(rows, order)


def test_backoff_has_no_word_limit(spark):
    docs = spark.range(1000).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(0, 69), i -> concat('w', id * 70 + i))) AS text"
    )
    got = backoff_scores(docs).agg(F.sum("n_unknown"), F.min("log_score")).first()
    assert got[0] == 0
    assert got[1] == pytest.approx(np.log(1 / 70_000) * 70 + np.log(0.4) * 69)


def shuffled_rows(df):
    """Rows that the exchanges of a plan that ran have written."""
    def inside(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from inside(node.executedPlan())
        elif name.endswith("QueryStage"):
            yield from inside(node.plan())
        else:
            if name == "Exchange":
                yield node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            for i in range(children.size()):
                yield from inside(children.apply(i))

    return sum(inside(df._jdf.queryExecution().executedPlan()))


def test_backoff_moves_pairs_packed_and_once(spark):
    """Pairs used to be a row each, shuffled to their count and again to their rarer words."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(2_000))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(4)
    scores = backoff_scores(df, frequent=10, numbered=1_000)
    got = {r["doc_id"]: (r["n_words"], r["n_unknown"], r["log_score"]) for r in scores.collect()}
    assert got == brute_scores(rows, 2)
    assert 0 < shuffled_rows(scores) < 100_000  # of 400,000 pairs


def test_backoff_on_odd_rows(spark, monkeypatch):
    strange = "\x1cA\x0bb\x0cC\x1fd\xa0e \tÉf\x85g \u2003h\x00i a\r\nB"
    rows = [r[:2] for r in ODD] + [(None, strange), (-(2**63), strange), (2**63 - 1, "a b"), (0, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    monkeypatch.setattr("tsprep.llm.backoff_lm.TEXT_BYTES", 100)
    for part in (df.where("coalesce(doc_id, 0) < pow(2, 62)"), df.where("coalesce(doc_id, 0) > -pow(2, 62)")):
        kept = [tuple(r) for r in part.collect()]
        for order, numbered in ((1, 5), (2, 0), (2, 5), (2, 5_000)):
            by_row = brute_scores([(n, text) for n, (_, text) in enumerate(kept)], order)
            want = defaultdict(lambda: [0, 0.0])
            for n, (doc, _) in enumerate(kept):
                want[doc][0] += by_row[n][0]
                want[doc][1] += by_row[n][2].expected
            got = backoff_scores(part, order=order, numbered=numbered).collect()
            assert {r["doc_id"]: r["n_words"] for r in got} == {doc: n for doc, (n, _) in want.items()}
            assert len(got) == len(want)
            for r in got:
                assert r["log_score"] == pytest.approx(want[r["doc_id"]][1])


def test_pipeline_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    good = corpus_pipeline.quality(spark, docs, sf)
    chain = fit_quality(docs, table(spark, sf, "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stay = {i: t for i, t in texts.items() if chain.score(t) >= 0.7}
    assert {r["doc_id"] for r in good.collect()} == set(stay) and good.columns == docs.columns
    last = {t: i for i, t in sorted(stay.items())}
    groups = brute_groups([(i, t) for t, i in last.items()])
    want = {i: texts[i] for i, (_, root) in groups.items() if i == root}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(want)
    check_packing(out, want, 4096)


def test_pipeline_of_odd_rows(spark, sf, odd):
    odd = odd.selectExpr("doc_id", "text", "kept AS lang", "kept AS source", "score AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before, odd = odd.columns, stage(spark, odd, sf)
        assert odd.count() > 0
        assert name == "packing" or odd.columns == before


def test_merging_and_memo():
    merger = Merger(public_tokenizers.path("byte_bpe_50k.json"))
    for word in (" walking", "x" * 300, " schüä", "漢字", "=-=-=-" * 30, " ", "\U0001f600a"):
        assert merger.merge(word) == merger._pairwise(word.encode())
    made = []
    memo = Memo(lambda key: made.append(key) or key * 2, 4)
    assert [memo[k] for k in (1, 2, 3, 1, 4, 5, 6, 1, 3)] == [2, 4, 6, 2, 8, 10, 12, 2, 6]
    assert made.count(2) == 1 and len(memo) + len(memo.older) <= 4
