"""Main text: names, states, hidden parts, pages without telling names, deep nesting, the best run."""

import random
import time
from collections import Counter

import pytest

from tsprep.llm.html_content import (
    best_run,
    count_traits,
    extract,
    fit_weights,
    labelled_pages,
    main_text,
    trait_odds,
)

WORDS = ("word " * 30).strip()
SAID = "Here is a sentence of some words. And there is another one, with more to say about it."
SIDE = '<div class="sidebar"><p>' + "side words " * 60 + "</p></div>"


def named(i: int) -> str:
    """A page whose names tell what is content."""
    links = "".join(f"<li><a href=x>link {i}</a></li>" for _ in range(4))
    return (
        f"<body><nav><ul>{links}</ul></nav><article><h1>A heading of page {i}</h1><p>{SAID * 2}</p>"
        f"<p>{SAID}</p></article><div class=ad>Buy now</div><footer>&copy; some company {i}</footer></body>"
    )


@pytest.fixture(scope="module")
def weights():
    out = fit_weights(labelled_pages())
    counts = Counter()
    for i in range(20):
        counts.update(count_traits(named(i), out))
    out.trait = trait_odds(counts)
    return out


def test_states_of_a_page_are_no_kinds(weights):
    page = f'<body><div class="post comments-open"><h1>Own title</h1><p>{WORDS}</p></div>{SIDE}</body>'
    assert extract(page, weights) == "Own title\n" + WORDS
    page = f'<body class="no-sidebar"><article><p>{WORDS}</p></article>{SIDE}</body>'
    assert extract(page, weights) == WORDS


def test_names_of_inline_elements_do_not_decide(weights):
    page = '<article><p>He said <span class="label">hello</span> and <em class="alert">stop</em> there</p></article>'
    assert extract(page, weights) == "He said hello and stop there"


@pytest.mark.parametrize("head", ["<header>{}</header>", '<div class="header-image">{}</div>'])
def test_the_title_in_an_own_header_stays(weights, head):
    head = head.format("<h1>Own title</h1>")
    page = f"<body><header><h1>Site</h1></header><article>{head}<p>{WORDS}</p></article></body>"
    assert extract(page, weights) == "Own title\n" + WORDS


@pytest.mark.parametrize(
    "hidden",
    [
        "<div hidden>gone</div>",
        '<div class="a" hidden="">gone</div>',
        '<p style="color: red; display: none">gone</p>',
        "<p hidden>gone",
        "<p hidden>gone <b>too",
    ],
)
def test_hidden_parts_go(weights, hidden):
    page = f"<article><p>{WORDS}</p>{hidden}<p>{WORDS}</p></article>"
    assert extract(page, weights) == f"{WORDS}\n{WORDS}"


@pytest.mark.parametrize("shown", ['<p data-state="hidden">seen</p>', '<p title="all hidden here">seen</p>'])
def test_shown_parts_stay(weights, shown):
    page = f"<article><p>{WORDS}</p>{shown}<p>{WORDS}</p></article>"
    assert extract(page, weights) == f"{WORDS}\nseen\n{WORDS}"
    page = f'<body style="display:none"><article><p>{WORDS}</p></article></body>'
    assert extract(page, weights) == WORDS


def test_without_telling_names_the_text_decides(weights):
    page = (
        '<body><div class="sc-a0"><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></div>'
        f'<div class="sc-a1"><h1>A title of its own</h1><p>{SAID * 3}</p><p>Short one</p><p>{SAID}</p></div>'
        '<div class="sc-b2"><p>&copy; 2024 A Company. All rights reserved.</p></div></body>'
    )
    assert extract(page, weights) == f"A title of its own\n{SAID * 3}\nShort one\n{SAID}"


def test_query_counts_traits_over_all_pages(spark):
    bare = f"<body><div><h1>A title of its own</h1><p>{SAID * 3}</p></div><div><p>&copy; 2024 A Company</p></div>"
    rows = [(i, "u", named(i)) for i in range(20)] + [(99, None, bare), (100, None, None), (101, "u", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got[99] == f"A title of its own\n{SAID * 3}"
    assert got[7] == f"A heading of page 7\n{SAID * 2}\n{SAID}"
    assert got[100] == got[101] == ""
    assert main_text(df.where("false")).collect() == []


def test_best_run_is_best_of_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        values = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        start, end = best_run(values)
        sums = [sum(values[a:b]) for a in range(len(values) + 1) for b in range(a, len(values) + 1)]
        assert sum(values[start:end]) == max(sums)
        assert start == end or sum(values[start:end]) > 0


@pytest.mark.parametrize("inner", ["<b>{}</i>", "<div class=c>{}</p>", "<b>{}<hr>x"])
def test_time_follows_length_however_deep(weights, inner):
    first, last = inner.split("{}")

    def seconds(n: int) -> float:
        page = f"<article><p>{WORDS}</p>" + first * n + last * n + "</article>"
        start = time.process_time()
        extract(page, weights)
        return time.process_time() - start

    seconds(1_000)
    assert seconds(80_000) < 30 * max(seconds(10_000), 0.02)
