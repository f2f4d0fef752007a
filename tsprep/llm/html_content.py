"""Main text of web pages as the contiguous region with the largest score.

A page is a row of words and tags. Words score by the elements they stand in, tags cost something;
both weights are log-odds counted on labelled pages. One pass finds the run of words and tags
with the largest sum. In it, words of elements that speak against content are left out.

Pages whose elements have no telling names are judged by their text as well: length, links,
sentences, headings and copyright marks of each block, with log-odds counted over the blocks of all
pages whose names do tell.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprep.llm.common import column, whole_text

# Names and kinds of HTML elements.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
# They mark words of a sentence, so their names and classes say nothing about a part of the page.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strong sub sup time tt u var".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# A class such as "no-sidebar" or "comments-open" tells a state of the page, not what an element is.
STATE_FIRST = frozenset("no non not has with without hide show".split())
STATE_LAST = frozenset("open opened closed enabled disabled allowed on off".split())
# What is in them is not shown; without an end of their own they end with what they stand in.
UNSEEN = frozenset(
    "script style noscript template svg math iframe object select textarea button".split()
)
# Of these, where tags are text up to the end tag.
ONLY_TEXT = ("iframe", "textarea")

#: Weight from which a name marks content clearly.
STRONG = 1.2
#: Log-odds, of a clear trait or of its elements, at or below which a block inside the best region is left
#: out on pages without telling names.
CHROME = -1.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
    r".*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_END = re.compile(rf"</({'|'.join(ONLY_TEXT)})(?=[\s/>])", re.I)
_PART = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![^\s\"'])hidden(?![^\s=/])", re.I)
_STYLE = re.compile(r"\bstyle\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u2019)]*(?=\s|$)|[\u3002\uff01\uff1f]")
_RIGHTS = re.compile(r"\u00a9|\(c\)\s*\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)
_MARK = re.compile(r"\bdata-main\s*=\s*[\"']?([01])", re.I)


@dataclass
class Weights:
    """Log-odds of content: of a word anywhere, by element or name around it, by tag, by trait of a block."""

    base: float
    around: dict[str, float]
    tag: dict[str, float]
    other_tag: float
    trait: dict[str, float] = field(default_factory=dict)


class _Element:
    __slots__ = (
        "name", "above", "own", "label", "unseen", "linked", "headed", "counted", "score", "good", "words", "near",
        "title",
    )

    def __init__(self, name: str, above: _Element | None, own: list[str], label: int | None, hidden: bool = False):
        self.name, self.above, self.own, self.label = name, above, own, label
        self.unseen = above is not None and (above.unseen or hidden or name in UNSEEN)
        self.linked = above is not None and (above.linked or name == "a")
        self.headed = above is not None and (above.headed or name in HEADING)
        self.words, self.title = 0, name == "h1"

    def keys(self) -> set[str]:
        """All that is told about this element and those around it."""
        out, e = set(), self
        while e is not None:
            out.update(e.own)
            e = e.above
        return out


def is_hidden(name: str, rest: str) -> bool:
    """Whether the element's own attributes say that it is not shown; whole pages always are."""
    if name in ("html", "body"):
        return False
    low = rest.lower()
    if "hidden" in low and _HIDDEN.search(_QUOTED.sub('""', rest)):
        return True
    return "display" in low and any(_NO_DISPLAY.search("".join(x)) for x in _STYLE.findall(rest))


def keys_of(name: str, rest: str) -> list[str]:
    """The element's name if it makes a block, and the words in its class, id and role.

    Inline elements have none, and names that tell a state are left out.
    """
    if name in INLINE:
        return []
    keys = ["<" + name] if name in BLOCK else []
    for found in _NAMES.findall(rest):
        for word in "".join(found).lower().split():
            parts = _PART.findall(word)
            state = len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)
            keys += [] if state else parts
    return list(dict.fromkeys(keys))


def walk(page: str, made: list[_Element], labelled: bool = False) -> Iterator[tuple[str, str, _Element]]:
    """``("text", text, element)`` and ``("tag", name, element)`` in page order; ``made`` gets the elements."""
    root = _Element("", None, [], None)
    made.append(root)
    open_: list[_Element] = [root]
    places: dict[str, list[int]] = {}  # of open elements in ``open_``, by name
    blocks: list[int] = []  # the same of those that make a block

    def close(at: int) -> None:
        while len(open_) > at:
            gone = open_.pop().name
            places[gone].pop()
            if gone in BLOCK:
                blocks.pop()

    last_end = {m[1].lower(): m.start() for m in _END.finditer(page)}
    for token in _TOKEN.finditer(page):
        text, name = token["text"], token["name"]
        above = open_[-1]
        if text is not None:
            if not above.unseen:
                yield "text", text, above
        elif name is not None:
            name = name.lower()
            if above.name in last_end and token.start() <= last_end[above.name]:
                if not (token["close"] and name == above.name):
                    continue
            if token["close"]:
                at = places[name][-1] if places.get(name) else 0
                if not above.unseen or at and not open_[at].unseen:
                    yield "tag", name, above
                if at:
                    close(at)
                continue
            if name in BLOCK and name != "br" and blocks and open_[blocks[-1]].name == "p":
                # a paragraph, and what is open in it, ends where the next block starts
                p = open_[blocks[-1]]
                if not above.unseen or p.unseen and not p.above.unseen:
                    close(blocks[-1])
            above = open_[-1]
            rest = token["rest"]
            hidden = is_hidden(name, rest)
            if not above.unseen and name not in UNSEEN and not hidden:
                yield "tag", name, above
            if name in VOID or rest.endswith("/"):
                continue
            mark = _MARK.search(rest) if labelled else None
            label = int(mark[1]) if mark else above.label
            places.setdefault(name, []).append(len(open_))
            if name in BLOCK:
                blocks.append(len(open_))
            open_.append(_Element(name, above, keys_of(name, rest), label, hidden))
            made.append(open_[-1])


def _score(made: list[_Element], weights: Weights) -> None:
    """Sets the score of every element, whose ``words`` are those right in it.

    A name of ``html`` or ``body`` says nothing about a part of the page. What speaks against an
    element does not count if it holds most of the words and most of those that something in the
    page marks as content: then it is around the content and the rest alike. Nor does a header count that stands
    inside of content and holds a first heading: it is the article's own.
    """
    around = weights.around
    root = made[0]
    for least in (STRONG, 1.0):  # without a clear mark of content, paragraphs are it
        for e in made:
            e.near = e.above is not None and (e.above.near or any(around.get(k, 0.0) >= least for k in e.own))
            e.good = e.words if e.near else 0
        for e in reversed(made[1:]):
            e.above.good += e.good
        if root.good:
            break
    for e in reversed(made[1:]):
        e.above.words += e.words
        e.above.title |= e.title
    root.score, root.counted = weights.base, ()
    counts: Counter[str] = Counter()  # what is counted on the way from the root to the element
    way = [root]
    for e in made[1:]:
        while way[-1] is not e.above:
            counts.subtract(way.pop().counted)
        own = e.own
        if e.name in ("html", "body"):
            own = [k for k in own if k[0] == "<"]
        elif 2 * e.words > root.words and 2 * e.good > root.good:
            own = [k for k in own if around.get(k, 0.0) > -1.0]
        if e.title and e.above.near and "header" in {k.lstrip("<") for k in own}:
            own = [k for k in own if around.get(k, 0.0) > 0]
        e.counted = [k for k in own if not counts[k]]
        counts.update(e.counted)
        way.append(e)
        e.score = e.above.score + sum(around.get(k, 0.0) for k in e.counted)


def telling(made: Sequence[_Element], weights: Weights) -> bool:
    """Whether some name marks content clearly."""
    return any(weights.around.get(k, 0.0) >= STRONG for e in made for k in e.own)


def traits(parts: Sequence[tuple[str, _Element]]) -> list[str]:
    """What a block's text is like, whatever its elements are called; empty without words."""
    text = html.unescape("".join(value for value, _ in parts))
    n = len(text.split())
    if not n:
        return []
    linked = sum(len(value.split()) for value, e in parts if e.linked)
    return [
        f"words {next((x for x in (2, 7, 19) if n <= x), 20)}",
        f"linked {0 if not linked else 1 if 2 * linked < n else 2}",
        f"sentences {min(2, len(_SENTENCE.findall(text)))}",
        f"rights {int(n < 20 and bool(_RIGHTS.search(text)))}",
        f"heading {int(any(e.headed for _, e in parts))}",
    ]


def text_blocks(found: Iterable[tuple[str, str, _Element]]) -> Iterator[list[tuple[str, _Element]]]:
    """Texts with their elements, block by block; one list after every block tag and at the end."""
    parts: list[tuple[str, _Element]] = []
    for kind, value, element in found:
        if kind == "text":
            parts.append((value, element))
        elif value in BLOCK:
            yield parts
            parts = []
    yield parts


def count_traits(page: str, weights: Weights) -> Counter[tuple[str, int]]:
    """(trait, 1 or 0): blocks that their elements' names put in content, or outside of it.

    Pages without telling names have none; ``all`` counts the blocks themselves.
    """
    made: list[_Element] = []
    found = list(walk(page, made))
    out: Counter[tuple[str, int]] = Counter()
    if not telling(made, weights):
        return out
    for kind, value, element in found:
        if kind == "text":
            element.words += len(value.split())
    _score(made, weights)
    for parts in text_blocks(found):
        good = parts and parts[0][1].score
        if parts and (good >= STRONG or good <= 0):
            for trait in (own := traits(parts)):
                out[trait, int(good > 0)] += 1
            out["all", int(good > 0)] += bool(own)
    return out


def trait_odds(counts: Counter[tuple[str, int]]) -> dict[str, float]:
    good, bad = counts["all", 1], counts["all", 0]
    return {
        t: log((counts[t, 1] + 1) / (good + 2)) - log((counts[t, 0] + 1) / (bad + 2))
        for t in {t for t, _ in counts} - {"all"}
    }


def fit_weights(pages: Iterable[str]) -> Weights:
    """Count words and tags in and outside of content on pages with ``data-main="0"`` or ``"1"``."""
    words, around, tags = Counter(), {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for page in pages:
        for kind, value, element in walk(page, [], labelled=True):
            label = element.label or 0
            if kind == "tag":
                tags[label][value] += 1
            elif n := len(value.split()):
                words[label] += n
                for key in element.keys():
                    around[label][key] += n

    def odds(good: int, bad: int, all_good: int, all_bad: int, prior: float) -> float:
        return log((good + prior) / (all_good + 2 * prior)) - log((bad + prior) / (all_bad + 2 * prior))

    n1, n0 = words[1], words[0]
    by_key = {
        k: odds(around[1][k], around[0][k], n1, n0, 1.0) for k in {*around[0], *around[1]}
    }
    t1, t0 = sum(tags[1].values()), sum(tags[0].values())
    cost = {
        t: min(-0.1, odds(tags[1][t], tags[0][t], t1, t0, 4.0) / 4 - 0.2) for t in {*tags[0], *tags[1]}
    }
    return Weights(0.5, by_key, cost, -0.3)


def block_odds(own: Sequence[str], weights: Weights) -> tuple[float, bool]:
    """Log-odds of a block with these traits, and whether it is surroundings wherever it stands.

    Mostly links, or a short line about rights, outweigh everything else.
    """
    total = sum(weights.trait.get(t, 0.0) for t in own)
    clear = min((weights.trait.get(t, 0.0) for t in own if t in ("linked 2", "rights 1")), default=0.0)
    return (min(total, clear), True) if clear <= CHROME else (total, False)


def best_run(values: Iterable[float]) -> tuple[int, int]:
    """Start and end of the run with the largest sum, if that is above 0; else an empty one."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The main text: blocks of the best region, joined by line ends."""
    made: list[_Element] = []
    found = list(walk(page, made))
    for kind, value, element in found:
        if kind == "text":
            element.words += len(value.split())
    _score(made, weights)
    silent = bool(weights.trait) and not telling(made, weights)
    judged = [block_odds(traits(parts), weights) for parts in text_blocks(found)] if silent else []
    values, shown, block = [], [], 0
    for kind, value, element in found:
        if kind == "text":
            odds, outside = judged[block] if silent else (0.0, False)
            weight = min(1.0, element.score + odds)
            n = len(value.split())
            shown.append(element.score > CHROME and not outside if silent else weight > 0)
            # words against content are left out below, so crossing them costs little
            values.append(n * weight if weight > 0 else -(0.2 if silent else 0.02) * n)
        else:
            shown.append(False)
            values.append(weights.tag.get(value, weights.other_tag))
            block += value in BLOCK
    start, end = best_run(values)
    blocks, words = [], []
    for (kind, value, _), keep in zip(found[start:end], shown[start:end]):
        if kind == "text":
            if keep:
                words.append(value)
        elif value in BLOCK:
            blocks.append("".join(words))
            words = []
    blocks.append("".join(words))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def labelled_pages() -> list[str]:
    """Pages made for training: every kind of surroundings next to every kind of content."""
    outside = (
        "nav; nav.menu.main-menu; ul.nav.navbar; div.menu; div#menu.navigation; div.breadcrumb; header; "
        "header.site-header; div.header; div#header.top; div.topbar; div.masthead; footer; footer.site-footer; "
        "div.footer; div#footer; div.copyright; aside; aside.sidebar; div.sidebar; div#sidebar; "
        "div.widget; div.related; div.recommended; div.ad; div.ads; div.advert; div.advertisement; "
        "section.ad; div.banner; div.sponsored; div.sponsor; div.promo; div.cookie; "
        "div.cookie-notice; div.notice; div.consent; div.gdpr; div.popup; div.modal; div.alert; "
        "div.newsletter; div.subscribe; div.signup; form; form.search; div.search; div.login; "
        "div.share; div.social; div.comments; section.comments; div#comments; ol.comment-list; "
        "li.comment; div.comment; div.reply; div.replies; div.disqus; div.discussion; "
        "article.comment; section#comments.comments; div.tags; div.pagination; div.pager; "
        "div.toolbar; div.skip; div.hidden; dialog; title; label; section.related; section.newsletter"
    )
    inside = (
        "article; article.post; main; main.content; div.content; div#content; div.article; "
        "div.article-body; div.post; div.entry; div.entry-content; div.story; div.text; div.body; "
        "section.article; section.story; div#main.main; article.story; div.page; div.post-content"
    )
    filler = "word " * 12

    def shell(spec: str, mark: int, inner: str) -> str:
        name = re.match(r"\w+", spec)[0]
        ident = "".join(re.findall(r"#([\w-]+)", spec))
        classes = " ".join(re.findall(r"\.([\w-]+)", spec))
        at = (f' id="{ident}"' if ident else "") + (f' class="{classes}"' if classes else "")
        return f'<{name}{at} data-main="{mark}">{inner}</{name}>'

    links = f"<h1>{filler}</h1><ul><li><a href=x>{filler}</a></li><li><a href=y>{filler}</a></li></ul><p>{filler}</p>"
    plain = f"<h2>{filler}</h2><p>{filler}</p><div>{filler}<b>{filler}</b><a href=x>{filler}</a></div><h3>{filler}</h3>"
    text = (
        f"<h1>{filler}</h1><p>{filler * 4}<a href=x>{filler}</a></p><h2>{filler}</h2>"
        f"<p><b>{filler}</b>{filler * 2}<br>{filler}</p><ul><li>{filler * 2}</li></ul>"
        f"<blockquote>{filler}</blockquote><pre>{filler}</pre><table><tr><td>{filler}</td></tr></table>"
    )
    shells = [s.strip() for s in outside.split(";")]
    pages = []
    for spec in (s.strip() for s in inside.split(";")):
        body = "".join(
            shell(s, 0, links if i % 2 else plain) for i, s in enumerate(shells)
        )
        within = shell(spec, 1, text + shell(shells[len(pages) % len(shells)], 0, plain) + text)
        pages.append(f"<html><head><title data-main=0>{filler}</title></head><body>{within}{body}</body></html>")
    return pages


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    labelled: Iterable[str] | None = None,
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``; a NULL or empty page has the empty text.

    ``labelled`` are pages whose elements carry ``data-main="1"`` (content) or ``"0"``; without
    them the weights of names come from ``labelled_pages``. Those of the blocks' traits are counted
    over all ``pages`` whose names tell what is content. Repeated pages give repeated rows. Very long
    pages and any depth of nesting take time in proportion to their length.
    """
    weights = fit_weights(labelled_pages() if labelled is None else labelled)
    weights.trait = corpus_traits(pages.select(whole_text(html_col).alias("html")), weights)

    def run(html_: pd.Series) -> pd.Series:
        return pd.Series([extract(page, weights) for page in html_], dtype=object)

    text = F.pandas_udf(run, "string")(whole_text(html_col))
    out = pages.select(
        column(id_col).alias("page_id"), column(url_col).alias("url"), text.alias("text")
    )
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def corpus_traits(pages: DataFrame, weights: Weights) -> dict[str, float]:
    """Log-odds of the traits over all rows of ``html``; each task sends at most 28 counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for page in batch["html"]:
                counts.update(count_traits(page, weights))
        yield pd.DataFrame([(t, k, n) for (t, k), n in counts.items()], columns=["trait", "good", "n"])

    sums = pages.mapInPandas(run, "trait string, good int, n bigint").groupBy("trait", "good")
    rows = sums.agg(F.sum("n").alias("n")).collect()
    return trait_odds(Counter({(r["trait"], r["good"]): r["n"] for r in rows}))
