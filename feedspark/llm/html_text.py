"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its ancestors' tags,
of the words in their class, id and role, and of its text; the field labels the blocks as main text or not and
Viterbi decoding picks the best sequence. It is trained by maximum likelihood on at most `pages` pages (those
with the smallest hash of their id, of at most `longest` characters and `most_blocks` blocks; larger ones are left out of training, none
is cut). No table has labels, so the labels are weak: pages with an article or main element are labelled by tag and class
names, and the texts of all sampled pages, and a few of our own, are set again in other page layouts with sidebars, notices,
forms, adverts and reader comments, whose labels are known. A table without such elements is learned from these layouts alone.

Scale: training is bounded by its parameters; extraction is a projection of whole pages without shuffle, and a page
takes time in proportion to its length.

Defined results: a null or empty html, and a page without main text, give an empty text; unclosed elements, cut
tags and cut references at a page's end are taken as they are; only raw-text elements (RAW) and closed templates hide their
content; very long and very deep pages are extracted whole; repeated rows get equal results; of different pages under one id the
first in order may be learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm import common as C

PAGES = 150
LONGEST = 200_000
MOST_BLOCKS = 400
#: Elements whose content is raw text and never text of the page; without a closing tag they run to the page's end.
RAW = "script style noscript iframe textarea title".split()
INLINE = set("a abbr audio b bdi bdo big button canvas cite code data del dfn em font i img ins kbd label mark math object q s samp select small span strike strong sub sup svg template time tt u var video wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Openings that end an svg or math element left open.
BREAKOUT = set("article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*+\"|'[^']*+'|[^'\">])*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_END = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*+(?:>|\Z)", re.I) for tag in [*RAW, "template"]}
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_LETTERS = re.compile(r"[a-z]+")
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    linked: int
    path: tuple[tuple[str, frozenset[str]], ...]  # distinct ancestors that are blocks or have names
    near: str  # the innermost of them
    depth: int


def _names(attributes: str) -> frozenset[str]:
    out = {w.rstrip("s") or w for m in _NAME.finditer(attributes) for w in _LETTERS.findall((m[1] or m[2] or m[3] or "").lower())} if "=" in attributes else set()
    if _HIDDEN.search(attributes):
        out.add("hidden")
    return frozenset(out)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Each tag knows its places on the stack, so that depth costs little."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    shown: list[tuple[str, frozenset[str]]] = []
    around: Counter = Counter()
    places: defaultdict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    linked, at = 0, 0
    templates = max((m.start() for m in _END["template"].finditer(page)), default=-1)

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, linked, tuple(around), shown[-1][0] if shown else "none", len(shown)))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not places["template"]:
            parts.append(text)
            linked += len(text) if places["a"] else 0

    def last(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=-1)

    def pop_to(names: set[str], barrier: frozenset[str]) -> None:
        to = last(names)
        if to < 0 or to < last(barrier) or to < last(("template",)):
            return
        while len(stack) > to:
            x = stack.pop()
            places[x[0]].pop()
            if x[0] not in INLINE or x[1]:
                shown.pop()
                around[x] -= 1
                if not around[x]:
                    del around[x]

    none, boxes, lists = frozenset(), frozenset(("table", "td", "th", "article", "section", "div", "body")), frozenset(("ul", "ol", "dl", "table", "nav", "menu"))
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BREAKOUT and not m[1]:
            pop_to({"svg"}, none)
            pop_to({"math"}, none)
        foreign = bool(places["svg"] or places["math"])
        closed = m[3].endswith("/") and (foreign or tag in ("svg", "math"))
        if tag in RAW and not m[1]:
            if not closed:
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        block = tag not in INLINE and not foreign and not places["template"]
        if block and parts:
            close()
        if m[1]:
            pop_to({tag}, none)
        elif tag not in VOID and not closed and (tag != "template" or at <= templates):
            if block:
                pop_to({"p"}, boxes)
            if tag in _CLOSED_BY:
                pop_to(_CLOSED_BY[tag], lists)
            x = (tag, _names(m[3]))
            places[tag].append(len(stack))
            stack.append(x)
            if tag not in INLINE or x[1]:
                shown.append(x)
                around[x] += 1
    add(page[at:])
    close()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        own = ["bias", "near:" + b.near, f"words:{min(words.bit_length(), 8)}", f"links:{min(4, b.linked * 5 // (len(b.text) + 1))}", "end:" + (b.text[-1] if not b.text[-1].isalnum() else "word")]
        own += {"in:" + t for t, _ in b.path} | {"name:" + w for _, ws in b.path for w in ws}
        if i == 0:
            own.append("first")
        if i == n - 1:
            own.append("last")
        if b.text[0] == "©" or "©" in b.text[:40]:
            own.append("copyright")
        if not b.text[0].isupper():
            own.append("lower")
        own.append(f"stops:{min(3, b.text.count('. ') + b.text.count(', '))}")
        own.append("depth:" + str(min(b.depth, 8)))
        out.append(own)
    return out


class ChainField:
    """A linear-chain field with two labels over sparse binary features."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.moves, self.start = index, weights, moves, start

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The labels of the best sequence (Viterbi)."""
        if not rows:
            return []
        index, w0, w1 = self.index, self.weights[0], self.weights[1]
        m00, m01, m10, m11 = (float(x) for x in self.moves.ravel())
        back = []
        a = b = 0.0
        for i, row in enumerate(rows):
            ids = [k for f in row if (k := index.get(f)) is not None]
            e0, e1 = sum(w0[k] for k in ids), sum(w1[k] for k in ids)
            if i == 0:
                a, b = float(self.start[0]) + e0, float(self.start[1]) + e1
                continue
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + e0, max(a + m01, b + m11) + e1
        out = [int(b > a)]
        for x in reversed(back):
            out.append(int(x[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, l2: float = 1e-3, rate: float = 0.1, least: int = 3) -> ChainField:
    """Maximum conditional likelihood by gradient steps (Adam); forward-backward runs over all pages at once."""
    pages = [p for p in pages if p[0]]
    counts = Counter(f for rows, _ in pages for row in rows for f in row)
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    n, longest, d = len(pages), max((len(p[0]) for p in pages), default=0), len(index)
    if not n or not d:
        return ChainField({}, np.zeros((2, 0)), np.zeros((2, 2)), np.zeros(2))
    cells, ids = [], []
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for p, (rows, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        live[p, : len(labels)] = True
        for t, row in enumerate(rows):
            own = [index[f] for f in row if f in index]
            cells += [p * longest + t] * len(own)
            ids += own
    cells, ids = np.array(cells), np.array(ids)
    gold = np.stack([(y == k) & live for k in (0, 1)], axis=-1).astype(float)
    gold_moves = np.array([[(gold[:, :-1, a] * gold[:, 1:, b]).sum() for b in (0, 1)] for a in (0, 1)])
    size = 2 * d + 4 + 2
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        w, moves, start = theta[: 2 * d].reshape(2, d), theta[2 * d : 2 * d + 4].reshape(2, 2), theta[2 * d + 4 :]
        e = np.stack([np.bincount(cells, w[k][ids], n * longest).reshape(n, longest) for k in (0, 1)], axis=-1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves[None], axis=1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step_in, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step_out = np.logaddexp.reduce(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], step_out, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        prob = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        off = prob - gold
        grad = np.concatenate([*(np.bincount(ids, off[..., k].ravel()[cells], d) for k in (0, 1)), (pair.sum(axis=(0, 1)) - gold_moves).ravel(), off[:, 0].sum(axis=0)]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ChainField(index, theta[: 2 * d].reshape(2, d), theta[2 * d : 2 * d + 4].reshape(2, 2), theta[2 * d + 4 :])


_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_ASIDE_NAMES = set("ad advert advertisement sponsor promo banner comment respond sidebar widget cookie consent notice alert popup modal newsletter subscribe breadcrumb menu navbar nav footer related share social login hidden".split())


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by semantic elements; None for a page without an article or main element."""
    if not any(t in ("article", "main") for b in blocks for t, _ in b.path):
        return None
    out = []
    for b in blocks:
        tags, names = {t for t, _ in b.path}, {w for _, ws in b.path for w in ws}
        out.append(int(bool(tags & {"article", "main"}) and not tags & _ASIDE and not names & _ASIDE_NAMES))
    return out


#: Marks main text in built pages (a private character).
MARK = "\ue000"
#: Layouts of training pages: (opening, main, closing) with a place for what is set in; parts are filled at random.
_MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry-content"), ("div", "article-text"), ("div", "story main"), ("div", "")]
_OTHER = [
    ("nav", "", "list"), ("div", "menu", "list"), ("ul", "navbar", "list"), ("div", "breadcrumbs", "list"), ("header", "", "line"), ("div", "site-header", "line"),
    ("aside", "", "text"), ("div", "sidebar", "list"), ("div", "sidebar widget", "text"), ("div", "related posts", "list"), ("div", "ad", "line"), ("div", "advert sponsored", "line"),
    ("div", "ad-banner", "line"), ("div", "promo", "line"), ("aside", "ad", "text"), ("div", "cookie-notice", "line"), ("div", "notice", "line"), ("div", "alert consent", "line"), ("form", "", "line"), ("form", "newsletter subscribe", "line"),
    ("div", "share social", "list"), ("section", "comments", "comments"), ("div", "comments", "comments"), ("ol", "comment-list", "comments"), ("div", "respond", "comments"), ("footer", "", "line"), ("div", "footer", "line"), ("div", "copyright", "copy"), ("div", "popup modal", "line"),
]


def _layout(main: list[str], other: list[str], rng: np.random.Generator) -> tuple[str, str]:
    """A page of the given texts in a random layout; main text has MARK at its blocks' beginnings."""
    esc = lambda x: entities.escape(x, quote=False)
    pick = lambda: esc(other[rng.integers(len(other))]) if other else "more"
    name = lambda x: f' {"id" if rng.random() < 0.2 else "class"}="{x}"' if x else ""

    def box(tag: str, cls: str, kind: str) -> str:
        inner = "li" if tag in ("ul", "ol") else "div"
        if kind == "list":
            body = "".join(f'<li><a href="#">{pick()[:20]}</a></li>' for _ in range(rng.integers(2, 6)))
            body = body if tag in ("ul", "ol") else f"<ul>{body}</ul>"
        elif kind == "comments":
            body = "".join(f'<{inner} class="comment"><p>{pick()}</p></{inner}>' for _ in range(rng.integers(1, 4)))
        elif kind == "text":
            body = "".join(f"<p>{pick()}</p>" for _ in range(rng.integers(1, 3)))
        elif kind == "copy":
            body = f"&copy; {pick()[:40]}"
        else:
            body = f"<p>{pick()}</p>" if rng.random() < 0.5 else pick()
        return f"<{tag}{name(cls)}>{body}</{tag}>"

    tag, cls = _MAIN[rng.integers(len(_MAIN))]
    own = []
    for i, text in enumerate(main):
        kind = "h1" if i == 0 and rng.random() < 0.7 else ["p", "p", "p", "p", "p", "h2", "blockquote", "li", "div", "td"][rng.integers(10)]
        text = MARK + esc(text)
        own.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(kind, f"<{kind}>{text}</{kind}>" if rng.random() < 0.8 else f"<p><b>{text}<br>"))
        if rng.random() < 0.1:
            own.append(box(*_OTHER[rng.integers(10, len(_OTHER))]))
    if rng.random() < 0.3:
        own.append(box(*_OTHER[rng.integers(21, 25)]))
    before = "".join(box(*_OTHER[rng.integers(0, 21)]) for _ in range(rng.integers(1, 4)))
    after = "".join(box(*_OTHER[rng.integers(6, len(_OTHER))]) for _ in range(rng.integers(1, 4)))
    return f"<html><body>{before}<{tag}{name(cls)}>{''.join(own)}</{tag}>{after}</body></html>"


#: Material of layouts, so that the field is trained whatever the table holds.
_OWN_MAIN = [
    "The river rose in the night, and by morning the lower road was closed.",
    "Most of the houses there were built before anyone kept records of the water.",
    "She had measured the same field every spring for twenty years. The numbers hardly changed.",
    "A second survey, made in autumn, found less. Nobody could say why.",
    "What the town needs, he said, is time, money and a better map.",
]
_OWN_OTHER = ["Home", "About us", "Contact", "Read more", "Sign in to see more of this site.", "All rights reserved", "We value your privacy.", "Thanks, this was of help to me. I agree with most of it.", "Our best offers of the week"]


def _material(blocks: list[Block]) -> list[int]:
    """For a page without semantic elements: blocks that read like running text."""
    return [int(b.text.count(" ") >= 7 and 2 * b.linked <= len(b.text)) for b in blocks]


def labelled_pages(pages: list[str], layouts: int = 5, most_blocks: int = MOST_BLOCKS, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the given pages, and of their texts and our own in other layouts."""
    rng, out, texts = np.random.default_rng(seed), [], [(_OWN_MAIN, _OWN_OTHER)] * 4
    for page in pages:
        blocks = leaf_blocks(page)
        if not 0 < len(blocks) <= most_blocks:
            continue
        labels = weak_labels(blocks)
        if labels is not None and any(labels):
            out.append((features(blocks), labels))
        else:
            labels = _material(blocks)
        main, other = ([b.text for b, y in zip(blocks, labels, strict=True) if y == k] for k in (1, 0))
        if main:
            texts.append((main, other or _OWN_OTHER))
    for main, other in texts:
        # what comments and notices say may read like the article
        other = other + [x.split(". ")[int(rng.integers(x.count(". ") + 1))] for x in main]
        for _ in range(layouts):
            made = leaf_blocks(_layout(main, other, rng))
            y = [int(b.text.startswith(MARK)) for b in made]
            for b in made:
                b.text = b.text.replace(MARK, "") or "."
            out.append((features(made), y))
    return out


def main_text(page: str, field: ChainField) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def _extracted(field: ChainField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py(), field) if x.is_valid else "" for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def learn(pages: DataFrame, bound: int = PAGES, longest: int = LONGEST) -> ChainField:
    """Train on at most `bound` pages, those with an article or main element first."""
    own = pages.where(F.col("page_id").isNotNull() & (F.char_length("html") <= longest))
    rank = F.when(F.col("html").rlike("(?i)<(article|main)[\\s>]"), 0).otherwise(1)
    few = C.checkpointed(own.groupBy("page_id").agg(F.min(rank).alias("rank")).orderBy("rank", F.xxhash64("page_id"), "page_id").limit(bound))
    rows = own.join(F.broadcast(few.select("page_id")), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()
    return train(labelled_pages([r["html"] for r in rows]))


def extract(pages: DataFrame, bound: int = PAGES) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return C.mapped(own, _extracted(learn(own, bound)), "page_id long, url string, text string")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
