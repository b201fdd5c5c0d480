"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with their open
ancestors.  Features of a block (ancestor tags, words of class and id, length, links,
punctuation, place) give it a score, neighbours are tied by transition weights, and
Viterbi picks the best labelling; blocks labelled as main text are joined.

Training pages come from a bounded sample of the table: their texts are laid out anew in
many page templates, where each block's label is known (:func:`labelled_pages`), so that
other layouts than the table's own are known too.  Scripts, styles, forms' controls and
comments in the markup are no blocks.  Extraction is one Arrow pass, a page at a time.

Defined results: null or empty html and pages without main text give an empty text; cut
off markup is read as far as it goes; a page may be of any length and nesting; repeated rows
are extracted each; of equally good labellings the one with less text wins; text for agents
without scripts (noscript) is a notice, what stands in an object or a formula is text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, inline elements, and elements that hold no text to read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
SILENT = set("annotation annotation-xml button datalist head iframe noscript option script select style svg template textarea title".split())
RAW = "script|style|template|noscript|textarea|svg|title"
#: A self-closed svg is over at once; of unclosed raw elements script and style go to the end, title and textarea to the next tag.
#: A ">" within a quoted value does not end a tag.
VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!svg\b[^>]*/>)({RAW})\b{VALUES}>.*?</\1\s*>|<(?:script|style)\b{VALUES}>.*\Z|<(?:title|textarea)\b{VALUES}>[^<]*"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({VALUES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements that may stand in the head; any other, or text, ends it.
HEAD = {"html", "head", "base", "link", "meta", *RAW.split("|")} - {"svg", "textarea"}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; their texts have single blanks."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked = place = 0
    # how often each element and each name is open, so that nothing looks through the whole stack
    tags: dict[str, int] = {}
    named: dict[str, int] = {}

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names))
        for counts, key in ((tags, tag), *((named, n) for n in names)):
            counts[key] = counts.get(key, 0) + 1

    def pop() -> str:
        tag, names = stack.pop()
        for counts, key in ((tags, tag), *((named, n) for n in names)):
            counts[key] -= 1
            if not counts[key]:
                del counts[key]
        return tag

    def close() -> None:
        nonlocal linked
        text = " ".join(markup.unescape("".join(run)).split())
        if text and SILENT.isdisjoint(tags):
            parent = next((tag for tag, _ in reversed(stack) if tag not in INLINE), None)
            path = (*(t for t in tags if t not in INLINE and t != parent), *([parent] if parent else []))
            out.append(Block(text, path, tuple(named), linked))
        run.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if not text.isspace():
            leave_head()
        run.append(text)
        if "a" in tags:
            linked += len(text)

    def leave_head() -> None:
        if "head" in tags:
            while pop() != "head":
                pass

    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() > place:
            take(page[place : m.start()])
        place = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in RAW.split("|"):
            continue
        if tag not in HEAD and not m[2]:
            leave_head()
        if tag in INLINE or tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag not in VOID and not m[2]:
                push(tag, ())
            elif m[2] and tag in tags:
                while stack[-1][0] != tag and stack[-1][0] in INLINE:
                    pop()
                if stack[-1][0] == tag:
                    pop()
            if tag == "hr":
                close()
            continue
        close()
        while stack and stack[-1][0] in INLINE:  # inline elements end with their block
            pop()
        if m[2]:
            if tag in tags:
                while pop() != tag:
                    pass
        else:
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                pop()
            names = tuple(w.lower() for n in NAMES.findall(m[4]) for w in re.findall(r"[A-Za-z]+", n))
            if not m[4].rstrip().endswith("/"):
                push(tag, names)
    if place < len(page):
        take(page[place:])
    close()
    return out


def block_features(items: list[Block]) -> list[list[str]]:
    """The features that hold for each block."""
    out = []
    for k, b in enumerate(items):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        mine = [
            "one",
            f"words:{min(words.bit_length(), 8)}",
            f"linked:{min(int(share * 4), 3)}",
            f"end:{b.text[-1] in '.!?…”»:'}",
            f"commas:{min(b.text.count(','), 3)}",
            f"mark:{'©' in b.text or '®' in b.text}",
            f"parent:{b.path[-1] if b.path else ''}",
            f"place:{min(4 * k // len(items), 3)}",
        ]
        mine += [f"in:{t}" for t in set(b.path)] + [f"named:{n}" for n in set(b.names)]
        out.append(mine)
    return out


@dataclass
class Crf:
    """Weights of features for label 1, and of steps between labels."""

    weights: dict[str, float]
    steps: np.ndarray

    def decode(self, items: list[Block]) -> list[int]:
        """The best labelling of the blocks, by Viterbi."""
        best, back = (0.0, 0.0), []
        get, s = self.weights.get, self.steps
        for k, mine in enumerate(block_features(items)):
            unary = sum(get(f, 0.0) for f in mine)
            if not k:
                best = (0.0, unary)
                continue
            from0 = 0 if best[0] + s[0, 0] >= best[1] + s[1, 0] else 1
            from1 = 0 if best[0] + s[0, 1] >= best[1] + s[1, 1] else 1
            back.append((from0, from1))
            best = (best[from0] + s[from0, 0], best[from1] + s[from1, 1] + unary)
        if not items:
            return []
        label = [int(best[1] > best[0])]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]

    def text(self, page: str | None) -> str:
        items = blocks(page)
        return "\n".join(b.text for b, y in zip(items, self.decode(items), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Weights by gradient ascent on the likelihood, all pages at once by forward and backward sums."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    longest, n = max((len(b) for b, _ in pages), default=0), len(pages)
    cells, ids = [], []
    y, on = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (items, label) in enumerate(pages):
        y[i, : len(label)], on[i, : len(label)] = label, True
        for k, mine in enumerate(block_features(items)):
            for f in mine:
                cells.append(i * longest + k)
                ids.append(names.setdefault(f, len(names)))
    cells_, ids_ = np.array(cells, int), np.array(ids, int)
    w, s = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for t in range(1, rounds + 1 if n else 1):
        u = np.zeros((n, longest, 2))
        u[..., 1] = np.bincount(cells_, weights=w[ids_], minlength=n * longest).reshape(n, longest)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = u[:, 0]
        for k in range(1, longest):
            step = u[:, k] + np.logaddexp(a[:, k - 1, :1] + s[0], a[:, k - 1, 1:] + s[1])
            a[:, k] = np.where(on[:, k, None], step, a[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp(s[:, 0] + (u[:, k + 1] + b[:, k + 1])[:, :1], s[:, 1] + (u[:, k + 1] + b[:, k + 1])[:, 1:])
            b[:, k] = np.where(on[:, k + 1, None], step, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[..., 1] + b[..., 1] - z[:, None])
        gw = np.bincount(ids_, weights=((y - p1) * on).reshape(-1)[cells_], minlength=len(w)) / n - decay * w
        both = on[:, 1:]
        gs = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(a[:, :-1, i] + s[i, j] + u[:, 1:, j] + b[:, 1:, j] - z[:, None])
                gs[i, j] = ((((y[:, :-1] == i) & (y[:, 1:] == j)) - p) * both).sum() / n
        gs -= decay * s
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (s, gs, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf({f: float(w[k]) for f, k in names.items()}, s)


#: Elements and names that hold main text, and those that hold anything else.
MAIN = ["article", "main", "div class='content'", "div id='post'", "section class='entry'", "div class='article-body'", "div class='story text'", "main id='main'"]
OTHER = [
    "nav", "header", "footer", "aside", "div class='sidebar'", "div class='ad'", "div class='ads banner'", "div class='cookie notice'", "form", "ul class='menu'",
    "div class='comments'", "section id='comments'", "div class='comment'", "div class='promo'", "div class='newsletter'", "div class='related'", "div class='share social'",
    "div class='breadcrumb'", "div id='footer'", "div id='header'", "div class='nav'", "div class='advert'", "div class='sponsor'", "div role='navigation'", "div class='widget'", "div class='popup modal'",
]


def labelled_pages(texts: list[str], count: int = 400, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Pages in random layouts made of ``texts``, with the label of each block.

    Text of the main part starts with a mark that is taken off after the page is cut into
    blocks, so that the labels follow the blocks whatever the layout.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    clause = lambda n: markup.escape(" ".join(pick(texts).split()[:n]))
    mark = "\ue000"

    def other(kind: str) -> str:
        tag, style = kind.split()[0], int(rng.integers(4))
        if style == 0 or kind in ("nav", "ul class='menu'"):
            body = "".join(f"<li><a href='/x'>{clause(int(rng.integers(1, 4)))}</a></li>" for _ in range(int(rng.integers(2, 9))))
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif style == 1:
            body = f"&copy; {clause(int(rng.integers(2, 12)))}"
        elif style == 2:
            body = "".join(f"<p>{clause(int(rng.integers(3, 40)))}</p>" for _ in range(int(rng.integers(1, 4))))
        else:
            body = clause(int(rng.integers(2, 25)))
        if tag == "form":
            body = f"<label>{clause(2)}</label><input name='q'><p>{clause(int(rng.integers(2, 12)))}</p>"
        return f"<{kind}>{body}</{tag}>"

    def paragraph() -> str:
        text = mark + clause(int(rng.choice([3, 8, 20, 50, 120])))
        return pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<h2>{text}</h2>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<p><a href='/y'>{text[: len(text) // 3]}</a>{text[len(text) // 3 :]}</p>"])

    pages = []
    for _ in range(count if texts else 0):
        kind = pick(MAIN)
        main = f"<{kind}>" + (f"<h1>{mark}{clause(8)}</h1>" if rng.random() < 0.8 else "")
        for _ in range(int(rng.integers(1, 14))):
            main += paragraph() if rng.random() < 0.93 else other(pick(OTHER[3:]))
        main += f"</{kind.split()[0]}>"
        page = "<html><head><title>t</title></head><body>" + "".join(other(pick(OTHER)) for _ in range(int(rng.integers(0, 5)))) + main
        page += "".join(other(pick(OTHER)) for _ in range(int(rng.integers(0, 5)))) + "</body></html>"
        cut = blocks(page)
        label = [int(mark in b.text) for b in cut]
        pages.append(([Block(b.text.replace(mark, "") or "-", b.path, b.names, b.linked) for b in cut], label))
    return pages


def train(pages: DataFrame, sample_pages: int = 200, layouts: int = 500, sample_chars: int = 100_000) -> Crf:
    """A model from the texts of a bounded sample of pages (the smallest hashes of url and page_id).

    ``sample_chars``: of a sample page only so many first characters are trained on, as the
    sample is held by the driver; extraction reads pages whole.
    """
    # first the sample's keys alone: rows of html would reach the driver from each task
    key = F.xxhash64("url", "page_id")
    full = pages.filter("html IS NOT NULL")
    chosen = full.select(key.alias("key")).distinct().orderBy("key").limit(sample_pages)
    html = full.withColumn("key", key).join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.substring("html", 1, sample_chars)).alias("html"))
    rows = html.orderBy("key").select("html").collect()
    texts = [b.text for (page,) in rows for b in blocks(page) if b.text.count(" ") >= 3]
    return fit(labelled_pages(texts, layouts))


def extracted(pages: DataFrame, model: Crf) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                text = [model.text(x.as_py()) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
