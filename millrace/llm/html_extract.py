"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi.

Features of a block are the tags and class or id words of its ancestors, its length, link density, punctuation and
place; two labels, main text or not, with transition weights between neighbours. The field is trained on labelled pages
that `labelled_pages` composes (layouts with and without telling tags and class names), by gradient ascent on the
conditional likelihood, on the driver; only its weights, some hundred numbers, go to the executors.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute: its name and its value in double quotes, in single quotes, or bare, where a quote is a character like others.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TAG_END = re.compile(r"[\s/]*(>?)")
WORD = re.compile(r"[a-z]+")
# What HTML calls block-level, what it closes by itself, what holds nothing.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements whose content is no text of the page; of the last ones the markup is not even parsed.
SKIPPED = frozenset("noscript template iframe textarea svg math object".split())
RAW = frozenset("script style".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body div footer header main nav section table td th ul ol dl form blockquote figure".split())
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "h1", "h2", "h3", "h4", "p", "figure", "figcaption", "blockquote", "section", "div", "title", "head", "button", "label", "option", "select", "menu", "dialog", "pre", "dl", "address", "a")
HINTS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar tabs pagination pager toolbar skip",
    "comment": "comment comments reply replies respond disqus discussion reader feedback",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header masthead top logo brand site",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending teaser",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup paywall disclaimer",
    "form": "form search login input signin register contact",
    "share": "share social sharing follow tags meta byline author",
    "main": "content article post entry main story body text page prose",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
#: Elements nest so deep at most, as in browsers; deeper ones are siblings.
MAX_DEPTH = 512
NAMES = ["bias", "first", "second", "last", *(f"in:{t}" for t in TAGS), *(f"own:{t}" for t in TAGS), *(f"hint:{h}" for h in HINTS), "hidden", *(f"len:{k}" for k in range(9)), *(f"links:{k}" for k in range(5)), "stop", "comma", "sign", "upper", "digits", "depth0", "depth1", "depth2", "loose"]
NUMBER = {n: i for i, n in enumerate(NAMES)}


class Element:
    """An open element: what it says of the text in it, its ancestors' share included."""

    __slots__ = ("tag", "features", "own", "blocks", "links", "skipped")

    def __init__(self, tag: str, words: str, parent: Element | None) -> None:
        new = {NUMBER[x] for x in (f"in:{tag}", *(("hidden" if w == "hidden" else f"hint:{HINT_OF.get(w)}") for w in WORD.findall(words.lower()))) if x in NUMBER}
        old = parent.features if parent else frozenset()
        self.tag, self.features = tag, old if new <= old else old | new
        self.own = tag if tag in BLOCK else parent.own if parent else "div"
        self.blocks = (parent.blocks if parent else 0) + (tag in BLOCK)
        self.links = (parent.links if parent else 0) + (tag == "a")
        self.skipped = tag in SKIPPED or bool(parent and parent.skipped)


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def start_tag(markup: str, at: int) -> tuple[int, str, bool]:
    """Of the attributes from `at` on: where the tag ends (-1 if it doesn't), class, id and role words, and whether it closes itself."""
    words, slash = [], False
    while True:
        end = TAG_END.match(markup, at)
        if end[1]:
            return end.end(), " ".join(words), markup[end.end() - 2] == "/"
        m = ATTRIBUTE.match(markup, at)
        if m is None or m.end() == at:
            return -1, "", slash
        name = m[1].lower()
        if name in ("class", "id", "role"):
            words.append(m[2] or m[3] or m[4] or "")
        elif name == "hidden" or (name == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true"):
            words.append("hidden")
        at = m.end()


def leaf_blocks(markup: str) -> list[Block]:
    """The text blocks of a page in order, each with its innermost element.

    Character references are decoded, white space (no-break space included) becomes one space, empty blocks go. Scripts, styles and
    comments are no text; open elements end as HTML ends them: a paragraph at the next one, list items and cells at their kind, a
    drawing at the next block. A tag or comment that never ends takes the rest, as in browsers, and what is no tag is text. One pass:
    the time grows with the length of the page, whatever its markup.
    """
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = at = 0
    last = markup.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, linked))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        if any(x.tag in BLOCK for x in stack[upto:]):
            flush()
        for x in stack[upto:]:
            opened[x.tag] -= 1
        del stack[upto:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not (stack and stack[-1].skipped):
            parts.append(piece)
            if stack and stack[-1].links:
                linked += len(piece.strip())

    while at < len(markup):
        lt = markup.find("<", at)
        if lt < 0:
            text(markup[at:])
            break
        text(markup[at:lt])
        at = lt + 1
        if markup.startswith("!--", at):
            end = markup.find("-->", at + 1)
            at = len(markup) if end < 0 else end + 3
            continue
        if markup[at : at + 1] in ("!", "?"):
            at = markup.find(">", at) + 1 or len(markup)
            continue
        closing = markup[at : at + 1] == "/"
        m = NAME.match(markup, at + closing)
        if m is None:
            text("<")
            continue
        if lt > last:
            break
        tag = m[0].lower()
        if closing:
            at = markup.find(">", m.end()) + 1
            if opened[tag]:
                close(max(i for i in range(len(stack)) if stack[i].tag == tag))
            elif tag in BLOCK:
                flush()
            continue
        at, words, itself = start_tag(markup, m.end())
        if at < 0:
            break
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text("\n")
            continue
        if tag in RAW or (tag in SKIPPED and tag not in ("svg", "math")):
            end = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
            if end or tag in RAW:
                at = end.end() if end else len(markup)
            else:
                unclosed.add(tag)
            continue
        if tag in BLOCK:
            if stack and stack[-1].skipped:
                close(next(i for i, x in enumerate(stack) if x.skipped))
            flush()
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        if any(opened[x] for x in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if (not itself or tag in BLOCK) and len(stack) < MAX_DEPTH:
            stack.append(Element(tag, words, stack[-1] if stack else None))
            opened[tag] += 1
    flush()
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    rows = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        e = b.element
        row = [0, *(e.features if e else ()), NUMBER["len:0"] + min(8, n.bit_length() - 2 if n >= 4 else 0)]
        if e is None:
            row.append(NUMBER["loose"])
        row += [NUMBER[x] for x in (f"own:{e.own if e else 'div'}", f"depth{min(2, max(0, (e.blocks if e else 0) - 3))}") if x in NUMBER]
        row.append(NUMBER["links:0"] + min(4, 4 * b.linked // n))
        if i < 2:
            row.append(1 + i)
        if i == len(blocks) - 1:
            row.append(3)
        if b.text[-1] in ".!?…:»\"”":
            row.append(NUMBER["stop"])
        if "," in b.text:
            row.append(NUMBER["comma"])
        if "©" in b.text or "·" in b.text or "|" in b.text or "»" in b.text:
            row.append(NUMBER["sign"])
        if b.text.isupper():
            row.append(NUMBER["upper"])
        if sum(map(str.isdigit, b.text)) * 4 > n:
            row.append(NUMBER["digits"])
        rows.append(row)
    return rows


class Field:
    """Weights of a two-label chain: a vector for label 1 (main text), and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def viterbi(self, rows: list[list[int]]) -> list[bool]:
        w, (a, b), (c, d) = self.weights, self.moves[0], self.moves[1]
        zero, one, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            e = sum(w[i] for i in row)
            if k:
                from0, from1 = zero + a >= one + c, zero + b >= one + d
                zero, one = (zero + a if from0 else one + c), (zero + b if from1 else one + d) + e
                back.append((from0, from1))
            else:
                one = e
        label = one > zero
        out = [label]
        for from0, from1 in reversed(back):
            label = not (from1 if label else from0)
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Adaptive gradient ascent on the conditional log-likelihood; forward-backward over all pages at once, padded."""
    pages = [p for p in pages if p[0]]
    n, t = len(pages), max(len(r) for r, _ in pages)
    x, y, real = np.zeros((n, t, len(NAMES)), np.float32), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (rows, labels) in enumerate(pages):
        for k, row in enumerate(rows):
            x[i, k, row] = 1
        y[i, : len(rows)], real[i, : len(rows)] = labels, True
    w, moves = np.zeros(len(NAMES)), np.zeros((2, 2))
    sw, sm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    flat = x[real]
    logsum = np.logaddexp
    for _ in range(rounds):
        e = np.zeros((n, t, 2))
        e[..., 1] = x @ w.astype(np.float32)
        f, g = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = e[:, 0]
        for k in range(1, t):
            s = f[:, k - 1, :, None] + moves
            f[:, k] = np.where(real[:, k, None], logsum(s[:, 0], s[:, 1]) + e[:, k], f[:, k - 1])
        for k in range(t - 2, -1, -1):
            s = moves + (e[:, k + 1] + g[:, k + 1])[:, None, :]
            g[:, k] = np.where(real[:, k + 1, None], logsum(s[..., 0], s[..., 1]), 0)
        z = logsum(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f[..., 1] + g[..., 1] - z[:, None])
        gw = flat.T @ (y - p)[real] / n - decay * w
        both = real[:, 1:]
        pair = np.exp(f[:, :-1, :, None] + moves + (e + g)[:, 1:, None, :] - z[:, None, None, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        gm = (seen - pair[both].sum(axis=0)) / n - decay * moves
        sw, sm = sw + gw**2, sm + gm**2
        w, moves = w + rate * gw / np.sqrt(sw), moves + rate * gm / np.sqrt(sm)
    return Field(w, moves)


# ---------------------------------------------------------------- labelled pages

_PIECES = "an be co de er in la mi no or pa ra re sa ta ti un ve we el do su lo ni ka".split()


def labelled_pages(n: int, seed: int = 3) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Pages with the texts of their blocks and labels: 1 for the article, 0 for what surrounds or interrupts it."""
    r = random.Random(seed)

    def words(lo: int, hi: int, stop: bool = True) -> str:
        w = ["".join(r.choice(_PIECES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        if stop and len(w) > 8:
            for i in range(7, len(w), 9):
                w[i] += r.choice(",.;")
        return " ".join(w).capitalize() + ("." if stop else "")

    for _ in range(n):
        out: list[tuple[str, int]] = []
        style = r.choice(("tags", "tags", "names", "both", "plain"))
        tags, names = style in ("tags", "both"), style in ("names", "both")

        def wrap(tag: str, name: str, inside: str, tags=tags, names=names) -> str:
            t = tag if tags else "div"
            c = f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", "-box", " wide", "_1"))}"' if names or r.random() < 0.25 else ""
            return f"<{t}{c}>{inside}</{t}>"

        def leaf(text: str, label: int, tag: str, inner: str | None = None, out=out) -> str:
            out.append((text, label))
            end = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
            return f"<{tag}>{inner or text}{end}"

        def links(lo: int, hi: int, many: int, leaf=leaf) -> str:
            return "<ul>" + "".join(leaf(t := words(1, many, False), 0, "li", f'<a href="/{k}">{t}</a>') for k in range(r.randint(lo, hi))) + "</ul>"

        def menu() -> str:
            return wrap("nav", r.choice(("nav", "menu", "navbar", "breadcrumb")), links(3, 8, 2))

        def advert() -> str:
            return f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo banner"))}">' + (leaf(words(4, 25), 0, r.choice(("p", "span", "div")))) + "</div>"

        def notice() -> str:
            return f'<div class="{r.choice(("cookie-notice", "newsletter", "consent", "alert", "subscribe"))}">' + leaf(words(6, 25), 0, "p") + leaf(words(1, 2, False), 0, "button") + "</div>"

        def form() -> str:
            return "<form>" + leaf(words(1, 3, False), 0, "label") + '<input name="q">' + leaf(words(1, 2, False), 0, "button") + "</form>"

        def side() -> str:
            return wrap("aside", r.choice(("sidebar", "related", "widget", "popular")), leaf(words(1, 3, False), 0, "h3") + (links(3, 6, 7) if r.random() < 0.6 else leaf(words(8, 30), 0, "p")))

        def comments() -> str:
            return f'<{"section" if tags else "div"} class="{r.choice(("comments", "comment-list", "reader-comments", "replies"))}">' + leaf(words(1, 2, False), 0, "h3") + "".join(f'<div class="{r.choice(("comment", "reply"))}">' + leaf(words(5, 50), 0, "p") + "</div>" for _ in range(r.randint(1, 5))) + "</section>"[: 10 if tags else 0] + ("" if tags else "</div>")

        def bare(out=out, wrap=wrap, leaf=leaf, menu=menu, advert=advert, side=side, comments=comments) -> Iterator[tuple[str, list[tuple[str, int]]]]:
            """Fragments and poor pages: some paragraphs, perhaps in containers, perhaps with one thing around them."""
            if r.random() < 0.15:
                out.append((t := words(4, 60), 1))
                yield t, out
                return
            title = leaf(words(3, 12, False), 0, "title") if r.random() < 0.2 else ""
            before = r.choice((menu, advert, str, str, str, str, str))()
            parts = [leaf(words(2, 10, False), 1, r.choice(("h1", "h2")))] if r.random() < 0.3 else []
            for _ in range(r.choice((1, 1, 2, 3, 5))):
                t = words(*r.choice(((2, 8), (8, 40), (30, 100))))
                parts.append(leaf(t.replace(" ", " | ") if r.random() < 0.12 else t, 1, r.choice(("p", "p", "p", "div"))))
            inside = "".join(parts)
            for _ in range(r.choice((0, 0, 1, 2, 3, 8))):
                inside = r.choice((lambda x: f"<div>{x}</div>", lambda x: wrap("article", r.choice(("page", "story", "content", "post", "wrap")), x), lambda x: wrap("main", "main", x), lambda x: f"<section>{x}</section>"))(inside)
            after = r.choice((side, comments, comments, str, str, str, str))()
            if r.random() < 0.2:
                after += wrap("footer", "footer", leaf(words(2, 6, False) + r.choice((" · ", " | ", " ")) + words(2, 8), 0, "p"))
            markup = before + inside + after
            if r.random() < 0.6:
                markup = f"<body>{markup}</body>"
            if title or r.random() < 0.3:
                markup = f"<html><head>{title}</head>{markup}</html>"
            yield markup, out

        def body() -> str:
            parts = [leaf(words(3, 12, False) + r.choice(("", ".")), 1, "h1")]
            for _ in range(r.randint(1, 14)):
                kind = r.random()
                if kind < 0.72:
                    t = words(*r.choice(((1, 6), (8, 40), (30, 140))))
                    if r.random() < 0.12:
                        t = t.replace(" ", r.choice((" | ", " · ")))
                    parts.append(leaf(t, 1, "p", f"<b>{t}" if r.random() < 0.08 else None))
                elif kind < 0.8:
                    parts.append(leaf(words(2, 7, False), 1, r.choice(("h2", "h3"))))
                elif kind < 0.87:
                    parts.append("<ul>" + "".join(leaf(words(4, 20), 1, "li") for _ in range(r.randint(2, 5))) + "</ul>")
                elif kind < 0.91:
                    parts.append("<blockquote>" + leaf(words(8, 40), 1, "p") + "</blockquote>")
                elif kind < 0.94:
                    parts.append("<table>" + "".join("<tr>" + "".join(leaf(words(1, 4, False), 1, "td") for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
                else:
                    parts.append(r.choice((advert, notice, side, advert))())
            if r.random() < 0.2:
                parts.append(comments())
            return "".join(parts)

        if r.random() < 0.3:
            yield from bare()
            continue
        head = "<head><meta charset=utf-8>" + leaf(words(3, 12, False), 0, "title") + "<style>p{margin:0}</style><script>var t='</p>';</script></head>"
        top = [x() for x in (menu, notice, form, advert) if r.random() < 0.5]
        if r.random() < 0.4:
            top.insert(0, wrap("header", "header", leaf(words(1, 4, False), 0, r.choice(("div", "p", "h2")))))
            out.insert(1, out.pop())  # it stands first
        main = wrap(r.choice(("article", "main")), r.choice(("content", "article", "post", "entry", "story")), body())
        low = [x() for x in (side, comments, form, advert, menu) if r.random() < 0.35]
        foot = wrap("footer", "footer", leaf(r.choice(("© ", "")) + words(2, 6, False) + r.choice((" · ", " | ", " ")) + words(2, 14), 0, r.choice(("p", "div", "span")))) if r.random() < 0.85 else ""
        yield "<!DOCTYPE html><html>" + head + "<body>" + "".join(top) + main + "".join(low) + foot + "</body></html>", out


def labelled_blocks(n: int, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Blocks as the parser cuts them, with the label of the text they come from."""
    out = []
    for markup, truth in labelled_pages(n, seed):
        label: dict[str, int] = {}
        for text, y in truth:
            label[" ".join(text.split())] = max(y, label.get(text, 0))
        blocks = leaf_blocks(markup)
        if all(b.text in label for b in blocks):
            out.append((blocks, [label[b.text] for b in blocks]))
    return out


@lru_cache(1)
def default_field(pages: int = 900) -> Field:
    return train([(features(b), y) for b, y in labelled_blocks(pages)])


def main_text(markup: str | None, field: Field) -> str:
    blocks = leaf_blocks(markup) if markup else []
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, field.viterbi(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", field: Field | None = None) -> DataFrame:
    """Every row with `main_text` added: the blocks labelled main, in page order, joined by one space.

    Null, empty and text-free pages give an empty string; repeated rows give equal texts; nothing is cut or
    shuffled. A column `main_text` of the input is replaced.
    """
    bounded_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def texts(markup: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, held.value) for x in markup], dtype=object)

    return pages.withColumn("main_text", F.pandas_udf(texts, "string")(F.col(html_column)))
