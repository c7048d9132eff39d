"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

Every block element gets features: its kind, what its class and id tokens say, text and markup density of
its subtree, share of link text, depth, place among its siblings, and what stands above it. Boosted trees give
the log odds that the subtree holds main text. Decoding is a dynamic program over the tree: a node is kept or
dropped; below a dropped node all is dropped, and a kept node has text of its own or a kept child. The
labelling with the highest sum of log probabilities under these rules is taken, so an ancestor and a
descendant never contradict each other.

There are no labelled pages, so the trees learn from annotated pages written here from a fixed seed: articles
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in the many ways pages
mark these up, with and without telling tags and class names.

Defined cases: a null or empty page has an empty text; a page cut off in the middle of a tag, comment or
script loses that; a page with text but no main text has an empty text; very long pages are parsed whole, in time
linear in their length and nesting; rows that repeat a page_id are each extracted; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import table, text_slices
from .dom import NEVER, Node, parse

TRAINING_PAGES = 500
SEED = 11
#: Kinds of elements, one feature each; what is in none is "other".
KINDS = (
    ("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"),
    ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "search", "dialog"), ("table", "tbody", "thead", "tfoot", "tr"), ("td", "th"),
    ("blockquote", "pre"), ("figure", "figcaption", "caption"), ("#text",), ("body", "html"),
)
_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
_APART = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "search"))
_MAIN = frozenset(("article", "main"))
N_FEATURES = len(KINDS) + 28

# --- annotated pages ---------------------------------------------------------------------------------

# How pages name their parts.
_MAIN_NAMES = ("content", "main-content", "post-content", "entry-content", "article-body", "story", "post", "entry", "text", "article", "page-content", "body-text", "hentry", "news-text", "mainText", "single-post")
_MENU_NAMES = ("nav", "menu", "navbar", "main-menu", "navigation", "topnav", "breadcrumb", "breadcrumbs", "site-nav", "links", "pagination", "pager", "toc", "skip-links", "nav-list", "tabs")
_HEAD_NAMES = ("header", "site-header", "masthead", "page-header", "topbar", "banner", "logo", "branding", "head")
_FOOT_NAMES = ("footer", "site-footer", "copyright", "bottom", "foot", "legal", "colophon", "page-footer", "credits")
_SIDE_NAMES = ("sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "aside", "right-column", "popular", "more-stories", "tags", "tag-cloud", "author-box", "read-more", "archive")
_NOTE_NAMES = ("cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup", "modal", "paywall", "subscribe-banner", "announcement", "overlay", "privacy-notice", "message", "warning")
_AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsbygoogle", "banner-ad", "sponsor", "promotion", "commercial", "dfp", "ad-container", "partner")
_FORM_NAMES = ("search", "newsletter", "signup", "login", "subscribe", "contact-form", "subscription", "searchform", "register", "poll", "feedback")
_TALK_NAMES = ("comments", "comment", "comment-list", "disqus", "replies", "discussion", "respond", "comment-body", "reviews", "responses", "user-comments", "commentlist", "reader-comments", "thread")
_SHARE_NAMES = ("share", "social", "sharing", "share-buttons", "follow", "social-links", "tools", "meta-links", "print")
_PLAIN_NAMES = ("row", "col", "wrapper", "container", "inner", "box", "clearfix", "block", "grid", "layout", "wrap", "section", "module", "outer", "page", "left", "x1", "css-1a2b", "u-full", "panel")


class _Writer:
    """Writes one annotated page. Main text stands in elements marked data-keep="1"."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.semantic = self.r.random() < 0.6
        self.named = self.r.random() < 0.85
        self.short = self.r.random() < 0.15

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for k in range(r.randint(low, high)):
            w = "".join(r.choice("bcdfghjklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
            out.append((w.title() if k == 0 or r.random() < 0.06 else w) + (r.choice(",,.;") if r.random() < 0.1 else "") + (r.choice(("%%%", "***", "&amp;&amp;", "###", " |")) if self.short and r.random() < 0.3 else ""))
        return " ".join(out)

    def names(self, pool: tuple[str, ...], sure: bool = False) -> str:
        r = self.r
        if not (self.named or sure):
            pool = _PLAIN_NAMES
        if r.random() < 0.08 and not sure:
            return ""
        key = r.choice(("class", "class", "class", "id", "role"))
        name = r.choice(pool)
        more = f" {r.choice(_PLAIN_NAMES)}" if r.random() < 0.25 and key == "class" else ""
        return f' {key}="{name}{more}"'

    def tag(self, meant: str) -> str:
        return meant if self.semantic and self.r.random() < 0.9 else "div"

    def sentence(self, low: int = 5, high: int = 40) -> str:
        s = self.words(low, high) + self.r.choice((".", ".", "!", "?", "."))
        if self.r.random() < 0.12:
            w = s.split(" ")
            k = self.r.randrange(len(w))
            w[k] = self.r.choice(('<a href="/x">%s</a>', "<b>%s</b>", "<em>%s</em>")) % w[k]
            s = " ".join(w)
        return s

    def paragraph(self, keep: str = "") -> str:
        r = self.r
        body = " ".join(self.sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8)))) if r.random() < 0.85 else self.words(1, 4) + "."
        if r.random() < 0.08:
            return f"<p{keep}><b>{body}<br>"  # unclosed, as pages have it
        return f"<p{keep}>{body}</p>"

    def main(self) -> str:
        r, keep = self.r, ' data-keep="1"'
        out = []
        if r.random() < 0.85:
            h = f"<h1{keep}>{self.words(3, 12)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.12 else h)
        if r.random() < 0.1:
            out.append(f"<h2{keep}>{self.words(3, 9)}</h2>")
        for k in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
            x = r.random()
            if x < 0.8:
                out.append(self.paragraph(keep))
            elif x < 0.86:
                level = r.choice("234")
                out.append(f"<h{level}{keep}>{self.words(2, 8)}</h{level}>")
            elif x < 0.91:
                items, kind = "".join(f"<li>{self.sentence(3, 14)}</li>" for _ in range(r.randint(2, 6))), r.choice(("ul", "ol"))
                out.append(f"<{kind}{keep}>{items}</{kind}>")
            elif x < 0.94:
                out.append(f"<blockquote{keep}><p>{self.sentence()}</p></blockquote>")
            elif x < 0.96:
                rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5)))
                out.append(f"<table{keep}>{rows}</table>")
            elif x < 0.98:
                out.append(f"<pre{keep}>{self.words(4, 20)}</pre>")
            else:
                out.append(f"<div{keep}>{self.sentence(10, 40)}</div>")
            y = r.random()
            if y < 0.05:
                out.append(self.advert())
            elif y < 0.07:
                out.append(self.form())
            elif y < 0.09:
                out.append(self.share())
            elif y < 0.11:
                out.append(self.side())
        inner = "".join(out)
        if r.random() < 0.3:
            inner = f"<div{self.names(_PLAIN_NAMES + _MAIN_NAMES)}>{inner}</div>"
        if r.random() < 0.1:
            inner = f"<section>{inner}</section>"
        if r.random() < 0.08:
            return inner  # right in the body
        t = r.choice(("article", "article", "main", "section")) if self.semantic else "div"
        name = self.names(_MAIN_NAMES) if r.random() < (0.4 if t != "div" else 0.9) else ""
        return f"<{t}{name}>{inner}</{t}>"

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.r.randint(low, high)))

    def menu(self) -> str:
        t = self.tag("nav")
        inside = f"<ul>{self.links(2, 9)}</ul>" if self.r.random() < 0.75 else " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 8)))
        return f"<{t}{self.names(_MENU_NAMES) if t == 'div' or self.r.random() < 0.5 else ''}>{inside}</{t}>"

    def head(self) -> str:
        t = self.tag("header")
        inside = self.r.choice((f"<p>{self.words(1, 5)}</p>", f"<a href='/'>{self.words(1, 3)}</a>", f"<h2>{self.words(1, 4)}</h2>", f"<div>{self.words(1, 6)}</div>", self.words(1, 8)))
        return f"<{t}{self.names(_HEAD_NAMES, t == 'div') if t == 'div' or self.r.random() < 0.4 else ''}>{inside}{self.menu() if self.r.random() < 0.4 else ''}</{t}>"

    def foot(self) -> str:
        t = self.tag("footer")
        inside = self.r.choice((f"&copy; {self.words(1, 6)} &middot; {self.words(2, 10)}.", f"<p>&copy; {self.words(2, 8)}</p>", f"<ul>{self.links(2, 6)}</ul>", f"<p>{self.sentence()}</p><p>{self.words(2, 5)}</p>"))
        return f"<{t}{self.names(_FOOT_NAMES, t == 'div') if t == 'div' or self.r.random() < 0.4 else ''}>{inside}</{t}>"

    def side(self) -> str:
        t = self.tag("aside")
        inside = self.r.choice((f"<h3>{self.words(1, 4)}</h3><ul>{self.links(2, 8)}</ul>", f"<p>{self.sentence()}</p>", f"<h4>{self.words(1, 3)}</h4><p>{self.sentence()}</p><p>{self.sentence()}</p>", f"<ul>{self.links(3, 8)}</ul>"))
        return f"<{t}{self.names(_SIDE_NAMES, t == 'div') if t == 'div' or self.r.random() < 0.5 else ''}>{inside}</{t}>"

    def notice(self) -> str:
        t = self.r.choice(("div", "div", "section", "aside", "p", "dialog"))
        inside = self.sentence() if t == "p" or self.r.random() < 0.4 else f"<p>{self.sentence()}</p><button>{self.words(1, 2)}</button>"
        return f"<{t}{self.names(_NOTE_NAMES, True)}>{inside}</{t}>"

    def advert(self) -> str:
        t = self.r.choice(("div", "div", "div", "aside", "section", "p"))
        inside = self.sentence(2, 20) if t == "p" or self.r.random() < 0.6 else f"<p>{self.sentence()}</p>" + (f"<a href='//x'>{self.words(1, 4)}</a>" if self.r.random() < 0.4 else "")
        return f"<{t}{self.names(_AD_NAMES, True)}>{inside}</{t}>"

    def form(self) -> str:
        inside = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.5:
            inside = f"<p>{self.sentence(3, 14)}</p>" + inside
        return f"<form{self.names(_FORM_NAMES) if self.r.random() < 0.6 else ''}>{inside}</form>"

    def share(self) -> str:
        return f"<div{self.names(_SHARE_NAMES, True)}>" + self.r.choice((f"<ul>{self.links(2, 5)}</ul>", " ".join(f"<a href='#'>{self.words(1, 1)}</a>" for _ in range(3)))) + "</div>"

    def talk(self) -> str:
        t, r = self.r.choice(("div", "section", "section", "ol", "ul")), self.r
        each = "li" if t in ("ol", "ul") else self.r.choice(("div", "article", "div"))
        ones = "".join(
            f"<{each}{self.names(_TALK_NAMES, each != 'li')}>" + r.choice((f"<p>{self.sentence()}</p>", f"<b>{self.words(1, 2)}</b><p>{self.sentence()}</p>", f"<h4>{self.words(1, 2)}</h4><p>{self.sentence()}</p><p>{self.sentence()}</p>", self.sentence())) + f"</{each}>"
            for _ in range(r.randint(1, 6))
        )
        title = f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.5 and t not in ("ol", "ul") else ""
        return f"<{t}{self.names(_TALK_NAMES, True)}>{title}{ones}{self.form() if r.random() < 0.3 and t not in ('ol', 'ul') else ''}</{t}>"

    def page(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.notice, 0.35), (self.head, 0.6), (self.menu, 0.7), (self.advert, 0.45), (self.form, 0.15), (self.side, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.share, 0.25), (self.side, 0.45), (self.talk, 0.4), (self.advert, 0.3), (self.form, 0.2), (self.menu, 0.2), (self.foot, 0.75), (self.notice, 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        main = self.main() if r.random() < 0.97 else ""
        if r.random() < 0.35:
            main = f"<div{self.names(_PLAIN_NAMES)}>{main}{''.join(after[:1])}</div>"
            after = after[1:]
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.25:
            body = f"<div{self.names(_PLAIN_NAMES)}>{body}</div>"
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


# --- features ----------------------------------------------------------------------------------------


@dataclass
class Model:
    #: attribute token -> its log odds of standing at main text
    tokens: dict[str, float]
    trees: boost.Boosted


def features(nodes: list[Node], tokens: dict[str, float]) -> np.ndarray:
    n = len(nodes)
    kids, place = [0] * n, [0] * n
    chars, linked, links, ctrl, imgs = ([0] * n for _ in range(5))
    paras, blocks, stops, heads, size = ([0] * n for _ in range(5))
    said, known, least, most = [0.0] * n, [0] * n, [0.0] * n, [0.0] * n
    own_low, above_low, above_high, apart, inside = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    seen = [0] * n  # characters of the page before the node
    total = 0
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            place[i] = kids[p]
            kids[p] += 1
            above_low[i], above_high[i] = min(above_low[p], least[p]), max(above_high[p], most[p])
            apart[i] = apart[p] or (nodes[p].tag in _APART) + 2 * nodes[p].hidden
            inside[i] = inside[p] + (nodes[p].tag in _MAIN)
        if x.tokens:
            odds = [tokens[t] for t in x.tokens if t in tokens]
            known[i] = len(odds)
            if odds:
                said[i], least[i], most[i] = sum(odds), min(odds), max(odds)
        seen[i] = total
        total += len(x.text)
        chars[i], linked[i], links[i], ctrl[i], imgs[i] = len(x.text), x.link_chars, x.links, x.controls, x.images
        paras[i], blocks[i], heads[i], size[i] = x.tag == "p" and len(x.text) > 0, len(x.text) > 0, x.tag[0] == "h" and x.tag[1:].isdigit(), 1
        stops[i] = x.text.count(".") + x.text.count(",") if x.text else 0
        own_low[i] = least[i]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for c in (chars, linked, links, ctrl, imgs, paras, blocks, heads, size, stops):
            c[p] += c[i]
        own_low[p] = min(own_low[p], own_low[i])
    out = np.zeros((n, N_FEATURES), np.float32)
    for i, x in enumerate(nodes):
        k = _KIND.get(x.tag)
        if k is not None:
            out[i, k] = 1
    whole = max(1, chars[0])
    c = np.array
    chars_, parent = c(chars, float), c([max(0, x.parent) for x in nodes])
    depth, kids_, place_ = c([x.depth for x in nodes], float), c(kids, float), c(place, float)
    siblings = kids_[parent]
    extra = (
        c(said), c(known, float), c(least), c(most), c([len(x.tokens) for x in nodes], float), c(above_low), c(above_high), c(own_low),
        c([a & 1 for a in apart], float), c(inside, float), c([x.hidden or a >= 2 for x, a in zip(nodes, apart)], float),
        np.log1p(chars_), chars_ / whole, c(linked) / np.maximum(1, chars_), np.log1p(c(links)), c(ctrl, float), c(imgs, float),
        np.log1p(c(paras)), np.log1p(c(blocks)), chars_ / np.maximum(1, c(size)), c(stops) / np.maximum(1, chars_) * 100, c(heads, float),
        depth, kids_, place_, siblings, place_ / np.maximum(1, siblings - 1), c(seen) / whole,
    )
    for j, e in enumerate(extra):
        out[:, len(KINDS) + j] = e
    return out


def holds_main(nodes: list[Node]) -> np.ndarray:
    """The label of an annotated page's nodes: whether their subtree holds marked text."""
    mark = [False] * len(nodes)
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        mark[i] = x.mark == "1" if x.mark is not None else x.parent >= 0 and mark[x.parent]
        out[i] = mark[i] and bool(x.text)
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] |= out[i]
    return out


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    written = [parse(_Writer(seed * 100_003 + k).page()) for k in range(pages)]
    labels = [holds_main(nodes) for nodes in written]
    with_, without = Counter(), Counter()
    for nodes, y in zip(written, labels):
        for x, keep in zip(nodes, y):
            if x.tag not in ("html", "body"):
                (with_ if keep else without).update(set(x.tokens))
    tokens = {t: max(-3.0, min(3.0, math.log((with_[t] + 0.5) / (without[t] + 0.5)))) for t in with_ | without if with_[t] + without[t] >= 3}
    x = np.concatenate([features(nodes, tokens) for nodes in written])
    return Model(tokens, boost.fit(x, np.concatenate(labels).astype(float)))


# --- decoding ----------------------------------------------------------------------------------------


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely labelling in which nothing below a dropped node is kept and a
    kept node has text of its own or a kept child."""
    n = len(nodes)
    keep = np.minimum(0, log_odds) - np.log1p(np.exp(-np.abs(log_odds)))
    drop = keep - log_odds
    never = -1e9
    kept, dropped = keep.tolist(), drop.tolist()  # of the subtree, the node kept or dropped
    forced = [never] * n  # the least loss of keeping one child, where none wants to be kept
    any_kept = [bool(x.text) for x in nodes]
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag in NEVER:
            kept[i] = 2 * never
        elif not any_kept[i]:
            kept[i] += forced[i]  # still to keep a child at a loss, or none to keep
        if i:
            p, gain = x.parent, kept[i] - dropped[i]
            kept[p] += max(kept[i], dropped[i])
            dropped[p] += dropped[i]
            any_kept[p] |= gain > 0
            forced[p] = max(forced[p], min(0.0, gain))
    out = np.zeros(n, bool)
    out[0] = kept[0] > dropped[0]
    must = [False] * n  # this child is the one kept at a loss
    chosen: dict[int, int] = {}
    for i in range(1, n):
        p = nodes[i].parent
        if not any_kept[p] and (p not in chosen or kept[i] - dropped[i] > kept[chosen[p]] - dropped[chosen[p]]):
            chosen[p] = i
    for p, i in chosen.items():
        must[i] = True
    for i in range(1, n):
        out[i] = out[nodes[i].parent] and (kept[i] > dropped[i] or must[i])
    return out


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page; the trees run over all nodes of the given pages at once."""
    parsed = [parse(p) if p else None for p in pages]
    some = [features(nodes, model.tokens) for nodes in parsed if nodes]
    odds = model.trees.log_odds(np.concatenate(some)) if some else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        if not nodes:
            out.append("")
            continue
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(x.text for x, k in zip(nodes, kept) if k and x.text))
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html", 1 << 20):
                texts = main_texts(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
