"""Main text of web pages: gradient-boosted trees over DOM nodes, then hierarchical decoding.

Every block element and every run of text beside block elements is a node. Trees score the chance that a node holds main text
from its tag, the words of its attributes, depth, subtree density, links and siblings. Decoding takes the most likely choice for
the whole tree under one rule: below a node left out, all is left out, so an ancestor and a descendant never contradict.

No gold labels come with pages. The trees learn from two bounded sets: page skeletons built here from the texts of a sample of
the pages, whose labels are known, and the sampled pages themselves, labelled by their semantic tags. A sampled page whose tags
mark no text (no article or main element, or nothing in it) says nothing about its blocks: it lends its texts, not labels.
"""
from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_PAGES, SKELETONS, TREES, DEPTH, BINS, RATE, ROWS = 200, 300, 40, 4, 32, 0.3, 64     # documented bounds of what a fit uses
OPENING = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
NAME_END = re.compile(r"[\s/>]")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
QUOTE_OR_END = re.compile(r"[>\"']")
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{64,}|[xX][0-9a-fA-F]{64,});?")         # of no character
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements by their role in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}      # their content is raw text
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GROUPS = [["article", "main"], ["section", "div", "center", "noscript", "template"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"], ["li", "dd", "dt"], ["ul", "ol", "dl", "menu"], ["nav"], ["header"], ["footer"], ["aside"],
          ["form", "fieldset", "button", "legend", "dialog", "search", "select", "optgroup", "option"], ["table", "tbody", "thead", "tfoot", "tr", "td", "th"], ["blockquote", "pre", "figure", "figcaption", "details", "summary", "address"], ["html", "body"], ["head"], ["#text"]]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
WORDS = [["article", "content", "post", "entry", "main", "body", "story", "text"], ["nav", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"], ["ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"],
         ["comment", "comments", "reply", "replies", "discussion", "disqus", "respond"], ["sidebar", "side", "aside", "widget", "related", "recommended", "teaser", "complementary"], ["header", "head", "masthead", "top", "logo", "brand"],
         ["footer", "foot", "bottom", "copyright", "contentinfo", "legal"], ["cookie", "notice", "consent", "alert", "modal", "popup", "overlay", "gdpr", "privacy", "warning"], ["share", "social", "form", "login", "search", "newsletter", "subscribe", "signup"]]
WORD = {w: k for k, words in enumerate(WORDS) for w in words}
CHOICES = {"select", "optgroup", "option"}
CLOSES = {"option": {"option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
N_FEATURES = len(GROUPS) + len(WORDS) + 16


class TagEnds:
    """Where tags end, for a page in which one does not: from every quote or ``>`` on, the ``>`` that is outside of quotes."""

    def __init__(self, html: str, start: int):
        marks = list(QUOTE_OR_END.finditer(html, start))
        self.at = np.array([m.start() for m in marks], dtype=np.int64)
        self.end = [-1] * (len(marks) + 1)
        later: dict[str, int] = {}
        for k in range(len(marks) - 1, -1, -1):
            mark = marks[k][0]
            self.end[k] = int(self.at[k]) + 1 if mark == ">" else self.end[later[mark] + 1] if mark in later else -1
            later[mark] = k

    def after(self, at: int) -> int:
        return self.end[int(np.searchsorted(self.at, at))]


def markup(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of comments, declarations (without a name) and tags, in one pass.

    A ``<`` whose tag never ends is text. Each look ahead either is consumed or its outcome is kept, so the time is linear.
    """
    at, last_end, name_from, name_end, ends = 0, html.rfind(">"), 0, -1, None
    while opening := OPENING.search(html, at):
        start = opening.start()
        at = start + 1
        if html.startswith("<!--", start):
            found = html.find("-->", start + 4)
            at = found + 3 if found >= 0 else len(html)
            yield start, at, False, "", ""
        elif start > last_end:                                        # nothing but an open comment can follow
            if (found := html.find("<!--", start)) >= 0:
                yield found, len(html), False, "", ""
            return
        elif html[start + 1] in "!?":
            at = html.index(">", start) + 1
            yield start, at, False, "", ""
        else:
            first = opening.end() - 1
            if not name_from <= first < name_end:                     # else inside a name that was read before
                name_from, name_end = first, NAME_END.search(html, first).start()
            if ends is None:
                rest = REST.match(html, name_end)
                end = rest.end() if rest else -1
                if not rest:
                    ends = TagEnds(html, start)
            else:
                end = ends.after(name_end)
            if end >= 0:
                at = end
                jump = yield start, end, html[start + 1] == "/", html[first:name_end].lower(), html[name_end:end - 1]
                at = max(at, jump or 0)


class Page:
    """Nodes of one page in page order: a parent comes before its children. Marks of generated skeletons are read with ``marks`` alone."""

    def __init__(self, html: str | None, marks: bool = True):
        self.marks = marks
        self.group, self.words, self.parent, self.depth, self.text, self.links, self.keep = [], [], [], [], [], [], []
        self.stack: list[tuple[str, int]] = []
        self.opened: Counter = Counter()                # open elements by tag
        self.push("html", self.add("html", ""))
        pieces, link, link_chars, at, html = [], 0, 0, 0, html or ""
        tags, jump = markup(html), None
        while True:
            try:
                start, end, closing, tag, attributes = tags.send(jump)
            except StopIteration:
                start = end = len(html)
                tag = None
            jump = None
            if start > at:
                pieces.append(html[at:start])
                link_chars += start - at if link else 0
            if tag is None:
                break
            at = end
            if tag in RAW and not closing:
                if not attributes.endswith("/"):
                    close = re.compile(f"</{tag}", re.I).search(html, at)
                    at = jump = html.find(">", close.end()) + 1 if close else 0
                    if not at:
                        at = jump = len(html)
            elif tag == "a":
                link = 0 if closing else 1
            elif tag in VOID:
                pieces.append(" ")
                if tag == "hr":
                    link_chars = self.flush(pieces, link_chars)
            elif tag in GROUP:
                link_chars = self.flush(pieces, link_chars)
                self.close(tag) if closing else self.open(tag, attributes)
        self.flush(pieces, link_chars)

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.opened[tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.opened[tag] -= 1
        return tag

    def add(self, tag: str, attributes: str) -> int:
        words, keep = (), None
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "data-keep":
                keep = int(value) if self.marks and value in ("0", "1") else None
            else:
                words += tuple(WORD[w] for w in (x.lower() for x in ATTRIBUTE_WORD.findall(value)) if w in WORD)
        self.group.append(GROUP[tag])
        self.words.append(words)
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.depth.append(len(self.stack))
        self.text.append("")
        self.links.append(0)
        self.keep.append(keep)
        return len(self.group) - 1

    def flush(self, pieces: list[str], link_chars: int) -> int:
        text = " ".join(unescape(LONG_REFERENCE.sub("\ufffd", "".join(pieces))).split())
        pieces.clear()
        if text:
            node = self.stack[-1][1]
            if node != len(self.group) - 1 or self.text[node]:
                node = self.add("#text", "")
            self.text[node], self.links[node] = text, min(link_chars, len(text))
        return 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.opened[tag]:
            return
        if tag == "body" or (tag != "head" and self.stack[-1][0] == "head"):
            self.close("head")
        if self.stack[-1][0] == "p":
            self.pop()
        while tag not in CHOICES and self.stack[-1][0] in CHOICES:         # other elements end an unclosed choice
            self.pop()
        for t in CLOSES.get(tag, ()):
            if self.stack[-1][0] == t:
                self.pop()
        above = self.stack[-1][1]
        if self.text[above]:                    # text before a block element becomes a node of its own
            moved = self.add("#text", "")
            self.text[moved], self.links[moved], self.text[above], self.links[above] = self.text[above], self.links[above], "", 0
        self.push(tag, self.add(tag, attributes))

    def close(self, tag: str) -> None:
        if tag != "html" and self.opened[tag]:
            while self.pop() != tag:
                pass

    def features(self) -> np.ndarray:
        n = len(self.group)
        parent = np.array(self.parent)
        own = np.fromiter(map(len, self.text), dtype=np.float64, count=n)
        stops = np.fromiter((t.count(". ") + t.endswith((".", "!", "?")) for t in self.text), dtype=np.float64, count=n)
        total, links, size, marks = own.copy(), np.array(self.links, dtype=np.float64), np.ones(n), stops.copy()
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            total[p] += total[i]
            links[p] += links[i]
            size[p] += size[i]
            marks[p] += marks[i]
        group = np.array(self.group)
        up = np.maximum(parent, 0)
        children = np.bincount(up[1:], minlength=n).astype(np.float64)
        rank, seen = np.zeros(n), [0] * n
        inside, outside = np.zeros(n), np.zeros(n)
        same = np.zeros(n)
        kinds: dict[tuple[int, int], int] = {}
        for i in range(1, n):
            p = self.parent[i]
            rank[i] = seen[p]
            seen[p] += 1
            kinds[p, self.group[i]] = kinds.get((p, self.group[i]), 0) + 1
            inside[i] = inside[p] or self.group[p] == 0
            outside[i] = outside[p] or 6 <= self.group[p] <= 10 or any(w for w in self.words[p])
        for i in range(1, n):
            same[i] = kinds[self.parent[i], self.group[i]]
        around = np.maximum(children[up], 1)
        x = np.zeros((n, N_FEATURES))
        x[np.arange(n), group] = 1
        for i, words in enumerate(self.words):
            for w in words:
                x[i, len(GROUPS) + w] += 1
        x[:, len(GROUPS) + len(WORDS):] = np.stack([
            np.array(self.depth, dtype=np.float64), np.log1p(total), np.log1p(own), links / np.maximum(total, 1), total / size, np.log1p(size), children, np.log1p(marks), marks / np.maximum(total, 1) * 100, around, rank / around, same / around,
            total / np.maximum(total[up], 1), total / max(total[0], 1), inside, outside], axis=1)
        return x

    def decoded(self, p: np.ndarray) -> list[bool]:
        yes, no = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
        for i in range(len(yes) - 1, 0, -1):
            yes[self.parent[i]] += max(yes[i], no[i])
            no[self.parent[i]] += no[i]
        kept = [yes[0] > no[0]]
        for i in range(1, len(yes)):
            kept.append(kept[self.parent[i]] and yes[i] > no[i])
        return kept

    def known(self) -> np.ndarray:
        """Label of each node: whether it holds main text, by marked leaves or else by semantic tags."""
        marked = any(k is not None for k in self.keep)
        n, good = len(self.group), np.zeros(len(self.group), dtype=bool)
        inside, bad = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            if marked:
                inside[i] = self.keep[i] == 1 if self.keep[i] is not None else p >= 0 and inside[p]
            else:
                bad[i] = (p >= 0 and bad[p]) or self.group[i] in (6, 8, 9, 10, 14) or any(w in (2, 3, 7) for w in self.words[i])
                inside[i] = not bad[i] and (self.group[i] == 0 or (p >= 0 and inside[p]))
            good[i] = inside[i] and bool(self.text[i])
        for i in range(n - 1, 0, -1):
            good[self.parent[i]] |= good[i]
        return good


class BoostedTrees:
    """Binary classifier: complete trees of DEPTH levels on binned features, logistic loss, second-order leaf values."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned, score = self.binned(x), np.zeros(n)
        inner = (TREES, (1 << DEPTH) - 1)
        self.features, self.cuts, self.leaves = np.zeros(inner, dtype=np.int64), np.full(inner, BINS, dtype=np.int64), np.zeros((TREES, 1 << DEPTH))
        flat = binned + np.arange(width) * BINS
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(n, dtype=np.int64)
            for level in range(DEPTH):
                k, space = 1 << level, width * BINS
                at = (node[:, None] * space + flat).ravel()
                hist = [np.bincount(at, weights=np.repeat(v, width), minlength=k * space).reshape(k, width, BINS) for v in (g, h)]
                gl, hl = np.cumsum(hist[0], axis=2), np.cumsum(hist[1], axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                best = gain.reshape(k, -1).argmax(axis=1)
                f, cut = best // BINS, best % BINS
                cut = np.where(gain.reshape(k, -1).max(axis=1) > 1e-9, cut, BINS)
                self.features[t, k - 1:2 * k - 1], self.cuts[t, k - 1:2 * k - 1] = f, cut
                node = 2 * node + (binned[np.arange(n), f[node]] > cut[node])
            gs, hs = np.bincount(node, weights=g, minlength=1 << DEPTH), np.bincount(node, weights=h, minlength=1 << DEPTH)
            self.leaves[t] = RATE * gs / (hs + 1)
            score += self.leaves[t][node]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, rows, score = self.binned(x), np.arange(len(x)), np.zeros(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, features[node]] > cuts[node])
            score += leaves[node - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-score))


def skeleton(rng: random.Random, texts: list[str]) -> str:
    """A page with marked main blocks around sampled texts, in one of many layouts."""
    def words(low: int, high: int) -> str:
        some = rng.choice(texts).split()
        at = rng.randrange(max(1, len(some) - low))
        return " ".join((some[at:] or some)[:rng.randint(low, high)])

    def tag(name: str, inside: str, names: list[str] = (), keep: int | None = None) -> str:
        label = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names and rng.random() < 0.85 else ""
        return f"<{name}{label}{'' if keep is None else f' data-keep={keep}'}>{inside}</{name}>"

    def items(n: int) -> str:
        return "<ul>" + "".join(f'<li data-keep=0><a href="#">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def junk(kind: str) -> str:
        few = "".join(tag("p", words(3, 30), keep=0) for _ in range(rng.randint(1, 4)))
        if kind == "nav":
            return tag(rng.choice(["nav", "div", "div"]), items(rng.randint(3, 9)), ["menu", "main-nav", "nav", "breadcrumb", "top-menu"], 0)
        if kind == "header":
            return tag(rng.choice(["header", "div"]), tag(rng.choice(["p", "div", "h1"]), words(1, 6), keep=0) + (items(3) if rng.random() < 0.5 else ""), ["header", "masthead", "site-header", "page-head"], 0)
        if kind == "footer":
            return tag(rng.choice(["footer", "div"]), words(3, 25) if rng.random() < 0.6 else few + items(4), ["footer", "site-footer", "copyright"], 0)
        if kind == "aside":
            return tag(rng.choice(["aside", "div", "section"]), rng.choice([few, items(5), tag("h3", words(1, 4), keep=0) + items(4) + few]), ["sidebar", "widget", "related", "side", "recommended"], 0)
        if kind == "notice":
            return tag(rng.choice(["div", "section", "dialog"]), rng.choice([words(4, 30), few]) + tag("button", words(1, 2), keep=0), ["cookie-notice", "notice", "consent", "alert", "cookie-banner", "popup"], 0)
        if kind == "ad":
            return tag(rng.choice(["div", "div", "aside", "p", "section"]), rng.choice([words(3, 30), few]), ["ad", "ads", "advert", "sponsored", "promo", "ad-banner"], 0)
        if kind == "form":
            return tag("form", words(1, 12) + "<input>" + tag("button", words(1, 2), keep=0), ["search", "newsletter", "login", "subscribe"], 0)
        entry = "".join(tag(rng.choice(["div", "li", "article", "p"]), words(3, 50), ["comment", "reply", "comment-body"], 0) for _ in range(rng.randint(1, 5)))
        return tag(rng.choice(["div", "section", "ol", "aside"]), tag("h3", words(1, 3), keep=0) + entry, ["comments", "comment-list", "discussion", "replies", "respond"], 0)

    paragraphs = []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.72:
            paragraphs.append(tag("p", words(1, 90), keep=1))
        elif kind < 0.80:
            paragraphs.append(tag(rng.choice(["h2", "h3"]), words(1, 7), keep=1))
        elif kind < 0.86:
            paragraphs.append("<ul>" + "".join(f"<li data-keep=1>{words(2, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.92:
            paragraphs.append(tag("blockquote", words(5, 40), keep=1))
        elif kind < 0.96:
            paragraphs.append("<table>" + "".join(f"<tr><td data-keep=1>{words(1, 4)}</td><td data-keep=1>{words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            paragraphs.append(tag("div", words(5, 60), keep=1))
        if rng.random() < 0.15:
            paragraphs.append(junk(rng.choice(["ad", "aside", "notice", "form"])))
    title = tag("h1", words(2, 12), keep=1) if rng.random() < 0.8 else ""
    main = title + "".join(paragraphs) + (junk("comments") if rng.random() < 0.2 else "")
    form = rng.random()
    main = tag("article", main, ["post", "entry", "article"]) if form < 0.6 else tag("main", main, ["content", "main"]) if form < 0.75 else tag("div", main, ["content", "article-body", "post-text", "entry-content", "story"])
    if rng.random() < 0.3:
        main = tag(rng.choice(["div", "main", "section"]), main, ["wrapper", "container", "page", "main"])
    before = [junk(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.5]
    after = [junk(k) for k in ("comments", "aside", "ad", "form", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    return f"<html><head><title>{words(1, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def fit(samples: list[str | None]) -> BoostedTrees:
    parsed = [Page(h, False) for h in samples]
    texts = [t for p in parsed for t in p.text if t.count(" ") >= 3] or ["one two three four five six seven. Eight nine ten, eleven twelve thirteen."]
    rng = random.Random(11)
    parsed += [Page(skeleton(rng, texts)) for _ in range(SKELETONS)]
    labelled = [(p, known) for p, known in ((p, p.known()) for p in parsed) if known.any()]
    return BoostedTrees().fit(np.concatenate([p.features() for p, _ in labelled]), np.concatenate([known for _, known in labelled]).astype(np.float64))


def main_text(pages: list[Page], model: BoostedTrees) -> list[str]:
    if not pages:
        return []
    x = [p.features() for p in pages]
    scores = np.split(model.predict(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
    return ["\n".join(t for t, keep in zip(p.text, p.decoded(s)) if keep and t) for p, s in zip(pages, scores)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main blocks in page order, joined by line ends.

    A null, empty or contentless page has an empty text. Head, scripts and styles are never text. Unclosed and
    stray tags are taken as browsers do in the common cases. Repeated pages each get a row; other columns are ignored.
    """
    total = pages.count()
    share = 1 << 20 if total <= SAMPLE_PAGES else max(1, (SAMPLE_PAGES << 20) // total)
    sample = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share).select("html").orderBy(F.xxhash64("html")).limit(2 * SAMPLE_PAGES).collect()      # bounded
    model = pages.sparkSession.sparkContext.broadcast(fit([r["html"] for r in sample]))

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = main_text([Page(h, False) for h in part.column("html").to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long")
