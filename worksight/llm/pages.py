"""HTML main-text extraction: boosted trees judge the nodes of a page's tree, and a hierarchical decoding picks what to keep."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship

ship(__name__)
#: Elements without content, elements whose content is no text, elements inside a line of text, and for an
#: element the open ones that its start ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg math iframe select option object canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "body": {"html"}}
#: Tokens of class, id and role (by their beginnings; up to three letters, as they are) and what they speak for.
LEXICON = {
    "content": "article content post entry story main body text prose hentry page read blog news document chapter",
    "menu": "nav navbar navigation menu breadcrumb crumb tabs toolbar pagination pager sitemap skip topbar toc",
    "head": "header masthead brand logo banner hero top",
    "foot": "footer copyright legal colophon bottom imprint",
    "side": "sidebar aside side related recommend widget rail more popular trending tags",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promoted promotion dfp outbrain taboola commercial",
    "notice": "cookie consent notice alert popup modal overlay gdpr newsletter subscribe signup paywall warning message toast",
    "comment": "comment comments reply replies discussion respond discuss thread disqus reader feedback review",
    "form": "form search login signin register contact input field button share social follow",
}
_KINDS = list(LEXICON)
_STEMS = [(stem, k) for k, words in enumerate(LEXICON.values()) for stem in words.split()]
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details".split()
_TAG = {t: k for k, t in enumerate(TAGS)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_ENDS = re.compile("[>\"']")
#: Where the content of a RAW element ends: at its end tag. An option, whose end tag may be left out, ends before what can't be in it.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_RAW_END["option"] = re.compile(rf"</option(?=[\s/>]|\Z)[^>]*(?:>|\Z)|(?=</?(?:option|optgroup|select|datalist|body|html|{'|'.join(sorted(CLOSES_P | set(ENDS)))})[\s/>])", re.I)
_MARKS = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_memo: dict = {}


def kinds_of(attributes: str) -> tuple[int, ...]:
    """What the element's class, id, role, itemprop and label speak for: indexes of LEXICON."""
    if attributes not in _memo:
        found = set()
        for m in _MARKS.finditer(attributes):
            for word in _WORD.findall(_CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "")):
                word = word.lower()
                found |= {k for stem, k in _STEMS if word == stem or len(stem) > 3 and word.startswith(stem)}
        if _HIDDEN.search(attributes):
            found.add(_KINDS.index("notice"))
        if len(_memo) > 20_000:
            _memo.clear()
        _memo[attributes] = tuple(sorted(found))
    return _memo[attributes]


class TagEnds:
    """Where the tags of a page end: at the first `>` outside quotes or, where a quote has no end, at the first of all. Quotes from which no
    end is reached are remembered, so a page is looked through once however many there are."""

    def __init__(self, source: str):
        self.source, self.lost = source, {source.rfind(q) for q in "\"'"}

    def of(self, at: int) -> int:
        """The place of the `>` of the tag whose name ends before `at`; -1 if none is left."""
        seen, look = [], at
        while m := _ENDS.search(self.source, look):
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if m.start() in self.lost:
                break
            look = self.source.find(m[0], m.end()) + 1
        self.lost.update(seen)
        return self.source.find(">", at)


class Page:
    """The tree of a page's block elements: parallel lists by node. Text runs belong to the innermost block element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.kinds, self.children = ["html"], [-1], [0], [()], [[]]
        self.chars, self.link_chars, self.stops, self.elements, self.controls = [0], [0], [0], [1], [0]
        self.runs: list[tuple[int, list[str]]] = []  # node, pieces
        stack: list[tuple[str, int]] = [("html", 0)]
        at, links, fresh, look, opened, ends = 0, 0, True, 0, Counter(), TagEnds(source)

        def text(piece: str) -> None:
            nonlocal fresh
            node = stack[-1][1]
            if fresh or not self.runs or self.runs[-1][0] != node:
                if not piece.strip():
                    return
                self.runs.append((node, []))
                fresh = False
            self.runs[-1][1].append(piece)
            n = len(piece.strip())
            self.chars[node] += n
            self.stops[node] += piece.count(". ") + piece.count(", ") + piece.rstrip().endswith(".")
            if links:
                self.link_chars[node] += n

        def close(k: int) -> None:
            nonlocal links, fresh
            for name, _ in stack[k:]:
                opened[name] -= 1
                links -= name == "a"
                fresh = fresh or name not in INLINE
            del stack[k:]

        endless: set[str] = set()
        while m := _TOKEN.search(source, look):
            if m.start() > at:
                text(source[at : m.start()])
            if not m[2]:
                at = look = m.end()
                continue
            if (end := ends.of(m.end())) < 0:
                at = len(source)  # a tag that the page breaks off in is no text
                break
            rest, at, look = source[m.end() : end], end + 1, end + 1
            name = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1 if opened[name] else 0, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                continue
            node = stack[-1][1]
            self.elements[node] += 1
            if name in RAW:
                self.controls[node] += name in ("select", "textarea", "option")
                if not rest.endswith("/") and name not in endless:
                    if end := _RAW_END[name].search(source, at):
                        at = look = end.end()
                    else:  # the element ends at once, and so do all later ones of its name
                        endless.add(name)
                continue
            if name in VOID:
                if name == "br":
                    text(" ")
                fresh = fresh or name == "hr"
                self.controls[node] += name == "input"
                continue
            if name in INLINE or name == "button":
                links += name == "a"
                self.controls[node] += name == "button"
                stack.append((name, node))
                opened[name] += 1
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1 if opened["p"] else 0, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name in ENDS:
                for k in range(len(stack) - 1 if any(opened[e] for e in ENDS[name]) else 0, 0, -1):
                    if stack[k][0] in ENDS[name]:
                        close(k)
                    elif stack[k][0] in SCOPES[name]:
                        break
            node = stack[-1][1]
            fresh = True
            self.tag.append(name)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.kinds.append(kinds_of(rest) if rest else ())
            self.children.append([])
            self.children[node].append(len(self.tag) - 1)
            for column, value in ((self.chars, 0), (self.link_chars, 0), (self.stops, 0), (self.elements, 1), (self.controls, 0)):
                column.append(value)
            stack.append((name, len(self.tag) - 1))
            opened[name] += 1
        if at < len(source):
            text(source[at:])

    def features(self) -> np.ndarray:
        """A row for each node: its element, its attribute tokens and those above it, sizes and densities of its subtree and its
        own text, depth, and how it stands among its siblings."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.array([self.chars, self.link_chars, self.stops, self.elements, self.controls], float)
        total = own.copy()
        heads = np.zeros(n)
        for k in range(n - 1, 0, -1):
            total[:, parent[k]] += total[:, k]
        marks, above = np.zeros((n, len(_KINDS))), np.zeros((n, len(_KINDS)))
        tags = np.array([_TAG.get(t, len(TAGS)) for t in self.tag])
        paragraphs, order, same, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        sectional = np.zeros((n, 6))
        for k in range(n):
            for x in self.kinds[k]:
                marks[k, x] = 1
            if k:
                above[k] = np.maximum(above[parent[k]], marks[parent[k]])
                sectional[k] = sectional[parent[k]]
            place = ("nav", "header", "footer", "aside", "form", "article").index(self.tag[k]) if self.tag[k] in ("nav", "header", "footer", "aside", "form", "article") else -1
            if place >= 0:
                sectional[k, place] = 1
            seen: dict[str, int] = {}
            for position, c in enumerate(self.children[k]):
                seen[self.tag[c]] = seen.get(self.tag[c], 0) + 1
                order[c] = position
                heads[k] += self.tag[c] in ("h1", "h2", "h3")
                before[c] = self.chars[self.children[k][position - 1]] if position else 0
            paragraphs[k] = seen.get("p", 0)
            for c in self.children[k]:
                same[c] = seen[self.tag[c]]
        width = np.array([len(c) for c in self.children], float)
        page = max(1.0, total[0, 0])
        offset = np.cumsum(own[0]) - own[0]
        sibling_text = np.where(parent >= 0, total[0, parent], page)
        numbers = [
            np.log1p(total[0]), np.log1p(own[0]), total[1] / np.maximum(1, total[0]), total[0] / total[3], total[2] / np.maximum(1, total[0] / 100), np.log1p(total[3]),
            np.log1p(total[4]), np.array(self.depth), order, np.log1p(same), np.log1p(width), np.log1p(paragraphs), heads, total[0] / page, total[0] / np.maximum(1, sibling_text),
            offset / page, np.log1p(before), (np.array([t in INLINE for t in self.tag])).astype(float), np.where(parent >= 0, tags[parent], -1), tags,
        ]
        return np.concatenate([np.stack(numbers, axis=1), marks, above, sectional], axis=1)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The choice of kept nodes with the greatest sum of log-odds (minus those of dropped nodes) in which a kept node has
        only kept ancestors."""
        n = len(self.tag)
        kept, dropped = odds.astype(float).copy(), -odds.astype(float)
        for k in range(n - 1, 0, -1):
            kept[self.parent[k]] += max(kept[k], dropped[k])
            dropped[self.parent[k]] += dropped[k]
        out = np.zeros(n, bool)
        out[0] = kept[0] > dropped[0]
        for k in range(1, n):
            out[k] = out[self.parent[k]] and kept[k] > dropped[k]
        return out

    def text(self, keep: np.ndarray) -> str:
        blocks = []
        for node, pieces in self.runs:
            if keep[node]:
                run = "".join(pieces)
                run = " ".join((html.unescape(run) if "&" in run else run).split())
                if run:
                    blocks.append(run)
        return "\n".join(blocks)


#: Gradient boosting: trees, their depth, shrinkage, bins of a feature, ridge on leaves.
TREES, DEPTH, SHRINK, BINS, RIDGE = 90, 5, 0.2, 32, 1.0


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of depth DEPTH on binned features for the logistic loss, each leaf a Newton step. A tree is full: at every node of
    a level the best of all splits, so a row's leaf is found by DEPTH comparisons."""
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    base, trees = float(score[0]), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        splits = []
        for level in range(DEPTH):
            width = 1 << level
            feature, cut, gain = np.zeros(width, int), np.zeros(width, int), np.full(width, -1.0)
            for f in range(x.shape[1]):
                place = node * BINS + binned[:, f]
                sg = np.bincount(place, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(place, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                value = sg**2 / (sh + RIDGE) + (tg - sg) ** 2 / (th - sh + RIDGE)
                best = value.argmax(axis=1)
                top = value[np.arange(width), best]
                better = top > gain + 1e-9
                feature[better], cut[better], gain[better] = f, best[better], top[better]
            splits.append((feature, cut))
            node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = SHRINK * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + RIDGE)
        score += leaf[node]
        trees.append((splits, leaf))
    return {"edges": edges, "base": base, "trees": trees}


def judge(model: dict, x: np.ndarray) -> np.ndarray:
    """The log-odds of each row."""
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model["edges"])], axis=1)
    score, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for feature, cut in splits:
            node = node * 2 + (binned[rows, feature[node]] > cut[node])
        score += leaf[node]
    return score


#: The model is fitted on so many pages that are composed here: real pages come without marks of what is main text.
LESSONS = 1500
_OPEN, _SHUT = "\ue000", "\ue001"  # around the main text of a composed page


def lesson(rng: np.random.Generator) -> str:
    """A page of random layout whose main text is marked: an article in one of many containers, among menus, headers, footers,
    sidebars, notices, adverts, forms and comments, in elements of their own or in plain ones with telling or no names."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("abcdefghilmnoprstuvz") for _ in range(int(rng.integers(2, 9))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high))))

    def prose(low: int, high: int) -> str:
        if chance(0.15):
            return words(1, 6).capitalize() + "."
        text = ""
        for _ in range(int(rng.integers(low, high))):
            text += words(3, 18).capitalize() + (", " + words(2, 8) if chance(0.4) else "") + pick(". . . ! ?".split()) + " "
        if chance(0.08):
            text = "!! ".join(text.upper().split())
        return text.strip() or words(2, 6)

    def named(kind: str, telling: float = 0.75) -> str:
        if not chance(telling):
            return pick(["", "", f' class="{word()}"', f' id="{word()}"'])
        name = pick(LEXICON[kind].split())
        name = pick([name, f"{name}-{word()}", f"{word()}-{name}", f"{name} {word()}", name.capitalize()])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def linked(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}{pick(["", "", ".", ","])}</a></li>' for _ in range(n))

    def boiler(kind: str) -> str:
        own = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        tag, name = (own, named(kind, 0.3)) if own and chance(0.55) else (pick(["div", "div", "section", "ul" if kind == "menu" else "div"]), named(kind, 0.97))
        inner = {
            "menu": lambda: pick([f"<ul>{linked(int(rng.integers(2, 9)))}</ul>", linked(int(rng.integers(2, 9))), " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(5))]),
            "head": lambda: pick([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 6)}</p>", f'<a href="/">{word()}</a>', f"<span>{words(1, 3)}</span><p>{words(3, 8)}</p>"]),
            "foot": lambda: pick([f"&copy; {word()}.{word()} &middot; {prose(1, 3)}", f"<p>&copy; 20{int(rng.integers(10, 30))} {words(2, 6)}</p><ul>{linked(3)}</ul>", f"<p>{prose(1, 3)}</p>"]),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + pick([f"<ul>{linked(4)}</ul>", f"<p>{prose(1, 3)}</p>", f"<ul><li>{words(2, 6)}</li><li>{words(2, 6)}</li></ul>"]),
            "advert": lambda: pick([prose(1, 3), f"<p>{prose(1, 3)}</p>", f'<a href="/{word()}">{words(2, 8)}</a>', f"<p>{prose(1, 4)}</p><p>{words(2, 5)}</p>"]),
            "notice": lambda: pick([prose(1, 3), f"<p>{prose(1, 3)}</p><button>{word()}</button>", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>"]),
            "comment": lambda: "".join(pick([f"<p>{prose(1, 3)}</p>", f'<div{named("comment", 0.6)}><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<li>{prose(1, 3)}</li>"]) for _ in range(int(rng.integers(1, 6)))),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>" + (f"<p>{prose(1, 2)}</p>" if chance(0.4) else ""),
        }[kind]()
        return f"<{tag}{name}>{inner}</{tag}>"

    def inline(text: str) -> str:
        parts = text.split(" ")
        if chance(0.25) and len(parts) > 4:
            k = int(rng.integers(len(parts) - 2))
            t = pick(["b", "i", "em", "strong", "span", "code"])
            parts[k] = pick([f"<{t}>{parts[k]}</{t}>", f'<a href="/{word()}">{parts[k]}</a>', f"<{t}>{parts[k]}" if chance(0.3) else parts[k]])
        return " ".join(parts)

    def main() -> str:
        out = [pick(["", f"<h1>{words(2, 9)}</h1>", f"<h1>{words(2, 9)}</h1>", f"<h2>{words(2, 9)}</h2>"])]
        bare, brief = chance(0.12), chance(0.06)
        if brief:
            out.append(f"<p>{inline(words(1, 6))}.</p>")
        for _ in range(0 if brief else int(rng.integers(1, 9))):
            kind = rng.random()
            if bare:
                out.append(f"{inline(prose(1, 6))}<br>" if chance(0.7) else f"<div>{inline(prose(1, 6))}</div>")
            elif kind < 0.72:
                out.append(f"<p>{inline(prose(1, 8))}" + ("</p>" if chance(0.9) else ""))
            elif kind < 0.8:
                out.append(f"<{pick(['h2', 'h3'])}>{words(1, 6)}</{pick(['h2', 'h3'])}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{inline(prose(1, 2))}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre>{words(3, 20)}</pre>")
        text = _OPEN + f"{_SHUT}{_OPEN}".join(out) + _SHUT
        for _ in range(int(rng.integers(0, 3)) if chance(0.35) else 0):
            extra = boiler(pick(["advert", "side", "notice", "form", "menu", "comment"]))
            places = [m.start() for m in re.finditer(f"{_SHUT}{_OPEN}", text)]
            spot = pick(places) + 1 if places and chance(0.6) else len(text)
            text = text[:spot] + extra + text[spot:]
        return text

    tag, name = pick([("article", ""), ("article", ""), ("article", named("content")), ("main", ""), ("div", named("content", 0.8)), ("section", named("content", 0.6)), ("td", ""), ("div", "")])
    article = f"<{tag}{name}>{main()}</{tag}>" if tag != "td" else f"<table><tr><td>{main()}</td></tr></table>"
    for _ in range(int(rng.integers(0, 3))):
        article = f"<{pick(['div', 'div', 'main', 'section'])}{named('content', 0.3)}>{boiler(pick(['menu', 'head', 'advert'])) if chance(0.3) else ''}{article}{boiler(pick(['side', 'comment', 'advert', 'form'])) if chance(0.4) else ''}</div>"
    if chance(0.04):
        return main()
    before = "".join(boiler(pick(["menu", "head", "advert", "notice", "form", "menu", "side"])) for _ in range(int(rng.integers(0, 5))))
    after = "".join(boiler(pick(["side", "comment", "comment", "foot", "advert", "notice", "form"])) for _ in range(int(rng.integers(0, 4)))) + (boiler("foot") if chance(0.7) else "")
    head = f"<head><title>{words(2, 6)}</title><script>var t='</p>';</script></head>" if chance(0.8) else ""
    return f"<!DOCTYPE html><html>{head}<body{named('content', 0.1)}>{before}{article}{after}" + ("</body></html>" if chance(0.9) else "")


def lessons(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the nodes of composed pages: 1 if there is main text in the node."""
    rng, x, y = np.random.default_rng(seed), [], []
    for _ in range(pages):
        page = Page(lesson(rng))
        label, marked = np.zeros(len(page.tag)), False
        for node, pieces in page.runs:
            run = "".join(pieces)
            inside = False
            for c in re.split(f"([{_OPEN}{_SHUT}])", run):
                if c == _OPEN or c == _SHUT:
                    marked = c == _OPEN
                elif marked and c.strip():
                    inside = True
            while inside and node >= 0 and not label[node]:
                label[node] = 1
                node = page.parent[node]
        x.append(page.features())
        y.append(label)
    return np.concatenate(x), np.concatenate(y)


def train(pages: int = LESSONS, seed: int = 17) -> dict:
    return boost(*lessons(pages, seed))


def main_texts(model: dict, sources: list[str | None]) -> list[str]:
    """The main text of each page; empty for null and empty ones. Trees see the nodes of all pages at once."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    odds = judge(model, np.concatenate([p.features() for p in pages]))
    ends = np.cumsum([len(p.tag) for p in pages])
    return [p.text(p.decode(odds[b - len(p.tag) : b])) for p, b in zip(pages, ends, strict=True)]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Blocks are runs of text in one block element; character references are decoded, white space becomes one space. A null,
    empty or textless page has an empty text; broken markup is read as far as it goes; repeated rows give equal rows; an empty
    table gives an empty result; other columns are not read."""
    model = model or train()
    columns = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = main_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = StructType([columns.schema["page_id"], columns.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return columns.mapInArrow(run, schema)
