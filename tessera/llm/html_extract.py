"""HTML main-text extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

A page becomes its block elements with features (subtree density, attribute tokens, depth, sibling
statistics); boosted trees give each a probability of being main text; dynamic programming over the
tree picks the best consistent choice, in which main text starts at a node, holds below it, and what
is cut out inside never comes back. The trees are trained in numpy on generated pages whose parts are known.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var center-inline".split())
CONTROLS = frozenset("input button select option optgroup datalist textarea".split())
HIDDEN = frozenset("head script style title template noscript iframe svg math object select button textarea datalist audio video canvas xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
KINDS = [frozenset(x.split()) for x in ("article main", "p", "h1 h2 h3 h4 h5 h6", "li ul ol dl dt dd menu", "div section", "nav", "header", "footer", "aside", "form fieldset", "table tr td th tbody", "blockquote pre figure figcaption", "body html")]
# Tokens of class, id and role attributes by what they tell.
FAMILIES = [
    frozenset(x.split())
    for x in (
        "article content post entry story main body text prose copy maintext articlebody page hentry richtext",
        "nav navigation navbar menu menubar breadcrumb breadcrumbs topbar toc pagination pager submenu links",
        "header masthead banner hero logo branding topline site",
        "footer copyright colophon bottom legal imprint credits",
        "sidebar aside rail widget widgets secondary related recommended more side trending popular recent tags",
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense commercial dfp outbrain taboola",
        "cookie cookies notice consent gdpr alert popup modal overlay disclaimer privacy warning announcement message",
        "comment comments commentlist reply replies discussion respond disqus reader readers feedback review thread",
        "form search login signup subscribe newsletter signin register contact input poll",
        "share social sharing follow facebook twitter meta byline author date tools print actions buttons",
    )
]
TOKEN = {t: k for k, family in enumerate(FAMILIES) for t in family}
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?/][^>]*>", re.S)
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
STOPS = re.compile(r"[.,;:!?]")

_N_TOKENS = len(FAMILIES)
N_FEATURES = 18 + len(KINDS) + 2 * _N_TOKENS + len(KINDS)


@lru_cache(4096)
def _families(attributes: str) -> tuple[int, ...]:
    found = set()
    for groups in ATTRIBUTES.findall(attributes):
        for token in CAMEL.findall("".join(groups)):
            token = token.lower()
            family = TOKEN.get(token, TOKEN.get(token.rstrip("s")))
            if family is None:
                for stem, k in (("comment", 7), ("sidebar", 4), ("nav", 1), ("foot", 3), ("advert", 5), ("sponsor", 5), ("cookie", 6), ("header", 2), ("newsletter", 8), ("menu", 1), ("content", 0), ("article", 0)):
                    if token.startswith(stem) or token.endswith(stem):
                        family = k
                        break
            if family is not None:
                found.add(family)
    return tuple(sorted(found))


_KIND_OF = {t: k for k, kind in enumerate(KINDS) for t in kind}


class Page:
    """The block elements of a page in document order, and its pieces of text with their elements.

    A piece is (node, text) with references decoded; a break between blocks is a piece of one space.
    """

    __slots__ = ("children", "controls", "families", "hidden", "items", "labels", "links", "parents", "pieces", "tags")

    def __init__(self, source: str, marks: bool = False):
        self.parents, self.tags, self.families, self.children = [-1], ["html"], [()], [[]]
        self.links, self.controls, self.items, self.hidden = [0], [0], [0], [False]
        self.labels = [0] if marks else None
        self.pieces: list[tuple[int, str]] = []
        stack, names, inline_links = [0], ["html"], 0
        standing: Counter = Counter(names)  # of the open elements, so that none is looked for in vain
        pattern = TAG if source.count('"') % 2 == 0 and source.count("'") % 2 == 0 else LOOSE
        at, skip = 0, None
        pieces = self.pieces

        def close(k: int) -> None:
            for name in names[k:]:
                standing[name] -= 1
            del names[k:], stack[k:]

        def put(text: str) -> None:
            if not text:
                return
            if "&" in text:
                text = html.unescape(text)
            node = stack[-1]
            pieces.append((node, text))
            if inline_links > 0:
                self.links[node] += len(text)

        for m in pattern.finditer(source):
            start = m.start()
            if skip is not None:
                if m[2] is None or not m[1] or m[2].lower() != skip:
                    continue
                skip, at = None, m.end()
                continue
            if start > at:
                put(source[at:start])
            elif start < at:
                continue
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    inline_links = max(0, inline_links - 1)
                elif tag in INLINE:
                    continue
                elif standing[tag] and len(names) > 1:
                    pieces.append((stack[-1], " "))
                    k = len(names) - 1
                    while names[k] != tag and k > 1:
                        k -= 1
                    close(k)
                    inline_links = 0
                    pieces.append((stack[-1], " "))
                continue
            if tag in CONTROLS:
                self.controls[stack[-1]] += 1
            if tag in VOID:
                if tag in ("br", "hr"):
                    pieces.append((stack[-1], " "))
                continue
            if tag in RAW:
                if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                    skip = tag
                continue
            if tag == "a":
                inline_links += 1
                self.items[stack[-1]] += 1
                continue
            if tag in INLINE:
                continue
            if tag == "html":
                continue
            if tag in CLOSES_P and standing["p"]:
                k = len(names) - 1
                while names[k] != "p":
                    k -= 1
                if not any(x in ("td", "th", "button", "object") for x in names[k:]):
                    close(k)
                    inline_links = 0
            if tag in CLOSED_BY and any(standing[x] for x in CLOSED_BY[tag]):
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in CLOSED_BY[tag]:
                        if tag in ("td", "th", "li", "dt", "dd") or names[k] == "tr" or tag in ("tbody", "tfoot"):
                            close(k)
                            if tag in ("td", "th", "li", "dt", "dd"):
                                break
                            continue
                        close(k)
                    elif names[k] in ("ul", "ol", "dl", "table", "menu"):
                        break
            node = len(self.parents)
            parent = stack[-1]
            pieces.append((parent, " "))
            self.parents.append(parent)
            self.tags.append(tag)
            self.families.append(_families(m[3]) if m[3] else ())
            self.children.append([])
            self.children[parent].append(node)
            self.links.append(0)
            self.controls.append(0)
            self.items.append(0)
            self.hidden.append(self.hidden[parent] or tag in HIDDEN)
            if marks:
                label = re.search(r"data-main=(\d)", m[3])
                self.labels.append(int(label[1]) if label else self.labels[parent])
            stack.append(node)
            names.append(tag)
            standing[tag] += 1
        if skip is None and at < len(source):
            put(source[at:])

    def features(self) -> np.ndarray:
        n = len(self.parents)
        own, stops, words = [0] * n, [0] * n, [0] * n
        first, last, total = [-1] * n, [0] * n, 0
        for node, text in self.pieces:
            if text == " " or self.hidden[node]:
                continue
            size = len(text.strip())
            if not size:
                continue
            own[node] += size
            stops[node] += len(STOPS.findall(text))
            words[node] += text.count(" ") + 1
            if first[node] < 0:
                first[node] = total
            total += size
            last[node] = total
        chars, links, marks, said = own[:], self.links[:], stops[:], words[:]
        size, paragraphs, items, controls = [1] * n, [0] * n, [0] * n, self.controls[:]
        anchors = self.items[:]
        parents, tags = self.parents, self.tags
        for k in range(n - 1, 0, -1):
            p = parents[k]
            if tags[k] == "p":
                paragraphs[k] += 1
            elif tags[k] == "li":
                items[k] += 1
            chars[p] += chars[k]
            links[p] += links[k]
            marks[p] += marks[k]
            said[p] += said[k]
            size[p] += size[k]
            paragraphs[p] += paragraphs[k]
            items[p] += items[k]
            controls[p] += controls[k]
            anchors[p] += anchors[k]
            if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
                first[p] = first[k]
        x = np.zeros((n, N_FEATURES), np.float32)
        up = 18 + len(KINDS)
        depth = [0] * n
        place, peers, alike = [0.0] * n, [1] * n, [1.0] * n
        for p, below in enumerate(self.children):
            if below:
                m = len(below)
                kinds: dict[str, int] = {}
                for c in below:
                    kinds[tags[c]] = kinds.get(tags[c], 0) + 1
                for i, c in enumerate(below):
                    depth[c] = depth[p] + 1
                    place[c], peers[c], alike[c] = i / m, m, kinds[tags[c]] / m
        for k in range(n):
            p = parents[k]
            if k:
                x[k, up:] = x[p, up:]  # what the ancestors are
            kind = _KIND_OF.get(tags[k])
            if kind is not None:
                x[k, 18 + kind] = 1
                x[k, up + 2 * _N_TOKENS + kind] = 1
            for f in self.families[k]:
                x[k, up + f] = 1
        # of the node itself, apart from its ancestors
        own_tokens = x[:, up + _N_TOKENS : up + 2 * _N_TOKENS]
        own_tokens[:] = 0
        for k, found in enumerate(self.families):
            for f in found:
                own_tokens[k, f] = 1
        c, l_, s = np.array(chars, np.float32), np.array(links, np.float32), np.array(size, np.float32)
        share = c / max(1, total)
        parent = np.maximum(np.array(parents), 0)
        some = np.maximum(c, 1)
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = depth, np.log1p(c), np.log1p(own), np.minimum(l_ / some, 1)
        x[:, 4], x[:, 5], x[:, 6], x[:, 7] = np.log1p(s), np.log1p(c / s), peers, place
        x[:, 8], x[:, 9], x[:, 10], x[:, 11] = alike, share, np.array(marks) / some, c / np.maximum(said, 1)
        x[:, 12], x[:, 13], x[:, 14] = np.array(first) / max(1, total), x[parent, 3], share[parent]
        x[:, 15], x[:, 16], x[:, 17] = np.log1p(paragraphs), np.log1p(np.array(anchors) + np.array(items)), np.log1p(controls)
        return x

    def text(self, main: list[bool]) -> str:
        """The words of main nodes, one space for any white space within and between blocks."""
        hidden = self.hidden
        return " ".join("".join([t if main[k] and not hidden[k] else " " for k, t in self.pieces]).split())


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """The best consistent choice of main nodes: outside, then main, then cut out, down every path.

    A node adds its log odds, weighted by the text that is its own, if it is main and nothing otherwise.
    """
    n = len(page.parents)
    own = np.zeros(n)
    for k, t in page.pieces:
        own[k] += len(t)
    gain = (logits * (1 + np.log1p(own))).tolist()
    parents = page.parents
    outside, main = [0.0] * n, gain
    for k in range(n - 1, 0, -1):
        p = parents[k]
        outside[p] += max(outside[k], main[k])
        main[p] += max(main[k], 0.0)
    state = [0] * n  # 0 outside, 1 main, 2 cut out
    state[0] = 1 if main[0] > outside[0] else 0
    for k in range(1, n):
        above = state[parents[k]]
        state[k] = (1 if main[k] > outside[k] else 0) if above == 0 else (1 if above == 1 and main[k] >= 0 else 2)
    return [s == 1 for s in state]


class Boosted:
    """Gradient-boosted trees of one depth for log odds, as arrays."""

    def __init__(self, depth: int = 4, trees: int = 40, rate: float = 0.3, bins: int = 24):
        self.depth, self.trees, self.rate, self.bins = depth, trees, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        inner = 2**self.depth - 1
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)
        width, k_all = self.bins + 1, x.shape[1]
        flat = b + np.arange(k_all) * width
        score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        self.start = float(score[0])
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf, np.float32)
        self.value = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                nodes, offset = 2**level, 2**level - 1
                at = ((node - offset)[:, None] * (k_all * width) + flat).ravel()
                gs = np.bincount(at, np.repeat(g, k_all), nodes * k_all * width).reshape(nodes, k_all, width)
                hs = np.bincount(at, np.repeat(h, k_all), nodes * k_all * width).reshape(nodes, k_all, width)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                for i in range(nodes):
                    k, cut = divmod(int(best[i]), width)
                    if gain[i, k, cut] > 1e-6 and cut < len(self.cuts[k]):
                        self.feature[t, offset + i], self.cut[t, offset + i] = k, self.cuts[k][cut]
                node = 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            self.value[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            score += self.value[t][leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def generated_page(r: np.random.Generator) -> str:
    """A page whose elements say by data-main whether they are main text; the attribute is no feature."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    chance = lambda p: r.random() < p

    def words(low: int, high: int) -> str:
        out = []
        for _ in range(int(r.integers(low, high + 1))):
            out.append("".join(pick("th", "er", "on", "an", "re", "le", "qu", "ci", "en", "ü", "é", "st", "in", "ou") for _ in range(int(r.integers(1, 5)))) + (pick(",", ".", ".", "") if chance(0.25) else ""))
        return " ".join(out)

    def attr(*tokens: str) -> str:
        if not tokens or chance(0.15):
            return ""
        token = pick(*tokens)
        if chance(0.3):
            token += pick("-wrapper", "-inner", "_box", "-1", " clearfix", "-area", "-block", " col-md-8", "s")
        return f' {pick("class", "class", "id")}="{token}"'

    def paragraph() -> str:
        body = words(1, 120) if chance(0.9) else words(120, 900)
        if chance(0.3):
            body = f"<b>{words(1, 8)}</b> {body}"
        if chance(0.2):
            body += f' <a href="/x">{words(1, 4)}</a> {words(0, 12)}'
        if chance(0.08):
            body = f"<b>{body}<br>"
        return f"<p>{body}" + ("</p>" if chance(0.9) else "")

    def link_list(low: int, high: int) -> str:
        items = [f'<a href="/{k}">{words(1, 3)}</a>' for k in range(int(r.integers(low, high)))]
        return pick("".join(f"<li>{i}</li>" for i in items), "".join(items), " | ".join(items)) if chance(0.3) else "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"

    def nav(main: int = 0) -> str:
        tag, tokens = pick(("nav", ("menu", "navigation", "main-nav", "")), ("div", ("nav", "menu", "navbar", "breadcrumbs", "top-menu")), ("ul", ("menu", "nav")))
        return f"<{tag}{attr(*tokens)} data-main=0>{link_list(2, 12)}</{tag}>"

    def advert() -> str:
        tag = pick("div", "div", "aside", "section", "p")
        return f'<{tag}{pick(attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"), " class=ad", " class=advert")} data-main=0>{pick(words(2, 30), f"<a href=/>{words(2, 20)}</a>", f"<p>{words(3, 40)}</p>")}</{tag}>'

    def notice() -> str:
        tag = pick("div", "section", "aside", "div")
        return f'<{tag} {pick("class", "id")}="{pick("cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "site-notice", "cookies", "disclaimer")}" data-main=0><p>{words(5, 60)}</p>{pick("", f"<button>{words(1, 2)}</button>")}</{tag}>'

    def form() -> str:
        fields = "".join(f'<label>{words(1, 3)}</label><input name="{k}">' for k in range(int(r.integers(1, 5))))
        return f'<form{attr("search", "newsletter", "subscribe", "login-form", "contact-form")} data-main=0>{pick("", f"<p>{words(3, 25)}</p>", f"<h3>{words(1, 4)}</h3>")}{fields}<button>{words(1, 2)}</button></form>'

    def sidebar() -> str:
        tag = pick("aside", "div", "section", "aside")
        tokens = ("sidebar", "widget", "rail", "related", "secondary", "side", "right-sidebar", "recent-posts", "trending")
        parts = [pick(f"<h3>{words(1, 4)}</h3>{link_list(2, 8)}", f"<p>{words(5, 60)}</p>", f"<h4>{words(1, 3)}</h4><p>{words(5, 40)}</p>", advert()) for _ in range(int(r.integers(1, 4)))]
        mark = attr(*tokens) if tag == "aside" else f' class="{pick(*tokens)}"'
        return f"<{tag}{mark} data-main=0>{''.join(parts)}</{tag}>"

    def comments() -> str:
        one = lambda: f'<{(t := pick("div", "li", "article"))}{attr("comment", "reply", "comment-item")}><p>{words(3, 80)}</p></{t}>'
        return f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "responses comments", "reader-comments", "replies")}" data-main=0>{pick("", f"<h3>{words(1, 3)}</h3>")}{"".join(one() for _ in range(int(r.integers(1, 7))))}{form() if chance(0.3) else ""}</{t}>'

    def share() -> str:
        return f'<div class="{pick("share", "social", "sharing", "share-buttons", "post-meta", "tags")}" data-main=0>{link_list(1, 5)}</div>'

    def header() -> str:
        inside = pick(f"<h1>{words(1, 4)}</h1>", f'<a href="/">{words(1, 3)}</a>', f'<div class="logo">{words(1, 3)}</div>') + (nav() if chance(0.6) else "") + (form() if chance(0.2) else "") + (f"<p>{words(2, 10)}</p>" if chance(0.3) else "")
        return pick(f"<header{attr('site-header', 'masthead', 'header')} data-main=0>{inside}</header>", f'<div class="{pick("header", "masthead", "site-header", "topbar")}" data-main=0>{inside}</div>')

    def footer() -> str:
        inside = pick(f"&copy; {words(1, 3)} &middot; {words(2, 40)}", f"<p>{words(2, 30)}</p>", link_list(2, 9), f"<p>&copy; {words(1, 6)}</p>{link_list(1, 5)}")
        return pick(f"<footer{attr('footer', 'site-footer')} data-main=0>{inside}</footer>", f"<footer data-main=0>{inside}</footer>", f'<div {pick("class", "id")}="{pick("footer", "site-footer", "copyright", "bottom")}" data-main=0>{inside}</div>')

    def article() -> str:
        parts = []
        title = f"<h1>{words(1, 12)}</h1>"
        if chance(0.85):
            parts.append(pick(title, title, f"<header>{title}</header>", f"<h2>{words(1, 10)}</h2>"))
        for _ in range(int(r.integers(0, 16)) if chance(0.8) else int(r.integers(16, 40))):
            kind = r.random()
            if kind < 0.7:
                parts.append(paragraph())
            elif kind < 0.77:
                parts.append(f"<h{pick(2, 3, 4)}>{words(1, 8)}</h2>")
            elif kind < 0.82:
                parts.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{words(1, 25)}</li>" for _ in range(int(r.integers(1, 7)))) + f"</{t}>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{pick(words(5, 60), paragraph())}</blockquote>")
            elif kind < 0.89:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(r.integers(1, 5)))) + "</table>")
            elif kind < 0.92:
                parts.append(f"<figure><img src=x><figcaption>{words(1, 15)}</figcaption></figure>")
            elif kind < 0.95:
                parts.append(f"<div>{paragraph()}{paragraph()}</div>")
            else:
                parts.append(pick(advert, share, sidebar, form, notice, nav)())
        inside = "".join(parts) or paragraph()
        form_ = r.random()
        if form_ < 0.45:
            return f"<article{attr('post', 'entry', '', 'story', 'hentry')} data-main=1>{inside}</article>"
        if form_ < 0.6:
            return f"<main{attr('content', '')} data-main=1>{inside}</main>"
        if form_ < 0.92:
            return f'<{(t := pick("div", "section", "div"))}{pick(attr("content", "post-body", "article", "entry-content", "story-body", "main", "text", "prose", "post"), " itemprop=articleBody", "")} data-main=1>{inside}</{t}>'
        return f"<table><tr><td data-main=1>{inside}</td></tr></table>"

    before = [f() for f in (header, nav, notice, advert, form, sidebar) if chance(0.35)] or ([nav()] if chance(0.5) else [])
    after = [f() for f in (sidebar, comments, advert, share, form, notice) if chance(0.3)]
    r.shuffle(after)
    middle = article()
    if chance(0.3):
        middle = f"<div{attr('container', 'wrapper', 'page', 'row', 'layout')}>{''.join(before[-1:])}{middle}{''.join(after[:1])}</div>"
        before, after = before[:-1], after[1:]
    if chance(0.85):
        after.append(footer())
    page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body data-main=0>{''.join(before)}{middle}{''.join(after)}"
    return page + ("</body></html>" if chance(0.9) else "")


@lru_cache(2)
def trained(pages: int = 500, seed: int = 11) -> Boosted:
    """Trees fitted to generated pages; the same for the same arguments."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page = Page(generated_page(r), marks=True)
        x.append(page.features())
        y.append(page.labels)
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(np.float64))


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The main text of each row of pages(page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, and one without main text, gives an empty text. Repeated rows give repeated
    rows; null ids and urls are kept; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or trained())
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            parsed = [Page(h) if h else None for h in batch.column(2).to_pylist()]
            sizes = [len(p.parents) if p else 0 for p in parsed]
            if any(sizes):
                logits = trees.predict(np.concatenate([p.features() for p in parsed if p]))
            texts, at = [], 0
            for page, n in zip(parsed, sizes, strict=True):
                texts.append(page.text(decode(page, logits[at : at + n])) if page else "")
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(work, "page_id long, url string, text string, n_chars long")
