"""HTML main-text extraction: boosted trees over DOM-node features, decoded over the tree.

A tolerant parser builds the block-level elements of the whole page (inline elements belong to the block around them) and
the text blocks between block boundaries. Each element gets features of its subtree (text, link and tag density, commas,
paragraphs), of its attribute tokens and its ancestors', of its depth and of its siblings. Boosted trees say how likely the
element is article content. Decoding picks, bottom up, for each subtree the best of: all content, no content, or mixed (the
children decide each for themselves); so nothing kept lies under something dropped as a whole, and the reverse.

Text inside a block: character references decoded, white space runs to one space, trimmed; blocks joined by one newline.
Elements that never show text (scripts, styles, the head, templates, form controls, and whatever has the attribute hidden or the
style display:none) have none.

The trees are trained on `TRAIN_PAGES` made-up pages, on the driver; no page of the input is used.

Null or empty html gives the empty text; so does a page without content. Repeated rows are answered each; ties of the decoding go to
keeping. An empty table gives an empty table; extra columns pass, and one named like the output raises an error. Broken markup is
read as far as it goes: unknown end tags are ignored, missing ones implied; a quote opens a value only after =, and only if the
quote that closes it ends the value (else the tag goes up to >). Reading is linear in the page, whatever is left open: end tags
look for their element only if one is open, and block starts only at elements that they may close.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import gbt
from .common import bound_batches, check_free, extended, table

TRAIN_PAGES = 700
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"(?=[\s/]|\Z)|'([^']*)'(?=[\s/]|\Z)|([^\s>]*)))?""")
NAMED = frozenset("class id role itemprop aria-label".split())
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript textarea select option button svg iframe object canvas audio video datalist title math noembed noframes xmp".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that the start of a block may close, or at which it stops looking.
SCOPE = frozenset("ul ol dl table html body div section article main aside nav header footer form".split())
MARKS = SCOPE | {"p", *CLOSES, *(x for xs in CLOSES.values() for x in xs)}
#: Attribute tokens by what they speak for.
GOOD = re.compile(r"article|content|main|post(?!er)|entry|story|text|body|prose|news|blog", re.I)
BAD = {
    "menu": re.compile(r"nav|menu|bread|crumb|tabs|toc|pag(?:er|ination)|skip", re.I),
    "edge": re.compile(r"foot|header|head(?!line)|mast|top-?bar|copyright|legal|branding|logo", re.I),
    "side": re.compile(r"side|aside|widget|rail|related|recommend|popular|trending|more-|teaser|complementary", re.I),
    "promo": re.compile(r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo|banner|newsletter|subscri|sign-?up|share|social|donat|affiliate", re.I),
    "notice": re.compile(r"cookie|consent|gdpr|notice|alert|modal|popup|overlay|disclaim|warning|toast|privacy", re.I),
    "talk": re.compile(r"comment|reply|replies|discuss|disqus|respond|feedback|review|thread", re.I),
    "form": re.compile(r"form|search|login|contact|poll|survey", re.I),
}
TAGS = ["article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "li", "p", "h1", "h2", "table", "blockquote", "pre", "body", "figure"]
FEATURES = ["chars", "share", "links", "commas", "paras", "words", "blocks", "depth", "place", "siblings", "before", "own", "good", *BAD, "up_good", *[f"up_{k}" for k in BAD], "in_article", "in_edge", *TAGS]


class Page:
    """Elements (tag, parent, attribute text) and text blocks (element, text) of one page."""

    def __init__(self, source: str):
        self.tags, self.parents, self.tokens = ["html"], [-1], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.inline = [0]
        stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # every open tag, with the element it belongs to, and whether it hides
        counts: Counter = Counter()  # of open tags by name
        scopes: list[Counter] = [Counter()]  # of open inline tags by name, for each open block
        marks: list[int] = []  # places of MARKS in the stack
        hidden = 0
        buffer: list[str] = []
        linked = 0
        at, size = 0, len(source)

        def put(piece: str) -> None:
            nonlocal linked
            if hidden or not piece:
                return
            piece = html_module.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if counts["a"]:
                linked += len(piece.strip())

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                buffer.clear()
            linked = 0

        def open_tag(name: str, element: int, hides: bool) -> None:
            nonlocal hidden
            if name in MARKS:
                marks.append(len(stack))
            stack.append((name, element, hides))
            counts[name] += 1
            hidden += hides
            if name in BLOCK:
                scopes.append(Counter())
            else:
                scopes[-1][name] += 1

        def close(index: int) -> None:
            nonlocal hidden
            while len(stack) > index:
                name, _, hides = stack[-1]
                if name in BLOCK:
                    flush()
                    scopes.pop()
                else:
                    scopes[-1][name] -= 1
                stack.pop()
                counts[name] -= 1
                hidden -= hides
                if marks and marks[-1] == len(stack):
                    marks.pop()

        while at < size:
            m = TAG.search(source, at)
            if m is None:
                put(source[at:])
                break
            put(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if (counts if name in BLOCK or name == "a" else scopes[-1])[name]:
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    close(i)
                elif name == "p":
                    flush()
                continue
            if name in BLOCK:
                shut = CLOSES.get(name)
                k = len(marks) - 1
                while k >= 0:
                    other = stack[marks[k]][0]
                    if other == "p":
                        close(marks[k])
                        break
                    if shut is None or other in SCOPE:
                        break
                    if other in shut:
                        close(marks[k])
                    k -= 1
            if name == "br":
                put(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                self.inline[stack[-1][1]] += 1
                continue
            if name == "html" or name == "body" and counts["body"]:
                continue
            tokens, hides = attributes(m[3]) if m[3] else ("", False)
            hides = hides or name in HIDDEN
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                if end is None:
                    break
                at = end.start()
                open_tag(name, stack[-1][1], hides)
            elif name in BLOCK:
                flush()
                self.parents.append(stack[-1][1])
                self.tags.append(name)
                self.tokens.append(tokens)
                self.inline.append(0)
                open_tag(name, len(self.tags) - 1, hides)
            else:
                self.inline[stack[-1][1]] += 1
                open_tag(name, stack[-1][1], hides)
        close(1)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tags)
        chars, links, commas, words, blocks, paras, own, tags = (np.zeros(n) for _ in range(8))
        first = np.full(n, np.inf)
        total = 0
        for e, text, linked in self.blocks:
            chars[e] += len(text)
            own[e] += len(text)
            links[e] += linked
            commas[e] += text.count(",") + text.count(".")
            words[e] += text.count(" ") + 1
            blocks[e] += 1
            first[e] = min(first[e], total)
            total += len(text)
        paras += np.array([t == "p" for t in self.tags])
        tags += 1 + np.array(self.inline)
        depth, place, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
        kids: list[int] = [0] * n
        for i in range(1, n):
            p = self.parents[i]
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
        for i in range(1, n):
            siblings[i] = kids[self.parents[i]]
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            for a in (chars, links, commas, words, blocks, paras, tags):
                a[p] += a[i]
            first[p] = min(first[p], first[i])
        flags = np.zeros((n, 1 + len(BAD)))
        for i, t in enumerate(self.tokens):
            if t:
                flags[i, 0] = bool(GOOD.search(t))
                for k, r in enumerate(BAD.values()):
                    flags[i, 1 + k] = bool(r.search(t))
        up = np.zeros_like(flags)
        article, edge = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = self.parents[i]
            up[i] = np.maximum(up[p], flags[p])
            article[i] = max(article[p], self.tags[p] in ("article", "main"))
            edge[i] = max(edge[p], self.tags[p] in ("nav", "header", "footer", "aside", "form"))
        size = np.maximum(chars, 1)
        one = np.array([[t == x for x in TAGS] for t in self.tags], float)
        self.chars, self.own = chars, own
        return np.column_stack([
            np.log1p(chars), chars / max(total, 1), links / size, 100 * commas / size, paras, words / np.maximum(blocks, 1), np.log1p(blocks), depth, place / np.maximum(siblings, 1), siblings,
            np.where(np.isfinite(first), first, total) / max(total, 1), own / size, flags, up, article, edge, one,
        ])

    def decode(self, p: np.ndarray) -> list[str]:
        """The kept texts."""
        n = len(self.tags)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        weight = self.own + 0.3 * self.chars
        yes, no = weight * np.log(p), weight * np.log(1 - p)
        keep, drop = yes.copy(), no.copy()
        mixed = np.maximum(self.own * np.log(p), self.own * np.log(1 - p))
        for i in range(n - 1, 0, -1):
            q = self.parents[i]
            keep[q] += keep[i]
            drop[q] += drop[i]
            mixed[q] += max(keep[i], drop[i], mixed[i])
        choice = np.zeros(n, np.int64)  # 2 all, 1 mixed, 0 none
        for i in range(n):
            above = choice[self.parents[i]] if i else 1
            if above != 1:
                choice[i] = above
            elif i and keep[i] >= max(drop[i], mixed[i]):
                choice[i] = 2
            elif i and drop[i] >= mixed[i]:
                choice[i] = 0
            else:
                choice[i] = 1
        return [text for e, text, _ in self.blocks if choice[e] == 2 or choice[e] == 1 and p[e] >= 0.5]


def attributes(text: str) -> tuple[str, bool]:
    """The values of naming attributes, and whether the element hides what it holds."""
    values, hides = [], False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in NAMED:
            values.append(value)
        elif name == "hidden" or name == "style" and UNSEEN.search(value):
            hides = True
    return " ".join(values), hides


def made_up_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page and its content blocks. Content words come from one made-up vocabulary as boilerplate words do."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    syllables = ["ta", "ren", "lo", "mi", "shu", "ker", "an", "e", "vor", "is", "ou", "tel", "ba", "ding", "für", "é"]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))

    def sentence(lo: int, hi: int) -> str:
        ws = [word() for _ in range(int(rng.integers(lo, hi)))]
        ws = [w + "," if rng.random() < 0.07 else w for w in ws]
        return " ".join(ws).capitalize() + "."

    prose = lambda lo=1, hi=7: " ".join(sentence(3, 22) for _ in range(int(rng.integers(lo, hi))))
    noise = lambda: pick("", "", f' class="{pick("wrap", "row", "col", "box", "inner", "container", "c12", "clearfix", "grid", "block")}"', f' id="{word()}"')
    links = lambda k: "".join(f'<li><a href="/{word()}">{word()} {word()}</a></li>' for _ in range(k))
    content: list[str] = []

    def named(tag: str, names: list[str], always: float = 0.75) -> str:
        return f"<{tag}{f' {pick("class", "class", "id")}="{pick(*names)}"' if rng.random() < always else ''}>"

    def junk(kind: str) -> str:
        if kind == "nav":
            t = pick("nav", "nav", "div", "ul")
            names = ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "site-nav", "tabs", "pagination"]
            body = links(int(rng.integers(2, 9)))
            return (named(t, names, 0.4 if t == "nav" else 1) + (body if t == "ul" else f"<ul>{body}</ul>") + f"</{t}>") if rng.random() < 0.8 else named("nav", names, 0.4) + " | ".join(f'<a href="#">{word()}</a>' for _ in range(5)) + "</nav>"
        if kind == "header":
            t = pick("header", "header", "div")
            return named(t, ["header", "site-header", "masthead", "top-bar", "branding", "page-header"], 0.5 if t == "header" else 1) + pick(f"<h1>{word()} {word()}</h1>", f"<p>{sentence(2, 9)}</p>", f"<div>{sentence(2, 6)}</div>", f"<span>{word()}</span>") + pick("", junk("nav")) + f"</{t}>"
        if kind == "footer":
            t = pick("footer", "footer", "div")
            return named(t, ["footer", "site-footer", "page-foot", "copyright", "legal", "bottom"], 0.4 if t == "footer" else 1) + pick(f"&copy; {word()} &middot; {sentence(3, 12)}", f"<p>{prose(1, 3)}</p>", f"<ul>{links(4)}</ul><p>&copy; 2020 {word()}</p>") + f"</{t}>"
        if kind == "side":
            t = pick("aside", "aside", "div", "section")
            return named(t, ["sidebar", "side", "widget", "related", "right-rail", "recommended", "popular-posts", "more-stories", "teaser"], 0.5 if t == "aside" else 1) + pick(f"<h3>{sentence(1, 5)}</h3><ul>{links(5)}</ul>", f"<h2>{word()}</h2><p>{prose(1, 4)}</p>", f"<p>{prose(1, 5)}</p><p>{prose(1, 4)}</p>") + f"</{t}>"
        if kind == "ad":
            return named(pick("div", "div", "section", "p", "aside"), ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "newsletter", "subscribe", "share", "social-links", "advertisement"], 1) + pick(prose(1, 3), f"<p>{prose(1, 4)}</p>", f'<a href="#">{sentence(3, 9)}</a>') + "</div>"
        if kind == "notice":
            return named(pick("div", "div", "section", "aside"), ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner", "modal", "popup", "privacy-notice", "disclaimer"], 1) + pick(f"<p>{prose(1, 4)}</p><button>{word()}</button>", prose(1, 3), f'{sentence(5, 20)} <a href="#">{word()}</a>') + "</div>"
        if kind == "form":
            return named("form", ["search", "login", "contact-form", "signup", "poll"], 0.5) + f"<label>{sentence(1, 4)}</label><input name=q>" + pick("", f"<p>{prose(1, 3)}</p>") + f"<button>{word()}</button></form>"
        t = pick("div", "section", "ul", "ol", "aside")
        inner = pick("div", "article", "li", "p") if t not in ("ul", "ol") else "li"
        names = ["comments", "comment-list", "replies", "discussion", "disqus_thread", "responses", "reader-comments", "feedback", "reviews"]
        rows = "".join(f'<{inner}{pick("", " class=comment", " class=reply")}>' + pick(f"<p>{prose(1, 4)}</p>" if inner != "p" else prose(1, 4), f"<b>{word()}</b> {prose(1, 3)}") + f"</{inner}>" for _ in range(int(rng.integers(1, 6))))
        return named(t, names, 1) + (f"<h3>{sentence(1, 4)}</h3>" if t not in ("ul", "ol") and rng.random() < 0.6 else "") + rows + f"</{t}>"

    def article() -> str:
        out = []
        title = sentence(3, 12)
        if rng.random() < 0.85:
            content.append(title)
            head = f"<{(h := pick('h1', 'h1', 'h2'))}{noise()}>{title}</{h}>"
            out.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            text = prose(1, 8)
            if r < 0.72:
                content.append(text)
                out.append(pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>" if rng.random() < 0.2 else f"<p{noise()}>{text}</p>"))
            elif r < 0.78:
                content.append(t := sentence(2, 8))
                out.append(f"<h{(k := pick(2, 3))}>{t}</h{k}>")
            elif r < 0.86:
                items = [sentence(2, 14) for _ in range(int(rng.integers(2, 6)))]
                content.extend(items)
                out.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif r < 0.9:
                content.append(text)
                out.append(f"<blockquote>{pick('<p>', '')}{text}</blockquote>")
            elif r < 0.93:
                content.append(c := sentence(3, 9))
                out.append(f"<figure><img src=x><figcaption>{c}</figcaption></figure>")
            elif r < 0.95:
                cells = [word() for _ in range(4)]
                content.extend(cells)
                out.append(f"<table><tr><td>{cells[0]}<td>{cells[1]}</tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>")
            else:
                out.append(junk(pick("ad", "ad", "side", "notice", "form")))
        if rng.random() < 0.12:
            out.append(junk(pick("comments", "ad", "nav", "footer")))
        return "".join(out)

    k = rng.random()
    body = article()
    main = f"<article{noise()}>{body}</article>" if k < 0.5 else f"<main{noise()}>{pick('', '<div>')}{body}</main>" if k < 0.65 else f'<div {pick("class", "id")}="{pick("content", "article-body", "post", "entry-content", "story", "main-content", "post-text", "page-body")}">{body}</div>' if k < 0.9 else f"<div{noise()}>{body}</div>"
    before = [junk(x) for x in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < 0.4]
    after = [junk(x) for x in ("side", "comments", "ad", "nav", "footer", "form", "notice") if rng.random() < 0.45]
    rng.shuffle(before)
    inner = "".join(before) + main + "".join(after)
    if rng.random() < 0.4:
        inner = f"<div{noise()}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}{pick('</body></html>', '')}", content


@functools.cache
def forest(pages: int = TRAIN_PAGES, seed: int = 11) -> gbt.Forest:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        source, content = made_up_page(rng)
        page, wanted = Page(source), set(content)
        x = page.features()
        good = np.zeros(len(x))
        for e, text, _ in page.blocks:
            good[e] += len(text) * (text in wanted)
        for i in range(len(x) - 1, 0, -1):
            good[page.parents[i]] += good[i]
        share = good / np.maximum(page.chars, 1)
        pure = (page.chars > 0) & ((share > 0.8) | (share < 0.2))
        xs.append(x[pure])
        ys.append((share[pure] > 0.5).astype(float))
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=70, depth=5, rate=0.2)


def texts_of(sources: list[str | None], trees: gbt.Forest) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    some = [p for p in pages if p is not None]
    if not some:
        return [""] * len(sources)
    x = [p.features() for p in some]
    ends = np.cumsum([len(v) for v in x])
    p = trees.predict(np.concatenate(x))
    kept = iter(["\n".join(page.decode(q)) for page, q in zip(some, np.split(p, ends[:-1]))])
    return [next(kept) if page is not None else "" for page in pages]


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text to the columns of pages."""
    check_free(pages, name)
    bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(forest())  # a fixed number of trees
    at = pages.columns.index(html)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts_of(batch.column(at).to_pylist(), shared.value), pa.string())], [*batch.schema.names, name])

    return pages.mapInArrow(run, extended(pages, **{name: "string"}))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
