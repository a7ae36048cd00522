"""Main text of web pages by a tree-structured model over block elements.

Each block element is content or not. Its tag, names, links, length and surroundings give it a score, and a parent gives
one to its child; sum-product messages go from the leaves to the root and back, which yields every block's marginal
exactly. The text of blocks that are content with at least even odds is the page's text.

Training counts labelled pages: elements marked data-content="1" (with all below them) or "0". Spark sums the counts; the
model is their smoothed logarithms and has a bounded number of entries, as every feature has a fixed set of values.

Null and empty html give an empty text. Broken markup is read leniently: unclosed elements end with their parents,
stray end tags are ignored. Scripts, styles, comments and attributes are never text. Pages are judged one by one, so
repeated rows are each reported; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SMOOTH = 0.3
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"[<>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role|data-content)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_MARK = re.compile(r"""data-content\s*=\s*["']?([01])""")
_RAW = {name: re.compile(f"</{name}", re.IGNORECASE) for name in ("script", "style")}
_BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript object ol option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul".split())
_VOID = {"hr"}
#: Elements that an opening tag ends, and where the search for them stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_KIND_OF_TAG = {"nav": "menu", "menu": "menu", "footer": "edge", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "select": "form", "option": "form", "textarea": "form", "label": "form", "head": "never", "title": "never", "noscript": "never", "template": "never", "iframe": "never", "object": "never", "svg": "never", "dialog": "notice", "article": "main", "main": "main"}
#: Whole words in class, id and role attributes, between separators or changes of case; the first kind with a match counts.
_KIND_OF_NAME = [
    (kind, re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_-])"))
    for kind, words in [
        ("ad", r"ads?|advert\w*|promos?|promoted|promotions?|promobox|sponsor(?:s|ed|ship)?|banners?"),
        ("comments", r"comments?(?:list|form|section|area|box|thread|body|wrap\w*)?|disqus\w*|repl(?:y|ies)|respond"),
        ("notice", r"cookies?(?:bar|box|banner|notice|consent)?|consent\w*|notices?|popups?|modal|overlay|newsletters?(?:box|form)?|subscri(?:be|bers?|ption|ptions)\w*|alerts?|gdpr\w*|paywall\w*"),
        ("menu", r"nav\w*|menus?|menubar|breadcrumbs?|pagination|pager|tabs|toc|share\w*|social\w*|tags?"),
        ("side", r"sidebars?\w*|aside|related(?:posts|articles|stories|links)?|recommend(?:s|ations?)?|widgets?|complementary|trending|popular"),
        ("edge", r"footer|header|masthead|topbar|bottom|copyright|colophon|contentinfo"),
        ("form", r"form|search|login|signup"),
        ("main", r"articles?\w*|contents?|post|story|entry|main|text|body"),
    ]
]
_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SHOWN_TAGS = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "footer", "header", "aside", "form", "td", "table", "blockquote", "pre", "body", "html", "head", "title", "figure", "figcaption", "dd", "dt"}


def tags(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name, closes, attributes) of each tag in order, and what is left with the name "". Comments and
    declarations have no name either.

    Every step goes on from where the last one ended, so the work grows with the page however it is broken. A quote opens a
    value after = only. A tag whose quote is never closed ends at the next > or <, any other at > or before the next <.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    at = begin = 0
    while (at := source.find("<", at)) >= 0:
        text = source[begin:at]
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            yield text, "", False, ""
            at = begin = len(source) if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            yield text, "", False, ""
            at = begin = len(source) if end < 0 else end + 1
            continue
        m = _NAME.match(source, at + 1)
        if not m:  # not a tag but text
            at += 1
            continue
        i = first = m.end()
        while True:
            found = _INSIDE.search(source, i)
            if not found:
                end = begin = len(source)
                break
            i = found.start()
            c = source[i]
            if c == ">":
                end, begin = i, i + 1
                break
            if c == "<":
                end = begin = i
                break
            if source[max(first, i - 16) : i].rstrip().endswith("="):
                if last[c] > i:
                    i = source.find(c, i + 1) + 1
                    continue
                rest = re.compile("[<>]").search(source, i + 1)
                end = rest.start() if rest else len(source)
                begin = end + 1 if rest and rest[0] == ">" else end
                break
            i += 1
        name, closes = m[1].lower(), source[at + 1] == "/"
        yield text, name, closes, source[first:end]
        if name in _RAW and not closes:  # up to its end nothing is a tag
            found = _RAW[name].search(source, begin)
            begin = found.start() if found else len(source)
        at = begin
    yield source[begin:], "", False, ""


class Page:
    """Block elements of a page: parents come before children; blocks are (element, text) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.mark = ["#"], [-1], ["none"], [None]
        self.length, self.linked, self.stops = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, parts, links = [0], [], 0
        open_: dict[str, list[int]] = {}  # where in the stack the elements of a name are

        def flush() -> None:
            if parts:
                text = " ".join("".join(p for p, _ in parts).split())
                if text:
                    at = stack[-1]
                    self.blocks.append((at, text))
                    n = sum(len(p) for p, _ in parts) or 1
                    self.length[at] += len(text)
                    self.linked[at] += round(len(text) * sum(len(p) for p, inside in parts if inside) / n)
                    self.stops[at] += sum(text.count(c) for c in ".!?。")
                parts.clear()

        def leave(depth: int) -> None:
            while len(stack) > depth:
                open_[self.tag[stack.pop()]].pop()

        def innermost(names) -> int:
            return max((open_[name][-1] for name in names if open_.get(name)), default=0)

        for text, name, close, attributes in tags(source):
            if text:
                parts.append((entities.unescape(text), links > 0))
            if name == "a":
                links = max(0, links + (-1 if close else 1))
            elif name in ("br", "img", "wbr", "input") or name in _RAW:
                parts.append((" ", links > 0))
            elif name in _BLOCKS:
                flush()
                links = 0
                if close:
                    if open_.get(name):
                        leave(open_[name][-1])
                    continue
                if self.tag[stack[-1]] == "p":
                    leave(len(stack) - 1)
                ends, until = _ENDS.get(name, ((), ()))
                depth = innermost(ends)
                if depth > innermost(until):
                    leave(depth)
                i = len(self.tag)
                self._add(name, stack[-1], attributes)
                if name not in _VOID:
                    open_.setdefault(name, []).append(len(stack))
                    stack.append(i)
        flush()

    def _add(self, name: str, parent: int, attributes: str) -> None:
        kind = _KIND_OF_TAG.get(name, "none")
        mark = self.mark[parent]
        if attributes.strip():
            if found := _MARK.search(attributes):
                mark = int(found[1])
            names = _CASE.sub("-", " ".join(next(filter(None, x), "") for x in _NAMES.findall(attributes))).lower()
            if kind in ("none", "main") and names:
                kind = next((k for k, pattern in _KIND_OF_NAME if pattern.search(names)), kind)
        self.tag.append(name), self.parent.append(parent), self.kind.append(kind), self.mark.append(mark)
        self.length.append(0), self.linked.append(0), self.stops.append(0)

    def features(self) -> list[list[tuple[str, str]]]:
        """For each element but the page itself, the value of each feature."""
        n = len(self.tag)
        length, linked, stops, around = list(self.length), list(self.linked), list(self.stops), ["none"] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
        out = [[]]
        for i in range(1, n):
            p = self.parent[i]
            kind = self.kind[p]
            if self.tag[p] == "header":  # an article's own header holds its title
                kind = "none" if around[p] == "main" else "edge"
            # What stands around, nearest first; nothing but the article ends what an advert or a menu began.
            around[i] = kind if kind != "none" and not (kind == "main" and around[p] not in ("none", "main")) else around[p]
            own = "edge" if self.tag[i] == "header" and around[i] != "main" else self.kind[i]
            share = linked[i] / length[i] if length[i] else 0
            out.append([
                ("tag", self.tag[i] if self.tag[i] in _SHOWN_TAGS else "other"),
                ("kind", own),
                ("around", around[i]),
                ("length", str(min(5, int(math.log(length[i] + 1, 4))))),
                ("links", str(math.ceil(share * 3))),
                ("stops", str(min(2, stops[i]))),
            ])
        return out


def count(page: Page) -> Counter:
    """(feature, value, label) and (parent's label, label) of a labelled page; unmarked elements are not content."""
    out: Counter = Counter()
    label = [0 if m is None else m for m in page.mark]
    for i, values in enumerate(page.features()):
        for feature, value in values:
            out[feature, value, label[i]] += 1
        if i:
            out["parent", str(label[page.parent[i]]), label[i]] += 1
    return out


def model(counts: dict[tuple[str, str, int], float]) -> dict:
    """Scores: (feature, value) -> log odds for content; "parent" -> log P(label | parent's label)."""
    total: Counter = Counter()
    values: dict[str, set] = {}
    for (feature, value, label), n in counts.items():
        total[feature, label] += n
        values.setdefault(feature, set()).add(value)
    p = lambda f, v, y: (counts.get((f, v, y), 0) + SMOOTH) / (total[f, y] + SMOOTH * (len(values[f]) + 1))
    scores = {(f, v): math.log(p(f, v, 1) / p(f, v, 0)) for f, vs in values.items() if f != "parent" for v in vs}
    pair = {(a, y): counts.get(("parent", str(a), y), 0) + 1 for a in (0, 1) for y in (0, 1)}
    scores["parent"] = tuple(tuple(math.log(pair[a, y] / (pair[a, 0] + pair[a, 1])) for y in (0, 1)) for a in (0, 1))
    return scores


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(parent: list[int], odds: list[float], pair) -> list[float]:
    """Log odds of content for each node of a tree whose root, node 0, is not content. odds: each node's own."""
    n = len(parent)
    up0, up1 = [0.0] * n, list(odds)
    m0, m1 = [0.0] * n, [0.0] * n  # messages to the parent, by its label
    for i in range(n - 1, 0, -1):
        m0[i] = _log_sum(up0[i] + pair[0][0], up1[i] + pair[0][1])
        m1[i] = _log_sum(up0[i] + pair[1][0], up1[i] + pair[1][1])
        up0[parent[i]] += m0[i]
        up1[parent[i]] += m1[i]
    down = [0.0] * n  # log odds that the parent's side gives, without what came from the node itself
    out = [-math.inf] * n
    for i in range(1, n):
        p = parent[i]
        if p == 0:
            rest = -1e9
        else:
            rest = down[p] + (up1[p] - m1[i]) - (up0[p] - m0[i])
        to0 = _log_sum(pair[0][0], rest + pair[1][0])
        to1 = _log_sum(pair[0][1], rest + pair[1][1])
        down[i] = to1 - to0
        out[i] = down[i] + up1[i] - up0[i]
    return out


def extract(source: str | None, scores: dict) -> str:
    if not source:
        return ""
    page = Page(source)
    odds = [sum(scores.get(f, 0.0) for f in values) for values in page.features()]
    found = marginals(page.parent, odds, scores["parent"])
    return "\n".join(text for i, text in page.blocks if found[i] >= 0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: Counter = Counter()
        for source in b.column(0).to_pylist():
            total.update(count(Page(source or "")))
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"feature": [k[0] for k in keys], "value": [k[1] for k in keys], "label": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([total[k] for k in keys], pa.int64())})


def train(labelled: DataFrame, html: str = "html") -> dict:
    """The model of labelled pages. Their counts have a row per feature, value and label, a few hundred in all."""
    counts = labelled.select(html).mapInArrow(_counts, "feature string, value string, label int, n bigint").groupBy("feature", "value", "label").sum("n")
    return model({(r[0], r[1], r[2]): r[3] for r in counts.collect()})


def extract_pages(pages: DataFrame, scores: dict, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars for each row of pages."""
    slim = pages.select(*keep, pages[html].alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(s, scores) for s in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return slim.mapInArrow(run, f"{schema}, text string, n_chars bigint")


def labelled_pages() -> list[str]:
    """Small pages of many shapes with their content marked, as labelled training data."""
    sentence = ["The committee met again on Tuesday to settle the budget, and most of the members stayed until late.", "Rain is expected in the north; the south stays dry.", "Nobody knew who had left the letter.", "She wrote the first chapter in a week, then threw it away and began once more, slowly.", "Results improved in every region, by 4% on average!", "Why does it matter?"]
    paragraph = lambda k, n: " ".join(sentence[(k + i) % len(sentence)] for i in range(n))
    menus = ['<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<div class="menu"><a href="/a">World</a> <a href="/b">Sport</a> <a href="/c">Travel</a></div>', '<header><div class="logo">Daily</div><ul class="nav"><li><a href="#">Start</a></li></ul></header>', '<div id="header"><h2><a href="/">The Gazette</a></h2><p>News from the valley since 1901.</p></div>']
    mains = [("<article data-content=1>", "</article>"), ('<main><div class="post-content" data-content=1>', "</div></main>"), ('<div id="content" data-content=1>', "</div>"), ('<div class="page"><div class="story" data-content=1>', "</div></div>"), ('<div><div data-content=1>', "</div></div>"), ('<main data-content=1><section>', "</section></main>")]
    sides = ["", '<aside><h3>Related</h3><ul><li><a href="/x">Another story of the day</a></li></ul><p>More stories from our writers, every week.</p></aside>', '<div class="sidebar"><p>Popular now. Read what others read, today and every day.</p></div>']
    notices = ["", '<div class="cookie-notice"><p>We use cookies to improve the site. By going on you agree.</p><button>Accept</button></div>', '<div class="ad">Buy two, get one free. Only this week, in all our shops.</div>', '<form action="/s"><label>Your mail</label><input name=m><button>Sign up</button><p>We never share your address.</p></form>']
    ends = ["<footer>&copy; 2024 Daily. All rights reserved.</footer>", '<div id="footer"><p>Imprint and contact. Call us any time.</p></div>', '<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all. It was better before.</p></div><div class="comment"><p>Well said!</p></div></section><footer><ul><li><a href="/p">Privacy</a></li></ul><p>Made in the valley.</p></footer>']
    within = ["", '<div class="ad" data-content=0>Save on flights today. Book now!</div>', '<div class="share" data-content=0><a href="#">Share</a> <a href="#">Print</a></div>', '<div id="comments" data-content=0><p>Great piece, thank you. I learned a lot.</p></div>', '<nav data-content=0><a href="#1">Part one</a></nav>', '<aside data-content=0><p>See also the report of last year.</p></aside>']
    bodies = [lambda k: f"<h1>{sentence[k % 6]}</h1><p>{paragraph(k, 3)}</p><p>{paragraph(k + 1, 5)}</p>{{}}<p>{paragraph(k, 1)}</p>", lambda k: f"<h1>Title {k}</h1><p>{paragraph(k, 2)}</p><ul><li>{sentence[2]}</li><li>Second point</li></ul>{{}}<blockquote><p>{paragraph(k, 2)}</p></blockquote>", lambda k: f"<header><h1>{sentence[(k + 2) % 6]}</h1></header><div><p>{paragraph(k, 8)}</p></div>{{}}<h2>Later</h2><p>{paragraph(k + 3, 4)} <a href='/l'>link</a></p><p>Yes.</p>", lambda k: f"<h2>{sentence[k % 6]}</h2><p>{paragraph(k, 6)}<p>{paragraph(k + 2, 2)}{{}}<table><tr><td>{sentence[1]}</td><td>12</td></tr></table><pre>x = 1</pre>"]
    out = []
    shapes = itertools.product(menus, mains, sides, notices, ends)
    for k, (menu, (begin, end), side, notice, tail) in enumerate(shapes):
        body = bodies[k % len(bodies)](k).replace("{}", within[k % 7] if k % 7 < len(within) else "")
        head = f"<html><head><title>Title {k}</title></head><body>"
        out.append(f"{head}{menu}{notice}{begin}{body}{end}{side}{tail}</body></html>")
    return out


def default_model(spark: SparkSession) -> dict:
    return train(spark.createDataFrame([(p,) for p in labelled_pages()], "html string"))
