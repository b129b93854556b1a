"""Main text of web pages with site templates removed.

Each page is parsed into a tree in linear time. Spark counts, over the different pages of a host, the subtrees of its
elements by their content, by their place and shape (names, classes and nesting, not words), and how much of a page's
text each place holds. A content or a shape that recurs across many of a host's pages is its template and is deleted:
menus, adverts and footers whose words vary have one shape. The place that holds most of the text is never deleted by
shape. Clues inside the page (article and main elements, names, roles and classes of menus, adverts, forms or comments)
decide the rest, and all on hosts with too few pages to count; ``clues=False`` leaves only the counts.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

#: A subtree is a template from so many different pages of a host, and from this share of them or so many pages. Inside
#: an article or main element only contents other than running text can be templates, from the larger share: shared
#: passages are text.
MIN_PAGES = 5
SHARE = 0.3
ENOUGH_PAGES = 50
SHARE_INSIDE = 0.5
#: A place is a host's main one if it holds this share of its pages' text on average.
MAIN_SHARE = 0.5
#: Templates that a task holds at once (9 bytes each); beyond, they are joined to the pages' elements.
BROADCAST_TEMPLATES = 500_000
#: Elements above one that are looked through for what it closes.
LOOK_UP = 64

# What a counted hash says of a subtree.
OUTSIDE, EVERYWHERE, SHAPE, MAIN = range(4)

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_CLASS_WORD = re.compile(r"[a-z]+")

# Element names of HTML (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt legend summary".split())
_SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
_DROPPED = frozenset("head script style noscript template nav aside footer form button select option datalist input textarea label iframe object embed svg math canvas audio video map dialog menu title".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_DROPPED_CLASSES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead comment comments disqus reply replies respond pagination pager toolbar paywall".split())
_PLACES = frozenset("area articles bar big block body bottom box button buttons col column container content desktop fixed footer form global group header icon icons inline inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot small sticky stories text title top unit wrap wrapper".split())
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption b i em strong span a u s code q cite small sub sup mark abbr time".split())


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile("[>\"']")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "digest", "shape", "path", "size", "links")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.digest = self.shape = self.path = self.size = self.links = 0


def _tokens(source: str):
    """kind, text, attributes and end of each token: t(ext), o(pen tag), c(lose tag), d(ata). Each character is passed a bounded number of times.

    A tag ends at the first > outside quotes; a quote that nothing closes is an ordinary character. If the quotes up to
    the end hide every >, they count for nothing from there on.
    """
    at, end = 0, len(source)
    last_end, last = source.rfind(">"), {q: source.rfind(q) for q in "\"'"}
    quotes = True
    jump = None
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            yield "t", source[at:], "", end
            return
        after = source[lt + 1 : lt + 2]
        stop, token = lt + 1, None
        if source.startswith("<!--", lt):
            stop = source.find("-->", lt + 4)
            stop = end if stop < 0 else stop + 3
            token = "x", "", ""
        elif source.startswith("<![CDATA[", lt):
            close = source.find("]]>", lt + 9)
            stop = end if close < 0 else close + 3
            token = "d", source[lt + 9 : end if close < 0 else close], ""
        elif lt > last_end:  # no tag ends any more
            yield "t", source[at:], "", end
            return
        elif after in ("!", "?"):
            stop, token = source.find(">", lt) + 1, ("x", "", "")
        elif after == "/" and (m := _NAME.match(source, lt + 2)):
            stop, token = source.find(">", m.end()) + 1, ("c", m[0].lower(), "")
        elif m := _NAME.match(source, lt + 1):
            here = m.end()
            while quotes:
                q = _END.search(source, here)
                if q is None:
                    quotes = False
                elif q[0] == ">":
                    here = q.start()
                    break
                else:
                    here = q.end() if q.start() >= last[q[0]] else source.find(q[0], q.end()) + 1
            if not quotes:
                here = source.find(">", m.end())
            stop, token = here + 1, ("o", m[0].lower(), source[m.end() : here])
        if lt > at:
            yield "t", source[at:lt], "", lt
        if token is None:
            yield "t", "<", "", stop
        elif token[0] != "x":
            jump = yield (*token, stop)
        at = stop if jump is None else jump
        jump = None


def parse(source: str | None) -> Node:
    """A tree of elements; texts are as in the source, with character references. Nothing raises on broken markup."""
    root = here = Node("#root", {}, None)
    opened: dict[str, int] = {}
    tokens = _tokens(source or "")
    token = next(tokens, None)

    def leave(to: Node) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    while token is not None:
        kind, what, attributes, at = token
        jump = None
        if kind in "td":
            here.items.append(what)
        elif kind == "o":
            if what in _CLOSES_P and opened.get("p"):
                leave(_closed(here, {"p"}, {"table", "td", "th", "button", "article", "section", "div", "main"}))
            if what in _SELF_CLOSING and any(map(opened.get, _SELF_CLOSING[what][0])):
                leave(_closed(here, *_SELF_CLOSING[what]))
            node = Node(what, {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}, here)
            here.items.append(node)
            if what in _RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{what}(?=[\s/>])[^>]*>", re.I).search(source, at)
                node.items.append(source[at : stop.start()] if stop else source[at:])
                jump = stop.end() if stop else len(source)
            elif what not in _VOID:
                here = node
                opened[what] = opened.get(what, 0) + 1
        elif opened.get(what):
            up = here
            while up.tag != what:
                up = up.parent
            leave(up.parent)
        try:
            token = tokens.send(jump)
        except StopIteration:
            token = None
    return root


def _closed(here: Node, tags: set[str], bounds: set[str]) -> Node:
    """Where an element goes that closes those of ``tags`` above it, up to one of ``bounds``."""
    up = found = here
    for _ in range(LOOK_UP):
        if up.parent is None or up.tag in bounds:
            break
        if up.tag in tags:
            found = up.parent
        up = up.parent
    return found


def nodes(root: Node):
    """All elements below, a parent before what it holds. No recursion: markup may be nested deeply."""
    todo = [x for x in reversed(root.items) if type(x) is Node]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.items) if type(x) is Node]


def hash_subtrees(root: Node) -> list[Node]:
    """All elements in order, with what is counted of each.

    digest: its name, class, id and content, white space taken as one space; 0 if it has no text. shape: its name, class
    and id without digits, and the shapes it holds, equal ones in a row as one. path: names, classes and ids from the
    root. size and links: characters of its text, and of those in links.
    """
    order = [root, *nodes(root)]
    h = xxhash.xxh64_intdigest
    for node in order:
        own = _DIGITS.sub("0", f"{node.tag}|{node.attrs.get('class', '')}|{node.attrs.get('id', '')}") if node.attrs else node.tag
        node.shape = own
        node.path = h(own, node.parent.path) if node.parent is not None else 1
    for node in reversed(order):
        parts, inner, text = [f"{node.tag}|{node.attrs.get('class', '')}|{node.attrs.get('id', '')}"], [node.shape], False
        for x in node.items:
            if type(x) is Node:
                parts.append(f"\x01{x.digest:x}" if x.digest else "")
                if x.digest:
                    text = True
                    node.size += x.size
                    node.links += x.links
                    if inner[-1] != x.shape:
                        inner.append(x.shape)
            elif node.tag not in ("script", "style"):
                words = x.split()
                own = " ".join(words)
                parts.append(own)
                text = text or own != ""
                node.size += len(own)
        node.digest = h("\x02".join(parts)) if text else 0
        node.shape = f"{h(chr(2).join(inner)):x}"
        if node.tag == "a":
            node.links = node.size
    return order


def _compound(attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or id is one of the words, or made of them and of words for a place: ``ad-box``, not ``ad-hoc-report``."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = _CLASS_WORD.findall(name)
        if not words.isdisjoint(parts) and all(p in words or p in _PLACES or p in _DROPPED_CLASSES for p in parts):
            return True
    return False


def dropped(node: Node, total: int = 0) -> bool:
    """Elements that never hold the article's text, by name, role or class. ``total``: characters of the page; a form around half of them is a frame, as some sites put one around all."""
    if node.tag in _DROPPED:
        return not (node.tag == "form" and 2 * node.size >= total > 0)
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _DROPPED_ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return node.tag not in ("html", "body", "article", "main") and _compound(a, _DROPPED_CLASSES)


_COMMENTS = frozenset(("comment", "comments", "reply"))


def main_roots(root: Node) -> tuple[list[Node], bool]:
    """The outermost articles, else main elements, else the body or all; and whether it is an article or main."""
    for kinds in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attrs.get("role", "").lower() == "main"):
        found, todo = [], [x for x in reversed(root.items) if type(x) is Node]
        while todo:
            n = todo.pop()
            comment = bool(n.attrs) and _compound(n.attrs, _COMMENTS)
            if kinds(n) and not comment:
                found.append(n)
            elif n.tag not in ("nav", "aside", "footer", "head") and not comment:
                todo += [x for x in reversed(n.items) if type(x) is Node]
        if found:
            return found, True
    return [n for n in nodes(root) if n.tag == "body"][:1] or [root], False


def _headings(root: Node) -> list[Node]:
    """The outermost headings below."""
    found, todo = [], [x for x in reversed(root.items) if type(x) is Node]
    while todo:
        n = todo.pop()
        if re.fullmatch("h[1-6]", n.tag):
            found.append(n)
        else:
            todo += [x for x in reversed(n.items) if type(x) is Node]
    return found


def is_header(node: Node) -> bool:
    return node.tag == "header" or node.tag in ("div", "section") and "header" in _CLASS_WORD.findall(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower())


def blocks(roots: list[Node], gone, article: bool = True) -> list[str]:
    """Texts of the blocks below the roots in order, without elements for which ``gone(node)`` holds. Of an article's headers the headings stay, a page's header goes."""
    out: list[str] = []
    own: list[str] = []

    def cut():
        text = " ".join(entities.unescape("".join(own)).split())
        own.clear()
        if text:
            out.append(text)

    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if type(x) is str:
                own.append(x)
            elif x is None:
                cut()
            elif x.tag == "br":
                own.append(" ")
            elif x is root or not gone(x):
                if x is not root and is_header(x):
                    cut()
                    todo += [None, *(reversed(_headings(x)) if article else ())]
                elif x.tag in _BLOCKS:
                    cut()
                    todo += [None, *reversed(x.items)]
                else:
                    todo += reversed(x.items)
        cut()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate(_ASCII_LOWER) if m else ""


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _of_host(host: str, kind: str, value: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{kind}{value}|{host}"))


class Page:
    """A parsed page: elements in order, roots of its text (``article``: they are articles or main elements), and who it is: copies are one page."""

    def __init__(self, url: str | None, source: str | None, clues: bool):
        self.host, self.clues = host_of(url), clues
        self.tree = parse(source)
        self.nodes = hash_subtrees(self.tree)[1:]
        self.roots, self.article = main_roots(self.tree) if clues else ([n for n in self.nodes if n.tag == "body"][:1] or [self.tree], False)
        self.who = _signed(xxhash.xxh64_intdigest("\n".join(f"{r.digest:x}" for r in self.roots) if self.article else f"{self.tree.digest:x}"))
        self.inside = {id(n) for r in self.roots for n in (r, *nodes(r))} if self.article else set()
        above = {id(self.tree)}
        for r in self.roots:
            up = r
            while up is not None and id(up) not in above:
                above.add(id(up))
                up = up.parent
        self.candidates = [i for i, n in enumerate(self.nodes) if n.digest and id(n) not in above and n.tag not in ("head", "title", "html", "body")]

    def hashes(self):
        """(place, hash, whether it lies inside, kind, share of the page's text) of all that is counted.

        Contents of elements but for running text inside an article; shapes that stand once at their path, outside articles
        and other than running text; and of each path how much text is there.
        """
        total = max(1, self.roots[0].size if not self.article else self.tree.size)
        shapes: dict[str, list[int]] = {}
        for i in self.candidates:
            n = self.nodes[i]
            within, running = id(n) in self.inside, n.tag in _RUNNING
            if not (within and running):
                yield i, _of_host(self.host, "c", f"{n.digest:x}"), within, OUTSIDE, 0.0
            if not within and not running:
                shapes.setdefault(f"{n.path:x}.{n.shape}", []).append(i)
        for name, own in shapes.items():
            if len(own) == 1:
                yield own[0], _of_host(self.host, "s", name), False, SHAPE, 0.0
        if not self.article:
            places: dict[int, list[int]] = {}
            for i, n in enumerate(self.nodes):
                if n.size and n.tag not in _RUNNING and n.tag not in ("html", "head", "title"):
                    places.setdefault(n.path, []).append(i)
            for path, own in places.items():
                h, share = _of_host(self.host, "m", f"{path:x}"), min(1.0, sum(self.nodes[i].size for i in own) / total)
                for i in own:
                    yield i, h, False, MAIN, share

    def text(self, found: dict[int, set[int]]) -> str:
        """found: what the counts say (OUTSIDE, EVERYWHERE, SHAPE, MAIN) of the elements at some places."""
        main = [self.nodes[i] for i, w in found.items() if MAIN in w]
        above = set()  # elements over one of them
        for n in main:
            up = n.parent
            while up is not None and id(up) not in above:
                above.add(id(up))
                up = up.parent
        deepest = [n for n in main if id(n) not in above]
        kept: set[int] = set()
        for n in deepest:
            up = n
            while up is not None and id(up) not in kept:
                kept.add(id(up))
                up = up.parent
            if n.tag != "body":
                kept.update(map(id, nodes(n)))
        body = not deepest or any(n.tag == "body" for n in deepest)
        gone = set()
        for i, w in found.items():
            n = self.nodes[i]
            within = id(n) in self.inside
            if EVERYWHERE in w or OUTSIDE in w and not within:
                gone.add(id(n))
            elif SHAPE in w and not within and id(n) not in kept and (self.article or not body or 2 * n.links >= n.size):
                gone.add(id(n))
        total = sum(r.size for r in self.roots)
        return "\n".join(blocks(self.roots, lambda n: id(n) in gone or n.tag in _HIDDEN or (self.clues and dropped(n, total)), self.article or not self.clues))


_HIDDEN = frozenset("head script style noscript template".split())


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, share_inside: float = SHARE_INSIDE, clues: bool = True) -> DataFrame:
    """h and what it says of the subtrees with that hash: OUTSIDE or EVERYWHERE (a template there), SHAPE (a template), MAIN (the place of the text). Written."""

    def make():
        def run(b: pa.RecordBatch):
            out: dict[str, list] = {"host": [], "h": [], "kind": [], "who": [], "share": []}
            for u, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(u, source, clues)
                own = {h: (kind, part) for _, h, _, kind, part in page.hashes()}
                for h, (kind, part) in [(None, (0, 0.0)), *own.items()]:
                    for c, v in zip(out.values(), (page.host, h, kind, page.who, part)):
                        c.append(v)
            return out | {"h": pa.array(out["h"], pa.int64()), "who": pa.array(out["who"], pa.int64())}

        return run

    rows = map_texts(pages.select(F.col(url).alias("url"), F.col(html).alias("html")), make, "host string, h long, kind int, who long, share double", rows=64)
    once = rows.groupBy("host", "h", "kind", "who").agg(F.max("share").alias("share"))
    counted = written(once.groupBy("host", "h", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("share")), "subtree-counts")
    hosts = counted.where(F.col("h").isNull()).select("host", F.col("n").alias("pages"))
    often = counted.where(F.col("h").isNotNull() & (F.col("n") >= min_pages)).join(hosts, "host")
    often = often.where((F.col("n") >= share * F.col("pages")) | (F.col("n") >= ENOUGH_PAGES))
    what = F.when((F.col("kind") == OUTSIDE) & (F.col("n") >= share_inside * F.col("pages")), EVERYWHERE).otherwise(F.col("kind"))
    return written(often.where((F.col("kind") != MAIN) | (F.col("share") >= MAIN_SHARE)).select("h", what.alias("what")), "templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", broadcast_templates: int = BROADCAST_TEMPLATES, clues: bool = True, **limits) -> DataFrame:
    """key, url, text and n_chars (code points) of every row.

    A null or empty html, or one without an article's text, gives an empty text. Pages without a host (null url) share
    the empty host. Copies of a page count once in a host's subtrees; repeated rows keep a row each. Other columns are
    ignored, broken markup never raises and is read in time linear in its length, an empty table gives an empty result.
    """
    found = templates(pages, url, html, clues=clues, **limits)
    kind = dict(pages.dtypes)[key]
    schema = f"key {kind}, url string, text string, n_chars long"
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    if found.count() <= broadcast_templates:
        got = [(r[0], r[1]) for r in found.collect()]
        h = np.array([x for x, _ in got], np.int64)
        order = np.argsort(h)
        sent = pages.sparkSession.sparkContext.broadcast((h[order], np.array([w for _, w in got], np.int8)[order]))

        def make():
            values, whats = sent.value

            def run(b: pa.RecordBatch):
                texts = []
                for u, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    page, marks = Page(u, source, clues), {}
                    own = [(i, x) for i, x, *_ in page.hashes()] if len(values) else []
                    if own:
                        asked = np.array([x for _, x in own], np.int64)
                        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                        for j in np.flatnonzero(values[at] == asked).tolist():
                            marks.setdefault(own[j][0], set()).add(int(whats[at[j]]))
                    texts.append(page.text(marks))
                return {"key": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

            return run

        return map_texts(rows, make, schema, rows=64).withColumnsRenamed({"key": key, "url": url})
    rows = rows.withColumn("of", F.xxhash64("url", "html"))

    def emit():
        def run(b: pa.RecordBatch):
            out: dict[str, list] = {"of": [], "place": [], "h": []}
            for of, u, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                for i, x, *_ in Page(u, source, clues).hashes():
                    for c, v in zip(out.values(), (of, i, x)):
                        c.append(v)
            return out

        return run

    places = map_texts(rows.dropDuplicates(["of"]).select("of", "url", "html"), emit, "of long, place int, h long", rows=64)
    marked = places.join(found, "h").groupBy("of").agg(F.collect_set(F.struct("place", "what")).alias("marks")).withColumnRenamed("of", "of2")
    both = rows.join(marked, F.col("of") == F.col("of2"), "left").select("key", "url", "html", "marks")

    def cut():
        def run(b: pa.RecordBatch):
            texts = []
            for u, source, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                marks: dict[int, set[int]] = {}
                for m in own or []:
                    marks.setdefault(m["place"], set()).add(m["what"])
                texts.append(Page(u, source, clues).text(marks))
            return {"key": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return run

    return map_texts(both, cut, schema, rows=64).withColumnsRenamed({"key": key, "url": url})


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
