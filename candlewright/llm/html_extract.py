"""HTML extraction: union-free regular expressions inferred from the pages of a host.

A page's elements become a regular expression over element labels (name and class words): runs of equal siblings, and
runs of equal groups of siblings, fold into repeated groups, and texts become slots.  Expressions of a host are aligned
into one wrapper: what one side lacks becomes an optional group, different texts make a slot variable.  Expressions of
one structure are merged first, by (host, structure), which needs no alignment and no order; different structures are
then aligned in the order of their digests, in GROUPS groups and then over groups.  So a wrapper does not depend on the
order of tasks, and a host with very many pages costs a reducer its different structures only.

The wrapper decides what a page's main text is.

- The main region is an article or main element, or one whose class says so and that holds most of the variable text.
  Without one it is the element that holds most of the variable text.
- In such a region without a mark, constant slots are the template: texts that are equal on CONSTANT pages (on OPTIONAL
  ones in an optional group, as a notice is), of which copies count once: pages are told apart by their longest text.
  Repeated groups whose text is links throughout are menus.  A region of nothing else keeps its texts.
- Everywhere, elements whose name says that they are not text (menus, forms, footers and so on) go, and those whose
  class or role is a mark as a whole, or with words of layout only; outside the main region a part of a class suffices.
- Inside a marked main region, words that text may have as well (DOUBTFUL; on paragraphs and the like all but adverts')
  count only where the wrapper bears them out: the text is the template's, or half of it is links.

Applied to a page, the wrapper yields the main region's blocks; a page that its path does not match takes the path from
its own expression.  Trees are walked with stacks of their own, so nesting may be as deep as a page is long.

Pages are joined with their host's rules without moving them where the rules are few (checked by size); hosts with more
than one in HOT of all pages get theirs by broadcast in any case, as they are HOT at most, so that no join task holds
a host that very many pages share.

Null html gives an empty text, a null or unparsable URL the host ''; repeated rows and null keys stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_
import pickle
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
STOP = re.compile("[\"'>]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# fixed values: element names
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SPACED = {"br", "td", "th"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "input", "head", "dialog", "menu", "object", "fieldset", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "blockquote", "td", "th"}
WHOLE = {"p", "h1", "h2", "h3", "li", "ul", "ol", "table", "tr", "dl", "pre"}  # never a region of their own
# fixed values: words of class, id and role that mark what is not main text, words of layout beside them, marks of main text
MARKS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "responses", "discussion", "alert"}
ADS = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored"}
DOUBTFUL = {"alert", "discussion", "widget"}  # inside a main region the wrapper must confirm these
TEXTUAL = {"p", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption", "li"} | HEADINGS  # on these, all marks but of adverts
COMMENTS = {"comment", "comments", "disqus", "respond", "replies", "responses"}
LAYOUT = {"area", "bar", "block", "blocks", "bottom", "box", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "links", "list", "media", "outer", "page", "panel", "post", "posts", "right", "section", "signup", "site", "slot", "thread", "top", "unit", "wrap", "wrapper"}
MAIN_MARKS = {"article-body", "articlebody", "content", "entry-content", "main", "main-content", "maincontent", "post", "post-body", "post-content", "story", "story-body"}

CONSTANT = 5  # different pages with a text that make it the template's
OPTIONAL = 3  # in an optional group
GROUPS = 64  # groups of structures of a host, aligned side by side
HOT = 2048
GREEDY = 1 << 20  # pairs of children from which on alignment takes the next equal label instead of the longest sequence
RULE_BYTES = 64 << 20  # of rules, as they are in memory, that are broadcast
KEEP, OUTSIDE, ALWAYS = range(3)  # where an element is dropped


class Node:
    """An element of a page; kids: elements and texts."""

    __slots__ = ("name", "label", "drop", "kids")

    def __init__(self, name: str, label: str, drop: int = KEEP) -> None:
        self.name, self.label, self.drop, self.kids = name, label, drop, []


def noise(name: str, classes: list[str], ident: str, hidden: bool) -> int:
    """Whether an element is not main text: nowhere, outside the main region, or anywhere."""
    if name in DROPPED or hidden:
        return ALWAYS
    spoken = COMMENTS & {*classes, ident}
    if name in ("html", "body", "article", "main"):
        return ALWAYS if spoken else KEEP
    if name not in HEADINGS:
        for word in [*classes, ident] if name in ("div", "ul", "ol", "span", "table") or spoken else classes:
            parts = {word, *re.split("[-_]", word)} - {""}
            if (word in MARKS or (parts & MARKS and not parts - MARKS - LAYOUT - {word})) and parts & MARKS - (MARKS - ADS if name in TEXTUAL else DOUBTFUL):
                return ALWAYS
    if name == "header" or any({w, *re.split("[-_]", w)} & MARKS for w in [*classes, ident]):
        return OUTSIDE
    return KEEP


def tokens(page: str):
    """(text, None) and (tag, its match) of a page in one forward scan; comments, raw elements and declarations go.

    A tag ends at the first > outside quotes, or at the first > if its quotes do not close.  Quotes that led to no end once
    are remembered, so that tags that never close cost no second look.
    """
    at, end, last = 0, len(page), page.rfind(">")
    dead: set[int] = set()

    def closing(pos: int) -> int:
        """Where the tag that goes on at pos ends."""
        seen, start = [], pos
        while True:
            m = STOP.search(page, pos)
            if m and m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end()) if m else -1
            if close < 0 or close in dead:
                dead.update(seen)
                return page.find(">", start)
            seen.append(close)
            pos = close + 1

    while at < end:
        to = page.find("<", at)
        if to != at:
            yield page[at : to if to >= 0 else end], None
            if to < 0:
                return
            at = to
        tag = TAG.match(page, at) if at < last else None
        if tag:
            ends = None if tag[1] else ENDS.get(tag[2].lower())
            if ends:
                done = ends.search(page, page.find(">", at) + 1)
                at = done.end() if done else end
                continue
            to = closing(tag.end())
            yield page[at : to + 1], tag
            at = to + 1
        elif page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = to + 3 if to >= 0 else end
        elif at < last and page[at + 1] in "!?":
            at = page.find(">", at) + 1
        else:
            yield "<", None
            at += 1


def parse(page: str) -> Node:
    """Element tree of a page; implied end tags as browsers take them; comments, scripts and styles left out."""
    root = Node("#root", "#root")
    stack, open_ = [root], {}

    def close(names, stop):
        if not any(open_.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                for n in stack[i:]:
                    open_[n.name] -= 1
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    for token, tag in tokens(page):
        if tag is None:
            stack[-1].kids.append(token)
            continue
        name = tag[2].lower()
        if tag[1]:
            close({name}, ())
            continue
        if name in CLOSES_P:
            close({"p"}, SCOPE)
        if name in SELF_CLOSING:
            close(SELF_CLOSING[name], SCOPE - {"td", "th"} if name == "tr" else SCOPE - SELF_CLOSING[name])
        classes, ident, hidden = [], "", False
        if "=" in token or "hidden" in token.lower():
            for a in ATTRIBUTE.finditer(token, tag.end() - tag.start()):
                value, kind = (a[2] or a[3] or a[4] or "").lower(), a[1].lower()
                if kind == "id":
                    ident = ident or value.strip()
                elif kind.endswith("hidden"):
                    hidden |= value != "false"
                else:
                    classes += value.split()
        drop = noise(name, classes, ident, hidden)
        words = sorted({re.sub(r"\d+", "0", w) for w in classes})
        node = Node(name, ".".join([name, *words]) + ("", "!", "!!")[drop], drop)
        stack[-1].kids.append(node)
        if name not in VOID and not token.endswith("/>"):
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
    return root


def chain(path: int, label: str) -> int:
    """Digest of a path one label longer."""
    return xxhash.xxh3_64_intdigest(label, path)


def slot_key(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, path ^ 0x5BD1E995)


def is_inline(node: Node) -> bool:
    return node.name in INLINE or node.name in SPACED


def stream(root: Node, skip=None):
    """A tree as ("in", node, path), ("text", text, whether in a link) and ("out", node, path), inline elements opened up.

    skip(node, path): subtrees to leave out; a block that is left out still separates texts ("cut").
    """
    path = chain(0, root.label)
    yield "in", root, path
    stack = [[root, 0, path, False]]
    while stack:
        frame = stack[-1]
        node, at, path, linked = frame
        if at == len(node.kids):
            stack.pop()
            if not is_inline(node):
                yield "out", node, path
            elif node.name in SPACED:
                yield "text", " ", linked
            continue
        frame[1] += 1
        kid = node.kids[at]
        if isinstance(kid, str):
            yield "text", kid, linked
            continue
        here = path if is_inline(kid) else chain(path, kid.label)
        if skip is not None and skip(kid, here):
            if not is_inline(kid):
                yield "cut", kid, here
        elif is_inline(kid):
            if kid.name in SPACED:
                yield "text", " ", linked
            stack.append([kid, 0, path, linked or kid.name == "a"])
        else:
            yield "in", kid, here
            stack.append([kid, 0, here, False])


class Group:
    """A group of an expression: an element, or a text slot (label "#")."""

    __slots__ = ("label", "kids", "optional", "repeated", "chars", "linked", "text", "pages")

    def __init__(self, label: str, pages: frozenset, chars: int = 0, linked: int = 0, text: str | None = None) -> None:
        self.label, self.kids, self.optional, self.repeated = label, [], False, False
        self.chars, self.linked, self.text, self.pages = chars, linked, text, pages


def blocks_of(root: Node, skip=None):
    """The stream with texts joined between blocks: ("in" | "out", node, path) and ("text", text, characters in links)."""
    held, links = [], 0
    for event in stream(root, skip):
        if event[0] == "text":
            held.append(event[1])
            if event[2]:
                links += len("".join(event[1].split()))
            continue
        if held:
            text = " ".join("".join(held).split())
            if text:
                yield "text", text, links
            held, links = [], 0
        yield event
    if held and (text := " ".join("".join(held).split())):
        yield "text", text, links


def expression(root: Node) -> Group:
    """A page's regular expression; its page is known by its longest text."""
    longest = max((e[1] for e in blocks_of(root) if e[0] == "text"), key=len, default="")
    pages = frozenset([xxhash.xxh3_64_digest(longest.encode(errors="surrogatepass"))])
    stack = [Group("", pages)]
    for kind, what, more in blocks_of(root):
        if kind == "text":
            bare = len("".join(what.split()))
            stack[-1].kids.append(Group("#", pages, len(what), len(what) if more >= bare else 0, what))
        elif kind == "in":
            stack.append(Group(what.label, pages))
        else:
            done = stack.pop()
            done.kids = folded(done.kids)
            done.chars, done.linked = sum(k.chars for k in done.kids), sum(k.linked for k in done.kids)
            stack[-1].kids.append(done)
    return stack[0].kids[0]


def folded(kids: list[Group]) -> list[Group]:
    """Runs of equal groups of up to three neighbours become one repeated group."""
    out: list[Group] = []
    for kid in kids:
        out.append(kid)
        again = True
        while again:
            again = False
            for size in (1, 2, 3):
                a, b = out[-2 * size : -size], out[-size:]
                if len(a) == size and [k.label for k in a] == [k.label for k in b] and b[0].label != "#":
                    for x, y in zip(a, b):
                        align(x, y).repeated = True
                    del out[-size:]
                    again = True
                    break
    return out


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common sequence; with very many children, of the next equal label each time."""
    if len(a) * len(b) > GREEDY:
        places: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            places.setdefault(b[j], []).append(j)
        out, at = [], 0
        for i, label in enumerate(a):
            own = places.get(label, [])
            while own and own[-1] < at:
                own.pop()
            if own:
                out.append((i, own[-1]))
                at = own.pop() + 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _join(one: Group, two: Group) -> None:
    if one.label == "#" and one.text != two.text:
        one.text = None
    one.chars += two.chars
    one.linked += two.linked
    if one.pages != two.pages:
        one.pages = frozenset(sorted(one.pages | two.pages)[:CONSTANT])
    one.repeated |= two.repeated
    one.optional |= two.optional


def align(one: Group, two: Group) -> Group:
    """Aligns two with one in place: what either lacks is optional; different texts make a variable slot."""
    todo = [(one, two)]
    while todo:
        x, y = todo.pop()
        _join(x, y)
        a, b = [k.label for k in x.kids], [k.label for k in y.kids]
        if a == b:
            todo += zip(x.kids, y.kids)
            continue
        kids, i, j = [], 0, 0
        for m, n in [*matched(a, b), (len(a), len(b))]:
            for k in (*x.kids[i:m], *y.kids[j:n]):
                k.optional = True
                kids.append(k)
            if m < len(a):
                kids.append(x.kids[m])
                todo.append((x.kids[m], y.kids[n]))
            i, j = m + 1, n + 1
        x.kids = kids
    return one


def flat(wrapper: Group) -> list[tuple]:
    """A wrapper as rows in preorder, (depth, label, flags, chars, linked, text, pages): nesting is only a number."""
    out, stack = [], [(wrapper, 0)]
    while stack:
        g, depth = stack.pop()
        out.append((depth, g.label, g.optional | 2 * g.repeated, g.chars, g.linked, g.text, g.pages))
        stack += [(k, depth + 1) for k in reversed(g.kids)]
    return out


def unflat(rows: list[tuple]) -> Group:
    stack: list[Group] = []
    for depth, label, flags, chars, linked, text, pages in rows:
        g = Group(label, pages, chars, linked, text)
        g.optional, g.repeated = bool(flags & 1), bool(flags & 2)
        del stack[depth:]
        if stack:
            stack[-1].kids.append(g)
        stack.append(g)
    return stack[0]


def structure(rows: list[tuple]) -> int:
    """Digest of a wrapper's groups, without texts and counts."""
    h = xxhash.xxh3_64()
    for depth, label, flags, *_ in rows:
        h.update(f"{depth} {flags} {label}\n")
    return h.intdigest()


def merged(one: list[tuple], two: list[tuple]) -> list[tuple]:
    """Wrappers of one structure as one; in any order the same."""
    return [(d, label, flags, x[0] + y[0], x[1] + y[1], x[2] if x[2] == y[2] else None, x[3] if x[3] == y[3] else frozenset(sorted(x[3] | y[3])[:CONSTANT])) for (d, label, flags, *x), (*_, a, b, t, p) in zip(one, two) for y in [(a, b, t, p)]]


def is_main(label: str) -> bool:
    name, *marks = label.rstrip("!").split(".")
    return name in ("article", "main") or any(m in MAIN_MARKS for m in marks)


def rules(wrapper: Group) -> tuple[int, bool, frozenset, frozenset]:
    """(path of the main region, whether it has no mark, keys of constant slots, paths of menus) of a wrapper."""
    groups, parent, path, lost = [], [], [], []
    stack = [(wrapper, -1)]
    while stack:
        g, up = stack.pop()
        at = len(groups)
        groups.append(g)
        parent.append(up)
        path.append(chain(path[up] if up >= 0 else 0, g.label) if g.label != "#" else path[up])
        lost.append(up >= 0 and lost[up] or g.label.endswith("!"))
        stack += [(k, at) for k in reversed(g.kids)]
    def useful(constant: bool):
        keys, menus, out = set(), set(), [0] * len(groups)
        optional, menu = [False] * len(groups), [False] * len(groups)
        for i, g in enumerate(groups):
            up = parent[i]
            optional[i] = g.optional or (up >= 0 and optional[up])
            menu[i] = (up >= 0 and menu[up]) or (constant and g.label != "#" and g.repeated and g.chars > 0 and g.linked == g.chars)
            if menu[i] and not (up >= 0 and menu[up]):
                menus.add(path[i])
            if g.label == "#":
                fixed = constant and g.text is not None and len(g.pages) >= (OPTIONAL if optional[i] else CONSTANT)
                if fixed:
                    keys.add(slot_key(path[i], g.text))
                out[i] = 0 if fixed or lost[i] or menu[i] else g.chars
        for i in range(len(groups) - 1, 0, -1):
            out[parent[i]] += out[i]
        return out, frozenset(keys), frozenset(menus)

    out, keys, menus = useful(True)
    if not out[0]:  # all is constant: nothing tells text from template
        out, keys, menus = useful(False)
    mains, inside = [], [False] * len(groups)
    for i, g in enumerate(groups):
        up = parent[i]
        if up >= 0 and inside[up]:
            inside[i] = True
        elif g.label != "#" and not lost[i] and g.chars and is_main(g.label):
            name = g.label.split(".")[0].rstrip("!")
            if name in ("article", "main") or 2 * out[i] >= out[0]:  # a class alone must hold most of the text
                inside[i] = True
                mains.append((name == "article", g.chars, path[i]))
    if mains:
        # words of classes that are not plain marks count where the template or links bear them out
        doubtful, keys, menus = [False] * len(groups), set(), set()
        for i, g in enumerate(groups):
            up = parent[i]
            doubtful[i] = inside[i] and (up >= 0 and doubtful[up] or g.label.endswith("!"))
            if doubtful[i] and g.label == "#" and g.text is not None and len(g.pages) >= (OPTIONAL if g.optional else CONSTANT):
                keys.add(slot_key(path[i], g.text))
            elif doubtful[i] and g.label.endswith("!") and 0 < g.chars <= 2 * g.linked:
                menus.add(path[i])
        return max(mains)[2], False, frozenset(keys), frozenset(menus)
    kids: list[list[int]] = [[] for _ in groups]
    for i, g in enumerate(groups):
        if i and g.label != "#":
            kids[parent[i]].append(i)
    at = 0
    while True:
        best = max(kids[at], key=lambda i: out[i], default=None)
        if best is None or out[best] < 0.7 * out[at] or groups[best].label.rstrip("!").split(".")[0] in WHOLE:
            return path[at], True, keys, menus
        at = best


def main_text(tree: Node, found: tuple[int, bool, frozenset, frozenset]) -> str | None:
    """Blocks of the elements at the main path, or None if the page has none."""
    main, _, constant, menus = found
    blocks: list[str] = []
    whole: list[str] = []  # with constant ones
    depth, paths = 0, []
    seen = False
    for kind, what, more in blocks_of(tree, lambda node, path: depth > 0 and (node.drop == ALWAYS or path in menus)):
        if kind == "in":
            paths.append(more)
            if depth or more == main:
                depth += 1
                seen = True
        elif kind == "out":
            paths.pop()
            depth -= depth > 0
        elif kind == "text" and depth:
            text = " ".join(html_.unescape(what).split())
            if text:
                whole.append(text)
                if not (constant and slot_key(paths[-1], what) in constant):
                    blocks.append(text)
    return "\n\n".join(blocks or whole) if seen else None


def extract(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, url, text), one per input row."""
    c.prepare(pages.sparkSession)
    slim = c.columns(pages, key=key_col, url=url_col, html=html_col)
    slim = slim.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("")))
    schema = "host string, structure long, pages long, wrapper binary"

    def out(found: dict):
        """Rows (host, structure, pages, wrapper) of {(host, structure): [pages, wrapper rows]}."""
        rows = list(found.items())
        for at in range(0, len(rows), 500):
            part = rows[at : at + 500]
            yield pa.record_batch([pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([pickle.dumps(v[1], 5) for _, v in part], pa.binary())], ["host", "structure", "pages", "wrapper"])

    def add(found: dict, key, n: int, rows: list[tuple]) -> None:
        if key in found:
            found[key] = [found[key][0] + n, merged(found[key][1], rows)]
        else:
            found[key] = [n, rows]

    def infer(batches):
        found: dict = {}
        size = 0
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                rows = flat(expression(parse(text or "")))
                add(found, (host, structure(rows) >> 1), 1, rows)
                size += len(rows)
                if size > 1_000_000:
                    yield from out(found)
                    found, size = {}, 0
        yield from out(found)

    def same(batches):
        """Wrappers of one structure of a host."""
        found: dict = {}
        for batch in batches:
            for host, kind, n, data in zip(*(batch.column(x).to_pylist() for x in ("host", "structure", "pages", "wrapper"))):
                add(found, (host, kind), n, pickle.loads(data))
        yield from out(found)

    def aligned(batches):
        """Wrappers of a host (and group) that come in order, one after the other: (host, group, pages, wrapper)."""
        last, n, own = None, 0, None
        for batch in batches:
            for host, group, m, data in zip(*(batch.column(x).to_pylist() for x in ("host", "structure", "pages", "wrapper"))):
                rows = pickle.loads(data)
                if last == (host, group):
                    own, n = align(own, unflat(rows)), n + m
                else:
                    if last:
                        yield from out({last: [n, flat(own)]})
                    last, n, own = (host, group), m, unflat(rows)
        if last:
            yield from out({last: [n, flat(own)]})

    def decide(batches):
        for batch in batches:
            data = [pickle.dumps(rules(unflat(pickle.loads(w))), 5) for w in batch.column("wrapper").to_pylist()]
            yield pa.record_batch([batch.column("host"), batch.column("pages"), pa.array(data, pa.binary())], ["host", "pages", "rules"])

    unique = slim.select("host", "html").mapInArrow(infer, schema).repartition("host", "structure").mapInArrow(same, schema)
    unique = unique.withColumn("group", F.pmod("structure", F.lit(GROUPS)))
    groups = unique.repartition("host", "group").sortWithinPartitions("host", "group", "structure").select("host", F.col("group").alias("structure"), "pages", "wrapper").mapInArrow(aligned, schema)
    hosts = groups.repartition("host").sortWithinPartitions("host", "structure").select("host", F.lit(0).cast("long").alias("structure"), "pages", "wrapper").mapInArrow(aligned, schema)
    found = c.materialise(hosts.mapInArrow(decide, "host string, pages long, rules binary"), "html-rules")

    def apply(batches):
        known: dict[bytes, tuple] = {}
        for batch in batches:
            texts = []
            for data, page in zip(batch.column("rules").to_pylist(), batch.column("html").to_pylist()):
                if data not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[data] = pickle.loads(data)
                tree = parse(page or "")
                text = main_text(tree, known[data])
                if text is None:
                    text = main_text(tree, rules(expression(tree))) or ""
                texts.append(text)
            yield pa.record_batch([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], ["key", "url", "text"])

    size, total = found.agg(F.coalesce(F.sum(F.length("rules") + F.length("host") + 64), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    both = ["key", "url", "html", "rules"]
    if size <= RULE_BYTES:
        joined = slim.join(F.broadcast(found.select("host", "rules")), "host").select(*both)
    else:
        hot = found.where(F.col("pages") * HOT > total).select("host", "rules")  # HOT rows at most
        rest = slim.join(F.broadcast(hot.select("host")), "host", "left_anti").join(found.select("host", "rules").hint("merge"), "host")
        joined = slim.join(F.broadcast(hot), "host").select(*both).unionByName(rest.select(*both))
    kind = slim.schema["key"].dataType.simpleString()
    return joined.mapInArrow(apply, f"key {kind}, url string, text string")
