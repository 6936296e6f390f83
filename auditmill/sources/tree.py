"""Markup to a tree of elements as browsers build it: raw text, implied tags, tables that push stray content out, formatting that goes on.

A small helper of the page parser (html.py), which reads facts from the tree. Tokens come from regular
expressions; each insertion mode is one method that takes a token, or names the mode that shall take it.
Scripting counts as on, so what stands in noscript is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

# Element classes of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style xmp".split())
RCDATA = frozenset(("title", "textarea"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCKS | HEADINGS | VOID | RAW | RCDATA | frozenset("applet body button caption colgroup dd dt form head html li listing marquee object plaintext pre select table tbody td template tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html marquee object table td template th".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
SPACE = " \t\n\f\r"
UNPARSED, BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = RAW | RCDATA, SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset(("html", "table", "template"))
UNREAD, HEAD_ONLY, LIST_STOPS, CLOSED_WHOLE = UNPARSED | {"plaintext"}, IN_HEAD - {"noscript"}, SPECIAL - {"address", "div", "p"}, (BLOCKS - {"p"}) | {"button", "listing", "pre"}
OF_TABLE, IGNORED_IN_TABLE, NOT_IN_BODY = TABLE_PARTS | {"table"}, TABLE_PARTS | {"body", "html"}, TABLE_PARTS | {"frame", "frameset", "head"}
#: Elements that are open at once; what is nested deeper stands side by side, so that time stays in proportion to the page.
DEEPEST = 512

_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)")
_ATTR = re.compile(r"[\s/]*(?:(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?)")
_COMMENT_END = re.compile(r"--!?>")
_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9;])))")
_QUIRKS = re.compile(r"-//(?!w3c//dtd (?:x?html 1|html 4\.01//|html 4\.0//))|-//w3c//dtd html 4\.01 (?:transitional|frameset)//[^\"']*[\"']\s*$", re.I)


class Node:
    """An element. kids are elements and strings; a comment is an element named #comment, which parts the strings around it."""

    __slots__ = ("attrs", "foreign", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: str = "") -> None:
        self.tag, self.attrs, self.foreign, self.kids, self.parent = tag, attrs or {}, foreign, [], None

    def put(self, kid: Node | str, at: int | None = None) -> None:
        at = len(self.kids) if at is None else at
        if isinstance(kid, Node):
            kid.parent = self
            self.kids.insert(at, kid)
        elif at and isinstance(self.kids[at - 1], str):
            self.kids[at - 1] += kid
        else:
            self.kids.insert(at, kid)

    def leave(self) -> None:
        if self.parent:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None


# ---------------------------------------------------------------- tokens
def _attr_value(m: re.Match) -> str:
    ref = m[0]
    return unescape(ref) if ref[1] == "#" or ref[1:] in html5 else ref


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from `at` on (the first of a name counts), whether the tag closes itself, and the place after it; -1 if it never ends."""
    attrs: dict[str, str] = {}
    size = len(page)
    while at < size and page[at] != ">":
        m = _ATTR.match(page, at)
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if m[0].rstrip(SPACE).endswith("=") and page[m.end() : m.end() + 1] in ("'", '"'):
            return attrs, False, -1  # a quote that never ends
        if m[1]:
            attrs.setdefault(m[1].lower(), _REF.sub(_attr_value, value) if "&" in value else value)
        at = m.end() if m.end() > at else at + 1
    return attrs, page[at - 1 : at] == "/", at + 1 if at < size else -1


def _script_end(page: str, at: int) -> int:
    """Where a script's text ends: an end tag within a commented script that opened another doesn't count."""
    depth, edge = 0, re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
    for m in edge.finditer(page, at):
        if m[0] == "<!--":
            depth = max(depth, 1)
        elif m[0] == "-->":
            depth = 0
        elif not m[1]:
            depth = 2 if depth else 0
        elif depth < 2:
            return m.start()
        else:
            depth = 1
    return len(page)


class Tokens:
    """Tokens of a page: (kind, name or text, attributes, closes itself). The builder says when it is in foreign content, where nothing is raw."""

    def __init__(self, page: str) -> None:
        self.page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        self.foreign = False

    def __iter__(self) -> Iterator[tuple[str, str, dict, bool]]:
        page, at, size = self.page, 0, len(self.page)
        none: dict = {}
        while at < size:
            mark = page.find("<", at)
            tag = _TAG.match(page, mark) if mark >= 0 else None
            while mark >= 0 and not tag and page[mark + 1 : mark + 2] not in ("!", "?", "/"):
                mark = page.find("<", mark + 1)
                tag = _TAG.match(page, mark) if mark >= 0 else None
            if mark < 0 or (page[mark:] == "</"):
                yield "text", unescape(page[at:]), none, False
                return
            if mark > at:
                yield "text", unescape(page[at:mark]), none, False
            if not tag:
                at, token = self._marked(mark)
                if token:
                    yield token
                continue
            name = tag[2].lower()
            attrs, closed, at = _attributes(page, tag.end())
            if at < 0:
                return
            if tag[1]:
                yield "end", name, none, False
                continue
            yield "start", name, attrs, closed
            if self.foreign or name not in UNREAD:
                continue
            if name == "script":
                end = _script_end(page, at)
            else:
                found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at) if name != "plaintext" else None
                end = found.start() if found else size
            if end > at:
                yield "text", unescape(page[at:end]) if name in RCDATA else page[at:end], none, True
            at = end

    def _marked(self, at: int) -> tuple[int, tuple | None]:
        """Comments, doctypes and what else isn't a tag."""
        page = self.page
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                return page.index(">", at) + 1, ("comment", "", {}, False)
            m = _COMMENT_END.search(page, at + 4)
            return (m.end() if m else len(page)), ("comment", "", {}, False)
        if self.foreign and page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            return (end + 3 if end >= 0 else len(page)), ("text", page[at + 9 : end if end >= 0 else len(page)], {}, False)
        end = page.find(">", at)
        after = end + 1 if end >= 0 else len(page)
        if page[at : at + 9].lower() == "<!doctype":
            return after, ("doctype", page[at + 9 : after - 1].strip(), {}, False)
        return after, None if page.startswith("</>", at) else ("comment", "", {}, False)


# ---------------------------------------------------------------- tree
class Builder:
    def __init__(self, page: str) -> None:
        self.root = Node("#document")
        self.open: list[Node] = []
        self.formats: list[Node | None] = []  # None marks where a cell, caption or object begins
        self.head = self.form = None
        self.quirks, self.foster, self.mode, self.templates = True, False, "initial", []
        self.skip_newline = False
        tokens = Tokens(page)
        for token in tokens:
            self.take(token)
            tokens.foreign = bool(self.open) and bool(self.open[-1].foreign) and not self._is_html_point(self.open[-1])
        for mode in ("initial", "before_html", "before_head", "in_head", "after_head"):  # a page that ends early has a body all the same
            if self.mode == mode:
                getattr(self, mode)(("end", "body", {}, False)) if mode != "initial" else setattr(self, "mode", "before_html")

    # ---- places
    @property
    def top(self) -> Node:
        return self.open[-1]

    def place(self, over: Node | None = None) -> tuple[Node, int | None]:
        """Where the next node goes: into the open element, or before its table if that may not hold it."""
        to = over or self.top
        if not (self.foster and to.tag in ("table", "tbody", "tfoot", "thead", "tr")):
            return to, None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == "template":
                return self.open[i], None
            if self.open[i].tag == "table":
                table = self.open[i]
                if table.parent:
                    kids = table.parent.kids
                    return table.parent, next(n for n in range(len(kids) - 1, -1, -1) if kids[n] is table)
                return self.open[i - 1], None
        return self.open[0], None

    def text(self, data: str) -> None:
        to, at = self.place()
        to.put(data, at)

    def insert(self, tag: str, attrs: dict | None = None, foreign: str = "") -> Node:
        node = Node(tag, attrs, foreign)
        to, at = self.place()
        to.put(node, at)
        if len(self.open) < DEEPEST:
            self.open.append(node)
        return node

    def void(self, tag: str, attrs: dict, foreign: str = "") -> None:
        to, at = self.place()
        to.put(Node(tag, attrs, foreign), at)

    # ---- stack of open elements
    def has(self, *tags: str, limits: frozenset = SCOPE) -> bool:
        for n in reversed(self.open):
            if n.tag in tags and not n.foreign:
                return True
            if n.tag in limits or self._is_html_point(n):
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while self.open:
            if self.open.pop().tag in tags:
                return

    def imply(self, but: str = "", every: bool = False) -> None:
        while self.top.tag != but and (self.top.tag in IMPLIED or every and self.top.tag in TABLE_PARTS):
            self.open.pop()

    def end_p(self) -> None:
        if self.has("p", limits=BUTTON_SCOPE):
            self.imply("p")
            self.pop_to("p")

    def back_to(self, *tags: str) -> None:
        while self.top.tag not in (*tags, "html", "template"):
            self.open.pop()

    @staticmethod
    def _is_html_point(n: Node) -> bool:
        """Foreign elements whose content is HTML again."""
        return n.foreign == "svg" and n.tag in ("foreignobject", "desc", "title") or n.foreign == "math" and n.tag in ("mi", "mo", "mn", "ms", "mtext")

    # ---- formatting elements
    def go_on(self) -> None:
        """Opens again the formatting elements that an end tag closed too early."""
        at = len(self.formats)
        while at and self.formats[at - 1] is not None and self.formats[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.formats)):
            self.formats[i] = self.insert(self.formats[i].tag, self.formats[i].attrs)

    def format(self, node: Node) -> None:
        same = []
        for n in reversed(self.formats):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self.formats.remove(same[-1])
        self.formats.append(node)

    def clear_formats(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    def _last_format(self, tag: str) -> Node | None:
        for n in reversed(self.formats):
            if n is None:
                return None
            if n.tag == tag:
                return n
        return None

    def adopt(self, tag: str) -> None:
        """An end tag of a formatting element: what it wrongly holds is parted into pieces that each have their own copy."""
        if self.top.tag == tag and self.top not in self.formats:
            self.open.pop()
            return
        for _ in range(8):
            node = self._last_format(tag)
            if node is None:
                self.any_end(tag)
                return
            if node not in self.open:
                self.formats.remove(node)
                return
            if not self.has(tag):
                return
            at = self.open.index(node)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formats.remove(node)
                return
            self._adopt_block(node, at, block)

    def _adopt_block(self, node: Node, at: int, block: Node) -> None:
        common, bookmark = self.open[at - 1], self.formats.index(node)
        last, i, steps = block, self.open.index(block), 0
        while True:
            i, steps = i - 1, steps + 1
            inner = self.open[i]
            if inner is node:
                break
            if steps > 3 and inner in self.formats:
                bookmark -= self.formats.index(inner) < bookmark
                self.formats.remove(inner)
            if inner not in self.formats:
                self.open.remove(inner)
                continue
            copy = Node(inner.tag, inner.attrs)
            k = self.formats.index(inner)
            self.formats[k] = self.open[i] = copy
            if last is block:
                bookmark = k + 1
            last.leave()
            copy.put(last)
            last = copy
        last.leave()
        to, where = self.place(common)
        to.put(last, where)
        copy = Node(node.tag, node.attrs)
        for kid in block.kids:
            copy.put(kid)
        block.kids = []
        block.put(copy)
        was = self.formats.index(node)
        self.formats.insert(bookmark, copy)
        del self.formats[was + (bookmark <= was)]
        self.open.remove(node)
        self.open.insert(self.open.index(block) + 1, copy)

    # ---- dispatch
    def take(self, token: tuple) -> None:
        kind, name, attrs, closed = token
        if self.skip_newline:
            self.skip_newline = False
            if kind == "text" and name.startswith("\n"):
                token = (kind, name[1:], attrs, closed)
                if not token[1]:
                    return
        if kind == "comment":
            (self.top if self.open else self.root).put(Node("#comment"))
            return
        if self.open and self.top.foreign and self._foreign(token):
            return
        mode = self.mode
        while mode:
            mode = getattr(self, mode)(token)
            if mode:
                self.mode = mode if mode in MODES else self.mode

    def _foreign(self, token: tuple) -> bool:
        kind, name, attrs, closed = token
        if self._is_html_point(self.top) and (kind == "text" or kind == "start" and name not in ("mglyph", "malignmark")):
            return False
        if kind == "text":
            self.text(name)
        elif kind == "start":
            if name in BREAKOUT or name == "font" and attrs.keys() & {"color", "face", "size"}:
                while self.top.foreign and not self._is_html_point(self.top):
                    self.open.pop()
                return False
            (self.void if closed else self.insert)(name, attrs, self.top.foreign)
        elif kind == "end":
            for i in range(len(self.open) - 1, -1, -1):
                if not self.open[i].foreign:
                    return False
                if self.open[i].tag == name:
                    del self.open[i:]
                    break
        return True

    # ---- insertion modes: each takes the token or names the mode that does
    def initial(self, token: tuple) -> str | None:
        kind, name = token[:2]
        if kind == "text" and not name.strip(SPACE):
            return None
        self.mode = "before_html"
        if kind == "doctype":
            self.quirks = not re.match(r"html\b", name, re.I) or bool(_QUIRKS.search(name))
            return None
        return "before_html"

    def before_html(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "doctype" or kind == "text" and not name.strip(SPACE) or kind == "end" and name not in ("head", "body", "html", "br"):
            return None
        node = Node("html", dict(attrs) if (kind, name) == ("start", "html") else {})
        self.root.put(node)
        self.open.append(node)
        self.mode = "before_head"
        return None if (kind, name) == ("start", "html") else "before_head"

    def before_head(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "doctype" or kind == "text" and not name.strip(SPACE) or kind == "end" and name not in ("head", "body", "html", "br"):
            return None
        if (kind, name) == ("start", "html"):
            return self.in_body(token)
        self.head = self.insert("head", attrs if (kind, name) == ("start", "head") else {})
        self.mode = "in_head"
        return None if (kind, name) == ("start", "head") else "in_head"

    def in_head(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "text" and self.top.tag in UNPARSED:
            self.text(name)
        elif kind == "end" and name == self.top.tag and name in UNPARSED:
            self.open.pop()
        elif kind == "text" and not name.strip(SPACE):
            self.text(name)
        elif (kind, name) == ("start", "html"):
            return self.in_body(token)
        elif kind == "start" and name in IN_HEAD:
            if name == "template":
                self.insert(name, attrs)
                self.formats.append(None)
                self.templates.append("in_template")
                self.mode = "in_template"
            elif name in VOID:
                self.void(name, attrs)
            else:
                self.insert(name, attrs)
        elif (kind, name) == ("end", "template"):
            if any(n.tag == "template" for n in self.open):
                self.pop_to("template")
                self.clear_formats()
                self.templates.pop()
                self.reset()
        elif kind == "doctype" or (kind, name) == ("start", "head") or kind == "end" and name not in ("head", "body", "html", "br"):
            return None
        else:
            while self.top.tag != "html" and len(self.open) > 1:
                self.open.pop()
            self.mode = "after_head"
            return None if (kind, name) == ("end", "head") else "after_head"
        return None

    def after_head(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "text" and not name.strip(SPACE) and self.top.tag == "html":
            self.text(name)
            return None
        if kind == "start" and name in HEAD_ONLY:
            self.open.append(self.head)
            out = self.in_head(token)
            if self.head in self.open and self.top is not self.head and name in UNPARSED:
                self.open.remove(self.head)
                self.mode = "text_after_head"
            elif self.head in self.open:
                self.open.remove(self.head)
            return out
        if kind == "doctype" or kind == "end" and name not in ("body", "html", "br", "template") or (kind, name) == ("start", "head"):
            return None
        if (kind, name) == ("end", "template"):
            return self.in_head(token)
        if (kind, name) == ("start", "html"):
            return self.in_body(token)
        if (kind, name) == ("start", "frameset"):
            self.insert(name, attrs)
            self.mode = "in_frameset"
            return None
        self.insert("body", attrs if (kind, name) == ("start", "body") else {})
        self.mode = "in_body"
        return None if (kind, name) == ("start", "body") else "in_body"

    def text_after_head(self, token: tuple) -> str | None:
        """A title, style or script between head and body."""
        if token[0] == "text":
            self.text(token[1])
            return None
        self.open.pop()
        self.mode = "after_head"
        return None if token[0] == "end" else "after_head"

    def in_frameset(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "start" and name == "frameset":
            self.insert(name, attrs)
        elif kind == "start" and name == "frame":
            self.void(name, attrs)
        elif kind == "end" and name == "frameset" and self.top.tag == name and len(self.open) > 1:
            self.open.pop()
        return None

    def in_template(self, token: tuple) -> str | None:
        kind, name = token[:2]
        if kind == "start" and name not in IN_HEAD:
            mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_columns", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_body")
            self.templates[-1] = self.mode = mode
            return mode
        return self.in_body(token)

    def in_body(self, token: tuple) -> str | None:
        kind, name, attrs, closed = token
        if kind == "text":
            if self.top.tag not in UNPARSED and name.strip(SPACE) or self.formats and self.top.tag not in UNPARSED:
                self.go_on()
            self.text(name)
        elif kind == "start":
            return self._start(name, attrs, closed, token)
        elif kind == "end":
            return self._end(name, token)
        return None

    def _start(self, name: str, attrs: dict, closed: bool, token: tuple) -> str | None:
        if self.top.tag in UNPARSED and not self.top.foreign:
            self.open.pop()  # raw text that never ended
        if name in ("html", "body"):
            node = self.open[0] if name == "html" else next((n for n in self.open[1:2] if n.tag == "body"), None)
            for k, v in attrs.items() if node and not self.templates else ():
                node.attrs.setdefault(k, v)
        elif name in HEAD_ONLY:
            return self.in_head(token)
        elif name in BLOCKS:
            self.end_p()
            self.insert(name, attrs)
        elif name in HEADINGS:
            self.end_p()
            if self.top.tag in HEADINGS:
                self.open.pop()
            self.insert(name, attrs)
        elif name in ("pre", "listing"):
            self.end_p()
            self.insert(name, attrs)
            self.skip_newline = True
        elif name == "form":
            if not self.form or self.templates:
                self.end_p()
                node = self.insert(name, attrs)
                self.form = self.form if self.templates else node
        elif name in ("li", "dd", "dt"):
            same = ("li",) if name == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if n.tag in same:
                    self.imply(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in LIST_STOPS:
                    break
            self.end_p()
            self.insert(name, attrs)
        elif name == "plaintext":
            self.end_p()
            self.insert(name, attrs)
        elif name == "button":
            if self.has("button"):
                self.imply()
                self.pop_to("button")
            self.go_on()
            self.insert(name, attrs)
        elif name in FORMATTING:
            old = self._last_format("a") if name == "a" else None
            if old:
                self.adopt("a")
                self.formats = [n for n in self.formats if n is not old]
                self.open = [n for n in self.open if n is not old]
            self.go_on()
            if name == "nobr" and self.has("nobr"):
                self.adopt("nobr")
                self.go_on()
            self.format(self.insert(name, attrs))
        elif name in ("applet", "marquee", "object"):
            self.go_on()
            self.insert(name, attrs)
            self.formats.append(None)
        elif name == "table":
            if not self.quirks:
                self.end_p()
            self.insert(name, attrs)
            self.mode = "in_table"
        elif name == "hr":
            self.end_p()
            self.void(name, attrs)
        elif name in VOID or name == "image":
            if name not in ("param", "source", "track"):
                self.go_on()
            self.void("img" if name == "image" else name, attrs)
        elif name == "textarea":
            self.insert(name, attrs)
            self.skip_newline = True
        elif name in RAW:
            if name == "xmp":
                self.end_p()
                self.go_on()
            self.insert(name, attrs)
        elif name == "select":
            self.go_on()
            self.insert(name, attrs)
            self.mode = "in_select"
        elif name in ("optgroup", "option"):
            if self.top.tag == "option":
                self.open.pop()
            self.go_on()
            self.insert(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.imply("rtc" if name in ("rp", "rt") else "")
            self.insert(name, attrs)
        elif name in ("math", "svg"):
            self.go_on()
            (self.void if closed else self.insert)(name, attrs, name)
        elif name not in NOT_IN_BODY:
            self.go_on()
            self.insert(name, attrs)
        return None

    def _end(self, name: str, token: tuple) -> str | None:
        if name == "template":
            return self.in_head(token)
        if name in ("body", "html"):
            return None  # what follows still belongs to the body
        if name in UNPARSED and self.top.tag == name:
            self.open.pop()
        elif name in CLOSED_WHOLE:
            if self.has(name):
                self.imply()
                self.pop_to(name)
        elif name == "form":
            node, self.form = self.form, None if not self.templates else self.form
            if node in self.open and self.has("form"):
                self.imply()
                self.open.remove(node)
        elif name == "p":
            if not self.has("p", limits=BUTTON_SCOPE):
                self.insert("p")
            self.imply("p")
            self.pop_to("p")
        elif name in ("li", "dd", "dt"):
            if self.has(name, limits=LIST_SCOPE if name == "li" else SCOPE):
                self.imply(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.has(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self.has(name):
                self.imply()
                self.pop_to(name)
                self.clear_formats()
        elif name == "br":
            self.go_on()
            self.void("br", {})
        else:
            self.any_end(name)
        return None

    def any_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            n = self.open[i]
            if n.tag == name:
                self.imply(name)
                del self.open[i:]
                return
            if n.tag in SPECIAL:
                return

    # ---- tables
    def _stray(self, token: tuple) -> str | None:
        self.foster = True
        out = self.in_body(token)
        self.foster = False
        return out

    def in_table(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "text" and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if name.strip(SPACE):
                return self._stray(token)
            self.text(name)
        elif kind == "start" and name in TABLE_PARTS:
            self.back_to("table")
            if name == "caption":
                self.formats.append(None)
                self.insert(name, attrs)
                self.mode = "in_caption"
            elif name in ("colgroup", "col"):
                self.insert("colgroup", attrs if name == "colgroup" else {})
                self.mode = "in_columns"
                return None if name == "colgroup" else "in_columns"
            else:
                whole = name in ("tbody", "tfoot", "thead")
                self.insert(name if whole else "tbody", attrs if whole else {})
                self.mode = "in_table_body"
                return None if whole else "in_table_body"
        elif (kind, name) == ("start", "table"):
            if self.has("table", limits=frozenset(("html", "template"))):
                self.pop_to("table")
                self.reset()
                return self.mode
        elif (kind, name) == ("end", "table"):
            if self.has("table", limits=frozenset(("html", "template"))):
                self.pop_to("table")
                self.reset()
        elif kind == "end" and name in IGNORED_IN_TABLE:
            return None
        elif kind == "start" and name in ("style", "script", "template") or (kind, name) == ("end", "template"):
            return self.in_head(token)
        elif (kind, name) == ("start", "input") and attrs.get("type", "").lower() == "hidden":
            self.void(name, attrs)
        elif (kind, name) == ("start", "form"):
            if not self.form and not self.templates:
                self.form = self.insert(name, attrs)
                if self.top is self.form:
                    self.open.pop()
        elif kind != "doctype":
            return self._stray(token)
        return None

    def in_caption(self, token: tuple) -> str | None:
        kind, name = token[:2]
        if (kind, name) == ("end", "caption") or kind == "start" and name in TABLE_PARTS or (kind, name) == ("end", "table"):
            if not self.has("caption", limits=TABLE_SCOPE):
                return None
            self.imply()
            self.pop_to("caption")
            self.clear_formats()
            self.mode = "in_table"
            return None if name == "caption" and kind == "end" else "in_table"
        return None if kind == "end" and name in IGNORED_IN_TABLE else self.in_body(token)

    def in_columns(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "text" and not name.strip(SPACE):
            self.text(name)
        elif (kind, name) == ("start", "col"):
            self.void(name, attrs)
        elif kind == "start" and name == "template" or (kind, name) == ("end", "template"):
            return self.in_head(token)
        elif kind != "doctype" and (kind, name) != ("end", "col") and self.top.tag == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            return None if (kind, name) == ("end", "colgroup") else "in_table"
        return None

    def in_table_body(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        sections = ("tbody", "tfoot", "thead")
        if kind == "start" and name in ("tr", "td", "th"):
            self.back_to(*sections)
            self.insert("tr", attrs if name == "tr" else {})
            self.mode = "in_row"
            return None if name == "tr" else "in_row"
        if kind == "end" and name in sections:
            if self.has(name, limits=TABLE_SCOPE):
                self.back_to(*sections)
                self.open.pop()
                self.mode = "in_table"
            return None
        if kind == "start" and name in TABLE_PARTS or (kind, name) == ("end", "table"):
            if self.has(*sections, limits=TABLE_SCOPE):
                self.back_to(*sections)
                self.open.pop()
                self.mode = "in_table"
                return "in_table"
            return None
        return self.in_table(token)

    def in_row(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "start" and name in ("td", "th"):
            self.back_to("tr")
            self.insert(name, attrs)
            self.formats.append(None)
            self.mode = "in_cell"
            return None
        if kind == "end" and name == "tr" or kind == "start" and name in TABLE_PARTS or kind == "end" and name in ("table", "tbody", "tfoot", "thead"):
            if kind == "end" and name != "tr" and not self.has(name, limits=frozenset(("html", "template"))):
                return None
            if self.has("tr", limits=TABLE_SCOPE):
                self.back_to("tr")
                self.open.pop()
                self.mode = "in_table_body"
                return None if name == "tr" and kind == "end" else "in_table_body"
            return None
        return self.in_table(token)

    def in_cell(self, token: tuple) -> str | None:
        kind, name = token[:2]
        here = TABLE_SCOPE
        ends = kind == "end" and name in ("td", "th", "table", "tbody", "tfoot", "thead", "tr")
        if kind == "start" and name in TABLE_PARTS or ends:
            if ends and not self.has(name, limits=here - {"table"} if name == "table" else here):
                return None
            if self.has("td", "th", limits=here):
                self.imply()
                self.pop_to("td", "th")
                self.clear_formats()
                self.mode = "in_row"
                return None if kind == "end" and name in ("td", "th") else "in_row"
            return None
        return None if kind == "end" and name in ("body", "caption", "col", "colgroup", "html") else self.in_body(token)

    def in_select(self, token: tuple) -> str | None:
        kind, name, attrs, _ = token
        if kind == "text":
            self.text(name)
        elif kind == "start" and name in ("option", "optgroup", "hr"):
            while self.top.tag == "option" or name != "option" and self.top.tag == "optgroup":
                self.open.pop()
            if name == "hr":
                self.void(name, attrs)
            else:
                self.insert(name, attrs)
        elif kind == "end" and name in ("option", "optgroup"):
            if name == "optgroup" and self.top.tag == "option" and self.open[-2].tag == "optgroup":
                self.open.pop()
            if self.top.tag == name:
                self.open.pop()
        elif kind == "start" and name in ("script", "template") or kind == "end" and name in ("script", "template"):
            return self.in_head(token)
        elif name in ("select", "input", "textarea", "keygen") or name in OF_TABLE:
            self.pop_to("select")
            self.reset()
            return None if name == "select" or kind == "end" and name not in OF_TABLE else self.mode
        return None

    def reset(self) -> None:
        """The mode that the open elements ask for."""
        of = {"select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_columns", "table": "in_table", "body": "in_body", "head": "in_head"}
        for n in reversed(self.open):
            if n.tag == "template":
                self.mode = self.templates[-1]
                return
            if n.tag in of:
                self.mode = of[n.tag]
                return
        self.mode = "after_head" if self.head else "before_head"


MODES = frozenset("initial before_html before_head in_head after_head text_after_head in_frameset in_template in_body in_table in_caption in_columns in_table_body in_row in_cell in_select".split())


def build(page: str) -> Node:
    """The tree of a page. Markup that never closes, closes twice or stands in the wrong place has a place all the same; an empty page has an empty body."""
    return Builder(page).root


def shown(node: Node) -> str:
    """A tree as nested text, for tests and fixtures: tag(kids), strings in quotes."""
    inner = " ".join(shown(k) if isinstance(k, Node) else repr(k) for k in node.kids if not (isinstance(k, Node) and k.tag == "#comment"))
    return f"{node.tag}({inner})" if inner else node.tag
