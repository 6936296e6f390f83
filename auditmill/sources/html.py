"""One parse of a page into typed facts; every audit is a column expression over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from auditmill.functions.text import script_name
from auditmill.shared import parts
from auditmill.sources.tree import Node, build

# Elements whose content isn't rendered, for the words of a page and for its visible text.
NO_BODY = frozenset(("script", "style", "noscript", "template", "svg"))
NO_TEXT = NO_BODY - {"svg"}
CODE = re.compile(r"^[a-zA-Z]{2,3}(-[a-zA-Z]{4})?(-([a-zA-Z]{2}|\d{3}))?$")

_S = pa.string()
TYPE = pa.struct(
    [(n, _S) for n in ("title", "crawl_title", "lang", "description", "robots", "viewport", "og_title", "og_description", "og_image", "charset", "canonical", "body_text", "body_script", "visible_text")]
    + [(n, pa.int64()) for n in ("h1_count", "h2_count", "h3_count", "list_count", "table_count")]
    + [(n, pa.bool_()) for n in ("has_author", "has_date", "noindex")]
    + [
        ("h1", pa.list_(_S)), ("paragraphs", pa.list_(_S)), ("anchors", pa.list_(_S)), ("jsonld", pa.list_(_S)),
        ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", _S)]))),
        ("images", pa.list_(pa.struct([("src", _S), ("alt", _S), ("has_size", pa.bool_()), ("lazy", pa.bool_())]))),
        ("hreflang", pa.list_(pa.struct([("hreflang", _S), ("href", _S), ("valid", pa.bool_())]))),
    ]
)

def excludes(directives: str) -> bool:
    """Whether a robots directive list forbids indexing; an agent's name may stand before a directive."""
    return any(d.split(":", 1)[-1].strip() in ("noindex", "none") for d in directives.lower().split(","))


def _text(node: Node) -> str:
    """All text within an element, a space after each run of it."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n + " ")
        else:
            todo.extend(reversed(n.kids))
    return "".join(out)


def _own_text(node: Node) -> str:
    return "".join(k for k in node.kids if isinstance(k, str))


class _Facts:
    """Walks a page's tree in document order."""

    def __init__(self) -> None:
        self.f: dict = {n: "" for n in ("title", "crawl_title", "lang", "description", "robots", "viewport", "og_title", "og_description", "og_image", "charset", "canonical")}
        self.f |= {n: 0 for n in ("h1_count", "h2_count", "h3_count", "list_count", "table_count")}
        self.f |= {n: False for n in ("has_author", "has_date", "noindex")}
        self.f |= {n: [] for n in ("h1", "paragraphs", "anchors", "jsonld", "headings", "images", "hreflang")}

    def element(self, node: Node) -> None:
        """Facts that count wherever an element stands."""
        tag, a, f = node.tag, node.attrs, self.f
        if tag == "html" and "lang" in a:
            f["lang"] = a["lang"]
        elif tag == "title":
            f["title"] = f["title"] or _text(node).strip()
            f["crawl_title"] = f["crawl_title"] or _own_text(node).strip()
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel.strip() == "canonical" and a.get("href"):
                f["canonical"] = a["href"].strip()
            if "alternate" in rel and a.get("hreflang"):
                code = a["hreflang"].strip()
                f["hreflang"].append({"hreflang": code, "href": a.get("href", "").strip(), "valid": code.lower() == "x-default" or bool(CODE.match(code))})
        elif tag == "img":
            f["images"].append({"src": a.get("src", "").strip(), "alt": a.get("alt"), "has_size": bool(a.get("width")) and bool(a.get("height")), "lazy": a.get("loading", "").lower() == "lazy"})
        elif tag == "a" and "href" in a:
            f["anchors"].append(a["href"].strip())
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            if _own_text(node).strip():
                f["jsonld"].append(_own_text(node).strip())
        if tag in ("h1", "h2", "h3"):
            f[f"{tag}_count"] += 1
        if tag == "h1" and _own_text(node).strip():
            f["h1"].append(_own_text(node).strip())

    def rendered(self, node: Node) -> None:
        """Facts of elements that are part of the page's content."""
        tag, a, f = node.tag, node.attrs, self.f
        if tag == "p":
            text = _text(node).strip()
            if text:
                f["paragraphs"].append(text)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            text = _text(node).strip()
            if text and len(f["headings"]) < 100:
                f["headings"].append({"level": int(tag[1]), "text": text[:120]})
        elif tag in ("ul", "ol"):
            f["list_count"] += 1
        elif tag == "table":
            f["table_count"] += 1
        elif tag == "time" and a.get("datetime"):
            f["has_date"] = True
        elif tag == "meta":
            name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
            if name == "author" and content.strip():
                f["has_author"] = True
            if content.strip() and (prop in ("article:published_time", "article:modified_time") or name == "date"):
                f["has_date"] = True
        marks = " ".join(a.get(k, "") for k in ("class", "itemprop")).lower()
        if "author" in a.get("rel", "").lower() or "byline" in marks or "author" in marks:
            f["has_author"] = True

    def _meta(self, a: dict[str, str]) -> None:
        name, prop, content, f = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", ""), self.f
        if a.get("charset"):
            f["charset"] = a["charset"]
        for n, key in (("description", "description"), ("robots", "robots"), ("viewport", "viewport")):
            if name == n:
                f[key] = content.strip()
        for n, key in (("og:title", "og_title"), ("og:description", "og_description"), ("og:image", "og_image")):
            if prop == n:
                f[key] = content.strip()
        if name == "robots" and excludes(content):
            f["noindex"] = True

    def facts(self, page: str) -> dict:
        body, visible, todo = [], [], [(build(page), False, False)]
        while todo:
            node, hidden, unseen = todo.pop()
            if isinstance(node, str):
                if not hidden:
                    body.append(node)
                if not unseen:
                    visible.append(node)
                continue
            self.element(node)
            if not hidden:
                self.rendered(node)
            hidden, unseen = hidden or node.tag in NO_BODY, unseen or node.tag in NO_TEXT
            todo.extend((k, hidden, unseen) for k in reversed(node.kids))
        self.f["body_text"] = " ".join(" ".join(body).split())
        self.f["body_script"] = script_name(self.f["body_text"], self.f["lang"])
        self.f["visible_text"] = " ".join(" ".join(visible).split())
        return self.f


def page_facts(page: str | None) -> dict:
    return _Facts().facts(page or "")


@F.arrow_udf(from_arrow_type(TYPE))
def parse_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All facts of a page. A null page has none, and empty texts."""
    for batch in batches:
        for (html,) in parts(batch):
            yield pa.array([page_facts(h) for h in html.to_pylist()], TYPE)


# what filters say of facts must not be worked out by a parse of its own
parse_page = parse_page.asNondeterministic()


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a column facts. The page is parsed once: what follows reads fields of one struct."""
    return pages.withColumn("facts", parse_page(F.col(html)))


def links(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.anchors").alias("pos", "href"))


def images(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.images").alias("pos", "image")).select(key, "pos", "image.*")


def headings(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.headings").alias("pos", "heading")).select(key, "pos", "heading.*")


def paragraphs(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.paragraphs").alias("pos", "text"))


def alternates(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.hreflang").alias("pos", "link")).select(key, "pos", "link.*")


def jsonld_blocks(facts: DataFrame, key: str) -> DataFrame:
    return facts.select(key, F.posexplode("facts.jsonld").alias("pos", "raw"))
