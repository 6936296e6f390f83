"""Character sets of fetched bodies, found and named as browsers do."""

from __future__ import annotations

import codecs
import re

from auditmill.sources.tree import Tokens

#: Bytes in which a declaration, or a sign of UTF-8, is looked for.
SNIFFED = 1024
# Labels as browsers read them (UTF-16 also with another dash). Each row: what decodes, then its labels.
LABELS = {
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "shift_jis": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "euc-kr": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "utf-16le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le utf-16-le",
    "utf-16be": "unicodefffe utf-16be utf-16-be",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso-2022-jp": "csiso2022jp iso-2022-jp",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "ibm866": "866 cp866 csibm866 ibm866",
    "gb18030": "gb18030",
}
# Numbered parts and code pages whose labels follow from their number.
PARTS = {2: "latin2 l2", 3: "latin3 l3", 4: "latin4 l4", 5: "cyrillic csisolatincyrillic", 6: "arabic ecma-114 asmo-708", 7: "greek greek8 ecma-118 elot_928", 8: "hebrew visual", 10: "latin6 l6", 13: "", 14: "", 15: "l9", 16: ""}
PAGES = (1250, 1251, 1253, 1255, 1256, 1257, 1258)
# Codecs by other names, where a set's name isn't one.
CODECS = {"windows-874": "cp874", "gbk": "gb18030", "shift_jis": "cp932", "euc-kr": "cp949", "big5": "big5hkscs", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic"}
# How an HTML page may begin, after white space.
_STARTS = re.compile(rb"[\t\n\f\r ]*(?:<!--|<(?:!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p)(?=[ >]))", re.I)
_XML = re.compile(rb"<\?xml[^>?]*\bencoding\s*=\s*[\"']([^\"']+)[\"']", re.I)


def _names() -> dict[str, str]:
    out = {label: name for name, labels in LABELS.items() for label in labels.split()}
    for n, more in PARTS.items():
        out |= {label: f"iso-8859-{n}" for label in [f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}", *more.split()]}
    for n in PAGES:
        out |= {label: f"windows-{n}" for label in (f"windows-{n}", f"cp{n}", f"x-cp{n}")}
    return out


NAMES = _names()


def lookup(label: str | None) -> str | None:
    """The character set of a label, by the name browsers give it; None if no browser knows it."""
    return NAMES.get((label or "").strip("\t\n\f\r ").lower())


def of_content(content: str) -> str:
    """The label in a meta element's content, or a content type."""
    m = re.search(r"charset\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s;\"']+))", content, re.I)
    return (m[1] or m[2] or m[3] or "") if m else ""


def declared(head: bytes) -> str | None:
    """The set that a meta element among the first bytes declares. Comments, scripts and attributes' values declare nothing; a page that could be read isn't UTF-16."""
    for kind, name, attrs, _ in Tokens(head.decode("latin-1")):
        if kind == "start" and name == "meta":
            found = lookup(attrs["charset"]) if "charset" in attrs else lookup(of_content(attrs.get("content", ""))) if attrs.get("http-equiv", "").lower() == "content-type" else None
            if found:
                return "utf-8" if found.startswith("utf-16") else found
    return None


def seems_utf8(head: bytes) -> bool:
    """Whether the bytes hold characters beyond ASCII and all are UTF-8; the last may be cut off."""
    try:
        return not codecs.getincrementaldecoder("utf-8")().decode(head, final=False).isascii()
    except UnicodeDecodeError:
        return False


def determine(body: bytes, content_type: str | None) -> str:
    """An HTML body's set: by its byte order mark, its content type, a meta element, a look at its bytes; else windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if body.startswith(mark):
            return name
    head = body[:SNIFFED]
    return lookup(of_content(content_type or "")) or declared(head) or ("utf-8" if seems_utf8(head) else "windows-1252")


def charset_of(body: bytes, content_type: str | None = None, path: str | None = None) -> str:
    """The set that a body is decoded by; empty where nothing says so, and it stays as it is.

    HTML is what the content type or the first bytes say is HTML. XML (by content type, or the path's end) says it
    in its prolog. Of a body that came without a content type a meta element is believed too. A set without a known
    label is none.
    """
    kind = (content_type or "").partition(";")[0].strip().lower()
    if kind in ("text/html", "application/xhtml+xml") or _STARTS.match(body[:512]):
        return determine(body, content_type)
    if "xml" in kind or (path or "").lower().endswith(".xml"):
        found = _XML.search(body[:512])
        return (lookup(found[1].decode("latin-1")) or "") if found else ""
    return (declared(body[:SNIFFED]) or "") if not kind and b"<meta" in body[:SNIFFED].lower() else ""


def _windows_1252(body: bytes) -> str:
    """Five bytes of windows-1252 that codecs leave out are control characters in browsers."""
    return body.decode("cp1252", "_as_control")


def _as_control(e: UnicodeError) -> tuple[str, int]:
    return "".join(chr(b) for b in e.object[e.start : e.end]), e.end


codecs.register_error("_as_control", _as_control)


def decode(body: bytes | None, content_type: str | None = None, path: str | None = None) -> str:
    """A body as text: by its set, else as UTF-8; what can't be decoded becomes U+FFFD, a byte order mark goes. A null body is empty."""
    body = body or b""
    name = charset_of(body, content_type, path)
    if name.startswith(("windows-", "iso-8859")) or name in ("ibm866", "koi8-r", "koi8-u", "macintosh", "x-mac-cyrillic"):
        codec = CODECS.get(name, name.replace("windows-", "cp"))
        return _windows_1252(body) if codec == "cp1252" else body.decode(codec, "replace")
    return body.decode(CODECS.get(name, name or "utf-8"), "replace").removeprefix("﻿")
