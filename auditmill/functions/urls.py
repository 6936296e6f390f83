"""URL functions. Absolute ASCII URLs go through column expressions; relative or international ones through one Arrow function."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Click identifiers that don't change a page, asset suffixes, and path segments that hold no content.
TRACKING = ("gclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl")
ASSETS = "jpg jpeg png gif webp avif svg ico css js json xml pdf zip gz mp4 webm woff woff2 ttf eot".split()
NO_CONTENT = ("wp-admin", "admin", "cart", "checkout", "login", "logout", "search", "feed")
_DROP = rf"(?i)^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)"
_SAFE_PATH = "/$&+,;=:@-._~"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"


# ---------------------------------------------------------------- one URL, in Python
def normalize_url(raw: str | None, base: str | None = None) -> str | None:
    """Absolute form: scheme and host lower-case, punycode, no default port, no fragment, escapes made uniform; the query stays."""
    raw = (raw or "").strip()
    try:
        u = urlsplit(urljoin(base, raw) if base else raw)
        host, port = u.hostname or "", u.port
    except ValueError:
        return None
    if not u.scheme or not host or re.search(_BAD_ESCAPE, u.path):
        return None
    try:
        host = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        pass
    host = f"[{host}]" if ":" in host else host
    if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    path = quote(unquote(u.path), safe=_SAFE_PATH)
    return f"{u.scheme.lower()}://{host}{path or '/'}" + (f"?{u.query}" if u.query else "")


def url_key(raw: str | None, base: str | None = None) -> str:
    """What URLs of one page share: normalized, without tracking parameters, parameters in order, no slash at the end."""
    full = normalize_url(raw, base)
    if full is None:
        return (raw or "").strip()
    u = urlsplit(full)
    pairs = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not re.match(_DROP, k))
    path = u.path if u.path == "/" else u.path.rstrip("/") or "/"
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    return f"{u.scheme}://{u.netloc}{path}" + (f"?{query}" if query else "")


@F.arrow_udf(StringType())
def normalize(url: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([normalize_url(u, b or None) for u, b in zip(url.to_pylist(), base.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def key(url: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([url_key(u, b or None) for u, b in zip(url.to_pylist(), base.to_pylist())], pa.string())


def same(a: Column, b: Column, base: Column) -> Column:
    return key(a, base) == key(b, base)


# ---------------------------------------------------------------- absolute ASCII URLs, in the JVM
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def parts(url: Column) -> dict[str, Column]:
    """Scheme and host in lower case without a default port, path, query."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, _PARTS, 1)), F.lower(F.regexp_extract(u, _PARTS, 2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_extract(u, _PARTS, 3)
    return {"scheme": scheme, "host": host, "path": F.when(path == "", "/").otherwise(path), "query": F.regexp_extract(u, _PARTS, 4)}


def _ascii_host(host: Column) -> Column:
    """A host of other letters in its ASCII form; one that has none stays."""
    own = F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(own)).otherwise(host)


def _escaped(path: Column) -> Column:
    """Escapes made uniform, as `normalize_url` makes them: a character that needs none has none."""
    plain = F.url_encode(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    plain = F.replace(F.replace(plain, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in "/$&+,;=:@~":
        plain = F.replace(plain, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(path.rlike("[^A-Za-z0-9/$&+,;=:@._~-]"), F.coalesce(plain, path)).otherwise(path)


def _parsable(url: Column) -> Column:
    return (F.regexp_extract(url, _PARTS, 2) != "") & ~F.regexp_extract(url, _PARTS, 3).rlike(_BAD_ESCAPE)


def normalize_absolute(url: Column) -> Column:
    """`normalize_url` of an absolute URL; null for what is none."""
    p, u = parts(url), F.trim(url)
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
    return F.when(_parsable(u), F.concat(p["scheme"], F.lit("://"), _ascii_host(p["host"]), _escaped(p["path"]), query))


def _form(x: Column) -> Column:
    """A query's name or value, encoded in the one way that forms have."""
    again = F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(x.rlike("[^A-Za-z0-9_.~-]"), again).otherwise(x)


def key_absolute(url: Column) -> Column:
    """`url_key` of an absolute URL; what is none stays as it is."""
    p, u = parts(url), F.trim(url)
    plain = lambda x: F.when(x.rlike("[%+]"), F.coalesce(F.try_url_decode(x), x)).otherwise(x)
    pairs = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), lambda x: F.named_struct(F.lit("k"), plain(F.regexp_extract(x, "^[^=]*", 0)), F.lit("v"), plain(F.regexp_extract(x, "(?s)=(.*)$", 1))))
    pairs = F.array_sort(F.filter(pairs, lambda s: ~s.k.rlike(_DROP)))
    query = F.array_join(F.transform(pairs, lambda s: F.concat(_form(s.k), F.lit("="), _form(s.v))), "&")
    query = F.when(p["query"] == "", "").otherwise(query)
    path = F.when(p["path"] == "/", "/").otherwise(F.regexp_replace(_escaped(p["path"]), "/+$", ""))
    path = F.when(path == "", "/").otherwise(path)
    key = F.concat(p["scheme"], F.lit("://"), _ascii_host(p["host"]), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(_parsable(u), key).otherwise(u)


def without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments."""

    def step(held: Column, part: Column) -> Column:
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", held).otherwise(F.concat(held, F.array(part)))

    whole = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), step)
    ends = path.rlike(r"/\.{1,2}$")  # a dot segment at the end leaves its folder
    tidy = F.concat(F.lit("/"), F.array_join(whole, "/"), F.when(ends & (F.size(whole) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), tidy).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """A reference as it stands in a page of an absolute URL, made absolute (RFC 3986); fragments go."""
    h = F.regexp_extract(F.trim(href), "^[^#]*", 0)
    p, origin = parts(base), origin_of(base)
    path, query = F.regexp_extract(h, r"^[^?]*", 0), F.regexp_extract(h, r"\?.*$", 0)
    folder = F.regexp_replace(p["path"], "[^/]*$", "")
    own = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
    same = F.concat(origin, p["path"], F.when(query == "", own).otherwise(query))
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(p["scheme"], F.lit(":"), h)).when(path == "", same)
        .when(h.startswith("/"), F.concat(origin, without_dots(path), query)).otherwise(F.concat(origin, without_dots(F.concat(folder, path)), query))
    )


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column) -> Column:
    return parts(url)["host"]


def simple_host(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, "^https?://", ""), "^[^/]*", 0)


def domain_target(raw: Column) -> Column:
    """A bare domain from what users type: no scheme, path, port or wildcard."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim(raw), "^https?://", ""), "^[^/:]*", 0), r"^\*\.", "")


def is_origin(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3).isin("", "/") & (F.regexp_extract(url, _PARTS, 4) == "") & ~F.contains(url, F.lit("?"))


def origin_of(url: Column) -> Column:
    p = parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["host"])


def same_origin(url: Column, origin_host: Column) -> Column:
    """Whether an absolute http(s) URL has the host; the scheme doesn't matter."""
    p = parts(url)
    return p["scheme"].isin("http", "https") & (p["host"] == F.lower(origin_host))


def crawlable_path(path: Column) -> Column:
    low = F.lower(path)
    return ~low.rlike(rf"\.({'|'.join(ASSETS)})$") & ~F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(s) for s in NO_CONTENT]))


def robots_targets(url: Column) -> tuple[Column, Column]:
    """The path with query as escaped and as decoded; robots rules are matched against both."""
    p = parts(url)
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
    return F.concat(p["path"], query), F.concat(F.coalesce(F.try_url_decode(F.regexp_replace(p["path"], r"\+", "%2B")), p["path"]), query)


def store_key(page_key: Column) -> Column:
    return F.substring(F.sha2(page_key, 256), 1, 16)


def legacy_store_key(url: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.trim(url), "/+$", "")), 256), 1, 16)


def link_kind(href: Column, page_host: Column) -> Column:
    """internal, external or skipped, for an href as it stands in a page of an absolute URL."""
    h = F.trim(href)
    skipped = (h == "") | h.rlike("(?i)^(mailto:|tel:|javascript:)") | h.startswith("#")
    absolute = h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    inside = (~absolute & ~h.startswith("//")) | (host_of(h) == page_host) | (h.startswith("//") & (F.lower(F.regexp_extract(h, "^//([^/?#]*)", 1)) == page_host))
    return F.when(skipped, "skipped").when(inside, "internal").otherwise("external")


# ---------------------------------------------------------------- addresses that a fetcher must not reach
def blocked_ipv4(address: Column) -> Column:
    """Loopback, private, link-local, shared, multicast or unspecified; what is no address is blocked too."""
    o = F.transform(F.split(address, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    fine = (F.size(o) == 4) & F.forall(o, lambda x: x.isNotNull() & (x >= 0) & (x <= 255))
    inner = (a == 0) | (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a.between(224, 239))
    return F.coalesce(~fine | inner, F.lit(True))


def is_blocked(address: str | None) -> bool:
    """Whether an address of either version lies where no fetcher may reach; what is no address does."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    shared = ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")
    return ip.is_loopback or ip.is_private or ip.is_multicast or ip.is_unspecified or ip.is_link_local or shared


@F.arrow_udf(BooleanType())
def blocked_address(address: pa.Array) -> pa.Array:
    """blocked_ipv4 for addresses of either version."""
    return pa.array([is_blocked(s) for s in address.to_pylist()])
