"""Fetched bodies: size caps, content types, sniffing, character sets; and a live reader for where there is a network."""

from __future__ import annotations

import http.client
import socket
import ssl
import time
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from auditmill.functions.urls import is_blocked
from auditmill.sources import charset

# What a client keeps to unless told otherwise.
MAX_BODY, TIMEOUT_S, MAX_REDIRECTS = 15 << 20, 15, 10


def truncated(body: Column, cap: int = MAX_BODY) -> Column:
    return F.octet_length(body) > cap


def capped(body: Column, cap: int = MAX_BODY) -> Column:
    return F.substring(body, 1, cap)


def content_type(header: Column) -> Column:
    """The media type without parameters."""
    return F.trim(F.get(F.split(header, ";"), F.lit(0)))


def looks_like_html(body: Column) -> Column:
    """Whether the first 512 characters begin an HTML page, after white space and a byte order mark."""
    return F.lower(F.regexp_replace(F.substring(body, 1, 512), r"^[\s\x{FEFF}]+", "")).rlike("^(<!doctype html|<html)")


def is_html(header: Column, body: Column) -> Column:
    kind = F.lower(content_type(F.coalesce(header, F.lit(""))))
    return F.when(kind == "", looks_like_html(body)).otherwise(kind.isin("text/html", "application/xhtml+xml"))


def decode_body(body: bytes | None, header: str | None = None) -> str:
    return charset.decode(body, header)


@F.arrow_udf(StringType())
def decoded(body: pa.Array, header: pa.Array) -> pa.Array:
    """Bodies as text, by their content types and bytes (see charset)."""
    return pa.array([charset.decode(b, h) for b, h in zip(body.to_pylist(), header.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def charset_name(body: pa.Array, header: pa.Array) -> pa.Array:
    """The sets that `decoded` goes by; empty where a body stays as it is."""
    return pa.array([charset.charset_of(b or b"", h) for b, h in zip(body.to_pylist(), header.to_pylist())], pa.string())


_HEADERS, _TIMINGS = "map<string,array<string>>", "struct<dns_ms:bigint,connect_ms:bigint,tls_ms:bigint,ttfb_ms:bigint,total_ms:bigint>"


class WebSource(DataSource):
    """Reads URLs from the web: spark.read.format("web").option("urls", "one a line").load().

    Redirects are followed hop by hop, each kept with its status, headers and timings. Every hop's name is looked up
    once, all its addresses are checked, and the connection goes to one of those; no address inside a network is
    reached, and no proxy is used, which would look names up by itself. Zipped bodies are inflated up to the cap; that
    they came zipped stays in their headers. Options: maxBody, timeout, maxRedirects, userAgent, acceptLanguage, and
    allowPrivate, for tests alone. Queries don't need the source: they work on snapshots.
    """

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return (
            "url string, final_url string, status int, hops int, content_type string, charset string, body binary, truncated boolean, error string, ttfb_ms long, "
            f"headers {_HEADERS}, timings {_TIMINGS}, redirects array<struct<url:string,status:int,headers:{_HEADERS},timings:{_TIMINGS}>>"
        )

    def reader(self, schema):
        return _WebReader(self.options)


class _Link(http.client.HTTPConnection):
    """A connection to an address that was looked at, whatever another look-up of the name would give."""

    def __init__(self, host: str, port: int | None, secure: bool, timeout: float, private: bool) -> None:
        self.default_port = 443 if secure else 80
        super().__init__(host, port, timeout=timeout)
        self.secure, self.private, self.took = secure, private, {"dns_ms": 0, "connect_ms": 0, "tls_ms": 0}

    def _timed(self, what: str, f, *args, **more):
        began = time.monotonic()
        try:
            return f(*args, **more)
        finally:
            self.took[what] = int((time.monotonic() - began) * 1000)

    def connect(self) -> None:
        found = [a[4][:2] for a in self._timed("dns_ms", socket.getaddrinfo, self.host, self.port, proto=socket.IPPROTO_TCP)]
        if not found or not self.private and any(is_blocked(a[0].partition("%")[0]) for a in found):
            raise OSError("address isn't public")
        for at in found:
            try:
                self.sock = self._timed("connect_ms", socket.create_connection, at, self.timeout)
                break
            except OSError:
                if at == found[-1]:
                    raise
        if self.secure:
            self.sock = self._timed("tls_ms", ssl.create_default_context().wrap_socket, self.sock, server_hostname=self.host)


def inflated(chunks: Iterator[bytes], cap: int, zipped: bool) -> tuple[bytes, bool]:
    """At most cap bytes of a body, and whether there are more. A zipped one is inflated piece by piece, never beyond the cap."""
    out, size = [], 0
    unzip = zlib.decompressobj(31) if zipped else None
    for chunk in chunks:
        while chunk and size <= cap:
            part, chunk = (unzip.decompress(chunk, cap + 1 - size), unzip.unconsumed_tail) if unzip else (chunk[: cap + 1 - size], b"")
            out.append(part)
            size += len(part)
            if unzip and unzip.eof:
                chunk, unzip = unzip.unused_data, zlib.decompressobj(31)  # files may be zipped one after the other
        if size > cap:
            break
    if zipped and size <= cap and (unzip.unconsumed_tail or not unzip.eof and out and unzip.flush()):
        raise OSError("body can't be unzipped")
    whole = b"".join(out)
    return whole[:cap], len(whole) > cap


class _WebReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.cap, self.timeout, self.hops = int(options.get("maxBody", MAX_BODY)), float(options.get("timeout", TIMEOUT_S)), int(options.get("maxRedirects", MAX_REDIRECTS))
        self.private = options.get("allowPrivate", "false") == "true"
        self.sent = {"User-Agent": options.get("userAgent", "auditmill"), "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": options.get("acceptLanguage", "en-US,en;q=0.9"), "Accept-Encoding": "gzip"}

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.urls))]

    def _hop(self, at: str) -> tuple[int, dict, dict, bytes, bool]:
        """One request: status, headers, timings, body, whether it was cut. A redirect's body isn't read."""
        u = urlsplit(at)
        if u.scheme not in ("http", "https") or not u.hostname:
            raise OSError("not a web address")
        link = _Link(u.hostname, u.port, u.scheme == "https", self.timeout, self.private)
        began = time.monotonic()
        try:
            link.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers=self.sent)
            answer = link.getresponse()
            took = link.took | {"ttfb_ms": int((time.monotonic() - began) * 1000)}
            headers: dict[str, list[str]] = {}
            for k, v in answer.getheaders():
                headers.setdefault("-".join(p.capitalize() for p in k.split("-")), []).append(v)
            body, cut = b"", False
            if not 300 <= answer.status < 400:
                zipped = headers.get("Content-Encoding", [""])[0].strip().lower() == "gzip"

                def chunks():
                    while chunk := answer.read1(1 << 16):
                        if time.monotonic() - began > self.timeout:
                            raise TimeoutError("timed out")
                        yield chunk

                body, cut = inflated(chunks(), self.cap, zipped)
                if zipped:
                    headers.pop("Content-Length", None)
            return answer.status, headers, took | {"total_ms": int((time.monotonic() - began) * 1000)}, body, cut
        finally:
            link.close()

    def read(self, partition):
        url = at = self.urls[partition.value]
        redirects, none = [], {"dns_ms": 0, "connect_ms": 0, "tls_ms": 0, "ttfb_ms": 0, "total_ms": 0}
        try:
            while True:
                status, headers, took, body, cut = self._hop(at)
                kind = headers.get("Content-Type", [""])[0]
                if not 300 <= status < 400:
                    named = charset.charset_of(body, kind, urlsplit(at).path)
                    yield url, at, status, len(redirects), kind, named, body, cut, "", took["ttfb_ms"], headers, _row(took), redirects
                    return
                to = headers.get("Location", [""])[0]
                if not to:
                    raise OSError("redirect without location")
                if len(redirects) >= self.hops:
                    raise OSError("too many redirects")
                redirects.append((at, status, headers, _row(took)))
                at = urljoin(at, to)
        except (OSError, http.client.HTTPException, ValueError, zlib.error) as e:
            yield url, at, 0, len(redirects), "", "", b"", False, str(e), 0, {}, _row(none), redirects


def _row(took: dict) -> tuple:
    return tuple(took[k] for k in ("dns_ms", "connect_ms", "tls_ms", "ttfb_ms", "total_ms"))
