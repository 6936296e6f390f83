"""The live reader against servers on this machine: hops, headers, timings, zipped bodies, and what it doesn't reach."""

import gzip
import http.server
import threading
import zlib

import pytest

from auditmill.functions.urls import is_blocked
from auditmill.sources import fetch

ZEROS = gzip.compress(b"0" * 5_000_000)
PAGES = {
    "/": (301, {"Location": "/second?x=1", "X-Step": "one"}, b"moved"),
    "/second?x=1": (302, {"Location": "http://localhost:{port}/end"}, b""),
    "/end": (200, {"Content-Type": "text/html; charset=latin1", "X-Twice": "b"}, "é".encode("latin-1")),
    "/zipped": (200, {"Content-Type": "text/plain", "Content-Encoding": "gzip"}, gzip.compress(b"hello ") + gzip.compress(b"again")),
    "/bomb": (200, {"Content-Encoding": "gzip"}, ZEROS),
    "/broken": (200, {"Content-Encoding": "gzip"}, b"no zip at all"),
    "/lost": (307, {}, b""),
    "/loop": (308, {"Location": "/loop"}, b""),
    "/ftp": (302, {"Location": "ftp://localhost/x"}, b""),
    "/none": (404, {"Content-Type": "text/html"}, b"<p>gone"),
    "/long": (200, {}, b"x" * 3000),
}


@pytest.fixture
def port():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            status, headers, body = PAGES[self.path]
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v.replace("{port}", str(self.server.server_address[1])))
            self.send_header("x-accepts", self.headers["Accept-Encoding"])
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1]
    server.shutdown()


def test_hops_headers_and_bodies(spark, port):
    spark.dataSource.register(fetch.WebSource)
    urls = " ".join(f"http://127.0.0.1:{port}{p}" for p in PAGES)
    reader = spark.read.format("web").option("urls", urls).option("allowPrivate", "true").option("maxBody", "2000").option("maxRedirects", "3")
    got = {r.url.split(str(port))[1]: r for r in reader.load().collect()}
    r = got["/"]
    assert (r.status, r.hops, r.final_url, r.content_type, r.charset, bytes(r.body)) == (200, 2, f"http://localhost:{port}/end", "text/html; charset=latin1", "windows-1252", b"\xe9")
    assert [(h.url.split(str(port))[1], h.status) for h in r.redirects] == [("/", 301), ("/second?x=1", 302)]
    assert r.redirects[0].headers["X-Step"] == ["one"] and r.redirects[0].headers["Location"] == ["/second?x=1"] and r.headers["X-Accepts"] == ["gzip"]
    assert r.timings.total_ms >= r.timings.ttfb_ms >= r.timings.connect_ms >= 0 and r.timings.tls_ms == 0
    r = got["/zipped"]
    assert (bytes(r.body), r.truncated, r.headers["Content-Encoding"]) == (b"hello again", False, ["gzip"]) and "Content-Length" not in r.headers
    assert (len(got["/bomb"].body), got["/bomb"].truncated) == (2000, True) == (len(got["/long"].body), got["/long"].truncated)
    assert got["/none"].status == 404 and bytes(got["/none"].body) == b"<p>gone"
    assert [got[p].error for p in ("/lost", "/loop", "/ftp")] == ["redirect without location", "too many redirects", "not a web address"]
    assert got["/broken"].error and got["/broken"].status == 0 and len(got["/loop"].redirects) == 3


def test_every_hop_is_looked_at(spark, port, monkeypatch):
    """A name that is public at first and leads inside by a redirect: the second hop is refused."""
    reader = fetch._WebReader({"urls": f"http://public.example:{port}/second?x=1"})
    real = fetch.socket.getaddrinfo
    asked = []

    def look_up(host, at, *rest, **more):
        if not host[0].isdigit():  # connecting asks again, for the address itself
            asked.append(host)
        return real("127.0.0.1", at, *rest, **more)

    monkeypatch.setattr(fetch.socket, "getaddrinfo", look_up)
    monkeypatch.setattr(fetch, "is_blocked", lambda a: asked[-1] != "public.example")
    row = next(reader.read(reader.partitions()[0]))
    assert asked == ["public.example", "localhost"] and row[8] == "address isn't public" and [h[1] for h in row[12]] == [302]


@pytest.mark.parametrize("address", ["224.0.0.1", "ff02::1", "10.1.2.3", "127.0.0.1", "::1", "::ffff:10.0.0.1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "fe80::1", "fc00::1", "", None, "name"])
def test_blocked(address):
    assert is_blocked(address)


def test_public():
    assert not any(map(is_blocked, ("8.8.8.8", "2001:4860:4860::8888", "::ffff:8.8.8.8", "100.128.0.1")))


def test_inflating_stays_below_the_cap():
    pieces = [ZEROS[i : i + 100] for i in range(0, len(ZEROS), 100)]
    assert fetch.inflated(iter(pieces), 10, True) == (b"0" * 10, True)
    assert fetch.inflated(iter(pieces), 5_000_000, True) == (b"0" * 5_000_000, False)
    assert fetch.inflated(iter([b"ab", b"cd"]), 4, False) == (b"abcd", False) and fetch.inflated(iter([b"ab", b"cd"]), 3, False) == (b"abc", True)
    assert fetch.inflated(iter([]), 3, True) == (b"", False)
    with pytest.raises((OSError, zlib.error)):
        fetch.inflated(iter([b"plain"]), 9, True)
