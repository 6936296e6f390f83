"""Sends changed URLs to an index-now endpoint: batches for each host, one request and one status row for each batch."""

from __future__ import annotations

import http.client
import json
import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from auditmill import shared
from auditmill.functions import urls as U
from auditmill.sources import feeds, fetch

# The protocol's endpoint and the most URLs that one request may name.
ENDPOINT, MOST_URLS = "https://api.indexnow.org/indexnow", 10_000
STATUS = "host string, batch long, urls long, status int, error string"


def batches(urls: DataFrame, key: str, location: Column | None = None, size: int = MOST_URLS) -> DataFrame:
    """urls (url) -> host, batch (from 0), urls (a number), body: each host's URLs in order, at most `size` to a request.

    Repeated URLs go once, null ones and those without a host not at all. location is a column over host, or the same for all.
    URLs are numbered in two levels, so a host with most of the URLs is dealt over tasks; a task holds `size` of them at most at a time.
    """
    host = F.regexp_replace(U.host_of(F.col("url")), r":\d+$", "")
    rows = urls.where("url is not null").select("url").distinct().select(host.alias("host"), "url").where("host <> ''")
    rows = shared.numbered(rows, "_n", "host", "url")
    first = rows.groupBy("host").agg(F.min("_n").alias("_first"))
    rows = rows.join(first, "host").withColumn("batch", F.expr(f"(_n - _first) div {size}"))
    out = rows.groupBy("host", "batch").agg(F.array_sort(F.collect_list("url")).alias("list"))
    at = F.lit(None).cast("string") if location is None else location
    return out.select("host", "batch", F.size("list").cast("long").alias("urls"), feeds.submission(F.col("list"), F.lit(key), at).alias("body"))


def send(batched: DataFrame, path: str, endpoint: str = ENDPOINT, timeout: float = fetch.TIMEOUT_S, private: bool = False) -> None:
    """Posts every batch; its status row goes to the folder `path`, which all executors reach (see `statuses`).

    A request that fails is a row with status 0 and the error; others go on. A task that runs again sends again, which the
    protocol allows, and only the rows of tasks that ended are kept. The endpoint's address is checked like a page's.
    """
    batched.sparkSession.dataSource.register(IndexNow)
    rows = batched.select("host", "batch", "urls", "body")
    rows.write.format(IndexNow.name()).mode("append").options(endpoint=endpoint, timeout=str(timeout), allowPrivate=str(private).lower()).save(path)


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """host, batch, urls, status, error, accepted, meaning of what `send` sent."""
    rows = spark.read.schema(STATUS).json(path)
    return rows.select("*", F.col("status").isin(200, 202).alias("accepted"), feeds.submit_status(F.col("status")).alias("meaning"))


class IndexNow(DataSource):
    """A sink for rows (host, batch, urls, body). Options: path (of the status rows), endpoint, timeout, and allowPrivate, for tests alone."""

    @classmethod
    def name(cls) -> str:
        return "index_now"

    def schema(self) -> str:
        return "host string, batch long, urls long, body string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("status rows are added; mode overwrite isn't offered")
        return _Sender(self.options)


class _Sender(DataSourceWriter):
    def __init__(self, options):
        path = options["path"]
        self.path = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
        self.endpoint, self.timeout = options.get("endpoint", ENDPOINT), float(options.get("timeout", fetch.TIMEOUT_S))
        self.private = options.get("allowPrivate", "false") == "true"
        self.job = uuid.uuid4().hex

    def _store(self):
        store, at = fs.FileSystem.from_uri(self.path)
        return store, at.rstrip("/")

    def _post(self, body: str) -> tuple[int, str]:
        u = urlsplit(self.endpoint)
        link = fetch._Link(u.hostname, u.port, u.scheme == "https", self.timeout, self.private)
        try:
            link.request("POST", u.path or "/", body=body.encode(), headers={"Content-Type": "application/json; charset=utf-8"})
            return link.getresponse().status, ""
        except (OSError, http.client.HTTPException) as e:
            return 0, str(e) or type(e).__name__
        finally:
            link.close()

    def write(self, rows):
        """Status rows are written as they come, to a hidden file that the commit brings to light."""
        store, at = self._store()
        name = f"{self.job}-{uuid.uuid4().hex}.json"
        store.create_dir(at)
        with store.open_output_stream(f"{at}/_{name}") as out:
            for host, batch, urls, body in rows:
                status, error = self._post(body)
                out.write((json.dumps({"host": host, "batch": batch, "urls": urls, "status": status, "error": error}) + "\n").encode())
        return _Written(name)

    def commit(self, messages):
        store, at = self._store()
        for m in messages:
            if m:
                store.move(f"{at}/_{m.file}", f"{at}/{m.file}")

    def abort(self, messages):
        store, at = self._store()
        for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith(f"_{self.job}-"):
                store.delete_file(info.path)


class _Written(WriterCommitMessage):
    """The file of a task's status rows."""

    def __init__(self, file: str):
        self.file = file
