"""Snapshot files: one JSON file for each page and time, named <16 hexadecimal digits>-<seconds>.json.

The name says whose snapshot a file is and when it was taken. `read` gives both as columns made of the file's name
alone, so filters on them choose files before any is opened. `save` writes such files from the tasks that hold the rows.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from auditmill.functions import urls as U
from auditmill.shared import written

# The fields of a snapshot file in their order.
FIELDS = {
    "url": "string", "timestamp": "string", "content_sha256": "string", "status_code": "int", "title": "string", "meta_description": "string", "canonical": "string",
    "h1": "array<string>", "schema_types": "array<string>", "word_count": "bigint", "image_count": "bigint", "internal_links": "bigint", "ttfb_ms": "bigint",
}
_NAME = r"^([0-9a-f]{16})-([0-9]+)\.json$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """url_key, taken (seconds), then the fields, of every snapshot file in a folder.

    Files that hold no JSON object of these types, or a time that is none, are left out, as are other names and folders
    below. A missing or null field is empty text, 0 or an empty list; a missing time is the name's. An empty folder
    gives no rows. Filters on url_key and taken are decided from names when files are listed.
    """
    name = F.col("_metadata.file_name")
    # the text source makes a configuration of its own for each file, which takes longer than the file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-*.json").load(path).withColumn("value", F.col("content").cast("string"))
    schema = ", ".join(f"{f} {t}" for f, t in FIELDS.items()) + ", _broken string"
    held = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = files.where(name.rlike(_NAME)).select(F.regexp_extract(name, _NAME, 1).alias("url_key"), F.regexp_extract(name, _NAME, 2).cast("long").alias("taken"), "value", held.alias("s"))
    rows = rows.where(F.ltrim("value").startswith("{") & F.col("s").isNotNull() & F.col("s._broken").isNull())
    at = F.when(F.coalesce("s.timestamp", F.lit("")) == "", F.timestamp_seconds("taken")).otherwise(F.try_to_timestamp("s.timestamp"))

    def field(f: str, t: str):
        none = F.array().cast(t) if t.startswith("array") else F.lit("" if t == "string" else 0).cast(t)
        return F.coalesce(f"s.{f}", none).alias(f)

    rows = rows.select("url_key", "taken", at.alias("timestamp"), *[field(f, t) for f, t in FIELDS.items() if f != "timestamp"])
    return rows.where(F.col("timestamp").isNotNull()).select("url_key", "taken", *FIELDS)


def history(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Snapshots of pages (url), oldest first: those under a page's key, else those under the key of earlier versions.

    Files are opened once: what both keys find is a written table, from which the rest follows.
    page is the URL asked for, which the snapshot's own may differ from. Repeated pages count once; null ones not at all.
    """
    asked = pages.where(F.col("url").isNotNull()).select(F.col("url").alias("page")).distinct()
    # the key is worked out once: as an expression it is long
    asked = asked.withColumn("_key", U.key_absolute(F.col("page")))
    asked = asked.select("page", U.store_key(F.col("_key")).alias("url_key"), U.legacy_store_key(F.col("page")).alias("_old"))
    keys = asked.select("page", F.explode(F.array(F.struct("url_key", F.lit(True).alias("_own")), F.struct(F.col("_old").alias("url_key"), F.lit(False).alias("_own")))).alias("k")).select("page", "k.*")
    hits = written(keys.join(stored, "url_key"), "history")
    own = hits.where("_own")
    old = hits.where("not _own").join(own.select("page").distinct(), "page", "left_anti")
    return own.unionByName(old).drop("_own")


def save(snapshots: DataFrame, path: str) -> None:
    """Writes a file for each snapshot (see `drift.capture`) into a folder that all executors reach, by path or URI.

    Of snapshots with one key and second the latest stays, then the one with the greatest content hash. A file appears
    under its name when it is whole; its name and content follow from the row, so a task that runs again writes the
    same. Rows without key or time are an error.
    """
    rows = snapshots.select(
        F.concat(F.col("url_key"), F.lit("-"), F.unix_timestamp("timestamp").cast("string"), F.lit(".json")).alias("name"),
        F.struct(F.col("timestamp").alias("_at"), F.col("content_sha256").alias("_hash"), F.struct(*[_out(f) for f in FIELDS]).alias("s")).alias("r"),
    )
    spark = snapshots.sparkSession
    # a file takes its time however few bytes it has: a stated number of tasks isn't merged for being small
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    rows = rows.groupBy("name").agg(F.max_by("r.s", F.struct("r._at", "r._hash")).alias("s"))
    spark.dataSource.register(NamedFiles)
    rows.select("name", F.to_json("s", {"ignoreNullFields": "false"}).alias("body")).write.format(NamedFiles.name()).mode("append").save(path)


def _out(f: str):
    if f != "timestamp":
        return F.col(f)
    return F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(f)


class NamedFiles(DataSource):
    """Writes rows (name, body) as files of these names: df.write.format("named_files").mode("append").save(folder).

    The folder is a path or a URI of a store that pyarrow reaches; a cluster's tasks must all reach it.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are added; mode overwrite isn't offered")
        return _NamedWriter(self.options["path"])


class _NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        # Hadoop's file:/x is file:///x
        self.path = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
        self.draft = f"_writing-{uuid.uuid4().hex}"

    def _store(self):
        store, at = fs.FileSystem.from_uri(self.path)
        return store, at.rstrip("/")

    def write(self, batches):
        store, at = self._store()
        store.create_dir(f"{at}/{self.draft}")
        part = f"{at}/{self.draft}/{uuid.uuid4().hex}"  # moved away before the next file is written
        for batch in batches:
            for name, body in zip(*(batch.column(c).to_pylist() for c in ("name", "body"))):
                if not name or "/" in name:
                    raise ValueError("a file needs a plain name")
                with store.open_output_stream(part) as out:
                    out.write((body or "").encode())
                store.move(part, f"{at}/{name}")
        return WriterCommitMessage()

    def _clear(self):
        store, at = self._store()
        if store.get_file_info(f"{at}/{self.draft}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.draft}")

    def commit(self, messages):
        self._clear()

    def abort(self, messages):
        self._clear()
