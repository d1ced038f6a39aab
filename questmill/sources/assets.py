"""An asset store as a Spark data source: listings read page by page, assets written with their metadata and made visible together.

    spark.dataSource.register(AssetSource)
    spark.read.format("assets").option("store", path).load()                    key, size, content_type, cache_control
    rows.write.format("assets").option("store", path).mode("append").save()     key, content, content_type, cache_control

The store is a folder that all nodes share: ``objects/`` holds contents under names that no reader knows, ``pages/`` the listings
that name them, one for each commit, in order. A key's last listing counts. Other stores take another ``Store``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import mime_type

LISTING = "key string, size long, content_type string, cache_control string, page long, object string"
WRITTEN = "key string, content binary, content_type string, cache_control string"
ATTEMPTS = 5


class Store:
    """Contents and listings in one folder."""

    def __init__(self, root: str):
        self.root = root

    def pages(self) -> list[str]:
        folder = os.path.join(self.root, "pages")
        return sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []

    def read_page(self, name: str) -> list[dict]:
        with open(os.path.join(self.root, "pages", name), encoding="utf-8") as f:
            return [json.loads(line) for line in f]

    def put(self, content: bytes) -> str:
        """Store a content under a new name; nothing shows it yet."""
        name = uuid.uuid4().hex
        folder = os.path.join(self.root, "objects", name[:2])
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
        return f"{name[:2]}/{name}"

    def get(self, name: str) -> bytes:
        with open(os.path.join(self.root, "objects", name), "rb") as f:
            return f.read()

    def drop(self, name: str) -> None:
        path = os.path.join(self.root, "objects", name)
        if os.path.exists(path):
            os.remove(path)

    def add_page(self, rows: Iterator[dict]) -> None:
        """Show what was put: the page is written beside and then renamed, so it is there whole or not at all."""
        folder = os.path.join(self.root, "pages")
        os.makedirs(folder, exist_ok=True)
        last = max((int(n[:-5]) for n in self.pages()), default=-1)
        draft = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(row) + "\n" for row in rows)
        os.rename(draft, os.path.join(folder, f"{last + 1:012d}.json"))


@dataclass
class Page(InputPartition):
    name: str


class AssetReader(DataSourceReader):
    """One partition for each page of the listing."""

    def __init__(self, store: Store):
        self.store = store

    def partitions(self) -> list[Page]:
        return [Page(n) for n in self.store.pages()] or [Page("")]

    def read(self, page: Page) -> Iterator[tuple]:
        for row in self.store.read_page(page.name) if page.name else []:
            yield row["key"], row["size"], row["content_type"], row["cache_control"], int(page.name[:-5]), row["object"]


@dataclass
class Written(WriterCommitMessage):
    rows: list[dict]


class AssetWriter(DataSourceWriter):
    """Each task puts its contents, with retries, and reports their names; the commit writes one page that names them all. What a
    failed task or an aborted job has put is dropped, and was never visible."""

    def __init__(self, store: Store, attempts: int, wait: float):
        self.store, self.attempts, self.wait = store, attempts, wait

    def _put(self, content: bytes) -> str:
        for attempt in range(self.attempts):
            try:
                return self.store.put(content)
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def write(self, iterator) -> Written:
        rows: list[dict] = []
        try:
            for row in iterator:
                if not row["key"]:
                    raise ValueError("an asset has no key")
                content = bytes(row["content"] or b"")
                rows.append({"key": row["key"], "size": len(content), "content_type": row["content_type"], "cache_control": row["cache_control"], "object": self._put(content)})
        except BaseException:
            for done in rows:
                self.store.drop(done["object"])
            raise
        return Written(rows)

    def commit(self, messages) -> None:
        if any(m.rows for m in messages if m):
            self.store.add_page(row for m in messages if m for row in m.rows)

    def abort(self, messages) -> None:
        for message in messages:
            for row in message.rows if message else []:
                self.store.drop(row["object"])


class AssetSource(DataSource):
    """Options: ``store`` (folder), ``attempts`` and ``wait`` (seconds before the first retry) of writes."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> AssetReader:
        return AssetReader(Store(self.options["store"]))

    def writer(self, schema, overwrite: bool) -> AssetWriter:
        if overwrite:
            raise ValueError("assets are only added; a key's newest content counts")
        return AssetWriter(Store(self.options["store"]), int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("wait", 0.1)))


def listing(spark: SparkSession, store: str) -> DataFrame:
    """(key, size, content_type, cache_control): the newest entry of each key."""
    spark.dataSource.register(AssetSource)
    rows = spark.read.format("assets").option("store", store).load()
    return rows.groupBy("key").agg(F.max_by(F.struct("size", "content_type", "cache_control"), F.struct("page", "object")).alias("v")).select("key", "v.*")


def to_upload(local: DataFrame, remote: DataFrame, fresh: str, changed: str, force: bool = False) -> DataFrame:
    """Assets (key, content) that the remote side lacks or holds at another size, with content type by their ending and the cache
    control of new (``fresh``) or of ``changed`` assets."""
    known = remote.select("key", F.col("size").alias("__size"))
    rows = local.join(known, "key", "left").where(F.lit(force) | F.col("__size").isNull() | (F.col("__size") != F.length("content")))
    control: Column = F.when(F.col("__size").isNull(), fresh).otherwise(changed)
    return rows.select("key", "content", mime_type(F.col("key")).alias("content_type"), control.alias("cache_control"))


def upload(rows: DataFrame, store: str, **options) -> None:
    rows.sparkSession.dataSource.register(AssetSource)
    rows.select("key", "content", "content_type", "cache_control").write.format("assets").options(store=store, **options).mode("append").save()
