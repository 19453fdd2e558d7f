"""Python data source of paper pages: the cache first, then the network at the pace the site asks for.

    spark.dataSource.register(PaperPages)
    spark.read.format("paper_pages").options(ids="2301.1,2301.2", base="https://host", cache="/shared/cache").load()
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Endpoints that robots may read, with the ending of their cached files.
ENDPOINTS = {"abs": "html", "html": "html", "pdf": "pdf"}
# Seconds between requests, and seconds to wait for an answer.
DELAY, TIMEOUT = 15.0, 30.0
CACHED = -1


def page_name(paper: str, endpoint: str) -> str:
    """File name of a paper's page in the cache."""
    return f"{paper.replace('/', '_')}_{endpoint}.{ENDPOINTS[endpoint]}"


def cache_name(paper: Column, endpoint: str) -> Column:
    """The same of a column of papers."""
    return F.concat(F.translate(paper, "/", "_"), F.lit(page_name("", endpoint)))


class PaperPages(DataSource):
    """Options: ids (comma-separated), base (address), cache (a shared folder), endpoints, delay in seconds."""

    @classmethod
    def name(cls) -> str:
        return "paper_pages"

    def schema(self) -> str:
        return "paper_id string, endpoint string, content binary, status int"

    def reader(self, schema) -> Pages:
        return Pages(dict(self.options))


class Pages(DataSourceReader):
    def __init__(self, options: dict) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.ids = list(dict.fromkeys(i.strip() for i in low.get("ids", "").split(",") if i.strip()))
        self.endpoints = [e.strip() for e in low.get("endpoints", "abs,html,pdf").split(",") if e.strip()]
        self.base, self.cache, self.delay = low.get("base", "").rstrip("/"), low.get("cache"), float(low.get("delay", DELAY))
        if banned := [e for e in self.endpoints if e not in ENDPOINTS]:
            raise ValueError(f"robots may not read {', '.join(banned)}")
        if not self.cache:
            raise ValueError("option cache names no folder")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one reader, since the delay holds for all requests together

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for paper in self.ids:
            for endpoint in self.endpoints:
                yield (paper, endpoint, *self.page(paper, endpoint))

    def page(self, paper: str, endpoint: str) -> tuple[bytes | None, int]:
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(self.cache) if "://" in self.cache else (files.LocalFileSystem(), self.cache)
        path = f"{root.rstrip('/')}/{page_name(paper, endpoint)}"
        if fs.get_file_info(path).type == files.FileType.File:
            with fs.open_input_stream(path) as f:
                return f.read(), CACHED
        if not self.base:
            return None, 0
        try:
            with urllib.request.urlopen(f"{self.base}/{endpoint}/{paper}", timeout=TIMEOUT) as answer:
                data, status = answer.read(), answer.status
        except urllib.error.HTTPError as e:
            data, status = None, e.code
        except OSError:
            data, status = None, 0
        finally:
            time.sleep(self.delay)
        if status == 200:
            # a whole file appears at once, so a lost reader leaves no half page
            part = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(data)
            fs.move(part, path)
        return data, status


def resolve(pages: DataFrame) -> DataFrame:
    """(paper_id, source, content): the HTML of each paper if it was read, else its PDF, else `none`."""
    good = F.col("content").isNotNull() & F.col("status").isin(200, CACHED)
    of = lambda e: F.max(F.when(good & (F.col("endpoint") == e), F.col("content")))
    one = pages.groupBy("paper_id").agg(of("html").alias("h"), of("pdf").alias("p"))
    return one.select("paper_id", F.when(F.col("h").isNotNull(), "html").when(F.col("p").isNotNull(), "pdf").otherwise("none").alias("source"), F.coalesce("h", "p").alias("content"))
