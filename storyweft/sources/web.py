"""Pages of the web as a Spark source: `spark.dataSource.register(PoliteWeb)`, then `spark.read.format("polite_web")`."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.pages import main_text, politely


class _Host(InputPartition):
    def __init__(self, pages: list[tuple[int, str]]):
        self.pages = pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.settings = {"delay": float(options.get("delay", "0.4")), "tries": int(options.get("tries", "3")), "wait": float(options.get("wait", "1")), "timeout": float(options.get("timeout", "15"))}

    def partitions(self) -> list[InputPartition]:
        """One for each host, in the order its pages were given: pauses hold however many tasks run."""
        by_host: dict[str, list[tuple[int, str]]] = {}
        for i, url in enumerate(self.urls):
            by_host.setdefault(urlsplit(url).netloc.lower(), []).append((i, url))
        return [_Host(pages) for pages in by_host.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pages = getattr(partition, "pages", [])
        for (i, url), a in zip(pages, politely((u for _, u in pages), **self.settings), strict=True):
            yield i, url, a.status, a.body, main_text(a.body), a.error, a.tries


class PoliteWeb(DataSource):
    """Options: urls (separated by spaces or line breaks), delay, tries, wait, timeout. A list that a query derives is for `pages.fetch`."""

    @classmethod
    def name(cls) -> str:
        return "polite_web"

    def schema(self) -> str:
        return "position int, url string, status int, html string, body string, error string, tries int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
