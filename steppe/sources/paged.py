"""A paged remote source as a Spark data source: one partition a page, each fetched once.

    spark.dataSource.register(PagedSource)
    spark.read.format("steppe_paged").option("fetch", "module:function").option("total", 12000).schema("id long").load()

``fetch(first, size)`` gives the rows of a page as tuples and runs in tasks, with
retries after transport faults. A page with fewer or more rows than the total
leaves for it fails its task, and so the job: a truncated read is never a table.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from steppe.sources.readers import TruncatedReadError, with_retry


class Page(InputPartition):
    def __init__(self, first: int, size: int):
        super().__init__(first)
        self.first, self.size = first, size


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        if "fetch" not in options or "total" not in options:
            raise ValueError("a paged source needs the options fetch and total")
        self.fetch, self.total, self.page, self.width = options["fetch"], int(options["total"]), int(options.get("page", 5000)), width
        expected = int(options.get("expected", self.total))
        if expected != self.total:
            raise TruncatedReadError(f"{self.fetch}: the source counts {self.total}, the caller {expected}")
        self.tries, self.base = int(options.get("tries", 5)), float(options.get("base", 2.0))

    def partitions(self) -> list[Page]:
        return [Page(k, min(self.page, self.total - k)) for k in range(0, self.total, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.size:
            return
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        what = f"{self.fetch} from {partition.first}"
        rows = with_retry(lambda: list(fetch(partition.first, partition.size)), what, self.tries, self.base)
        if len(rows) != partition.size:
            raise TruncatedReadError(f"{what}: {len(rows)} rows, expected {partition.size}")
        if any(len(r) != self.width for r in rows):
            raise ValueError(f"{what}: a row has another width than the schema")
        yield from map(tuple, rows)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "steppe_paged"

    def schema(self) -> str:
        raise ValueError("a paged source is read with a declared schema")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options), len(schema.fields))
