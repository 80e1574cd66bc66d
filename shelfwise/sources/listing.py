"""Listings that a service hands out page by page, as a table and as a stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Items of a category's page, from page 0 on; none or null past the end.
Fetch = Callable[[str, int], "list[dict] | None"]


@dataclass
class Stretch(InputPartition):
    """Items number first to last - 1 of a category."""

    category: str
    first: int
    last: int


@dataclass
class Listing:
    """Where the pages of a listing come from and how they are dealt to tasks.

    All pages of a category but its last hold page_size items, so an item's number tells its page. A category of any
    length is read by many tasks of pages_per_task pages each.
    """

    fetch: Fetch
    categories: list[str]
    fields: list[str]
    page_size: int
    pages_per_task: int

    def length(self, category: str, known: int = 0) -> int:
        """Items of a category, of which `known` were there before; asks for twice the logarithm of its pages."""
        held = lambda page: len(self.fetch(category, page) or [])
        page = known // self.page_size
        n = held(page)
        if n < self.page_size:
            return max(known, page * self.page_size + n)
        full, step = page, 1
        while (n := held(full + step)) >= self.page_size:
            full, step = full + step, step * 2
        short = full + step
        while short - full > 1:
            middle = (full + short) // 2
            m = held(middle)
            full, short, n = (middle, short, n) if m >= self.page_size else (full, middle, m)
        return short * self.page_size + n

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        most = self.page_size * self.pages_per_task
        cut = lambda c: [start.get(c, 0), *range(start.get(c, 0) // most * most + most, end[c], most), end[c]]
        return [Stretch(c, a, b) for c in self.categories if c in end for a, b in zip(cut(c), cut(c)[1:]) if a < b]

    def items(self, s: Stretch) -> Iterator[tuple]:
        """A page at a time. A page that has become shorter since it was counted is an error, and no loss of items."""
        for page in range(s.first // self.page_size, (s.last - 1) // self.page_size + 1):
            found, base = self.fetch(s.category, page) or [], page * self.page_size
            if len(found) < min(s.last - base, self.page_size):
                raise OSError(f"page {page} of {s.category} has {len(found)} items now")
            for i in range(max(s.first - base, 0), min(s.last - base, self.page_size)):
                yield (s.category, page, base + i, *(found[i].get(f) for f in self.fields))


def listing_source(name: str, fetch: Fetch, fields: str, categories: list[str], page_size: int = 12, pages_per_task: int = 50) -> type[DataSource]:
    """A data source, to be registered, of category, page, number (of the item within its category) and the fields (DDL).

    Its table is what is listed when the query is planned. Its stream keeps the items taken of each category as its
    offset: items that come later are read, on a page already read as well, and a restart goes on after the last batch.
    Items must stay where they are. The driver only counts pages; fetch runs in tasks too, may be asked again for what it
    gave before, and what it raises fails the task. Fields that an item lacks are null; categories that repeat count once.
    """
    schema = StructType.fromDDL(fields)
    if taken := {c.lower() for c in schema.names} & {"category", "page", "number"}:
        raise ValueError(f"fields {sorted(taken)} are in the way")
    listing = Listing(fetch, list(dict.fromkeys(categories)), schema.names, page_size, pages_per_task)

    class Table(DataSourceReader):
        def partitions(self):
            return listing.stretches({}, {c: listing.length(c) for c in listing.categories}) or [Stretch("", 0, 0)]

        def read(self, partition):
            return listing.items(partition) if partition.last else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self):
            self.known: dict[str, int] = {}

        def initialOffset(self):
            return dict.fromkeys(listing.categories, 0)

        def latestOffset(self):
            self.known = {c: listing.length(c, self.known.get(c, 0)) for c in listing.categories}
            return self.known

        def partitions(self, start, end):
            return listing.stretches(start, end)

        def read(self, partition):
            return listing.items(partition)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "category string, page int, number long, " + fields

        def reader(self, schema):
            return Table()

        def streamReader(self, schema):
            return Stream()

    return Source


def read_listing(spark: SparkSession, fetch: Fetch, fields: str, categories: list[str], stream: bool = False, **settings: int) -> DataFrame:
    """Items of a listing (see listing_source)."""
    name = f"listing_{uuid.uuid4().hex}"
    spark.dataSource.register(listing_source(name, fetch, fields, categories, **settings))
    return (spark.readStream if stream else spark.read).format(name).load()


class _SavedPages:
    """Fetches saved pages. The lines of the file asked last are held, as long as it stays as it is."""

    def __init__(self, folder: str, pages_per_file: int | None):
        self.folder, self.pages_per_file = folder, pages_per_file
        self.held: tuple = (None, [])

    def __reduce__(self):
        # what is held stays in its process
        return _SavedPages, (self.folder, self.pages_per_file)

    def lines(self, below: str) -> list[bytes]:
        from pyarrow import fs

        place, path = fs.FileSystem.from_uri(self.folder)
        found = place.get_file_info(fs.FileSelector(f"{path}/{below}", allow_not_found=True))
        files = sorted((f.path, f.mtime_ns, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        if self.held[0] != files:
            lines: list[bytes] = []
            for f, _, _ in files:
                with place.open_input_stream(f) as stream:
                    lines += stream.read().splitlines()
            self.held = (files, lines)
        return self.held[1]

    def __call__(self, category: str, page: int) -> list[dict]:
        if self.pages_per_file is None:
            return [json.loads(line) for line in self.lines(f"category={category}/page={page}")]
        at, n = divmod(page, self.pages_per_file)
        lines = self.lines(f"category={category}/pages={at}")
        return json.loads(lines[n]) if n < len(lines) else []


def saved_pages(folder: str, pages_per_file: int | None = None) -> Fetch:
    """Fetches pages kept below a folder (a URI) that all executors reach: as JSON lines, an item each, in
    category=C/page=N, or, with pages_per_file, as lines of one page each, a JSON array, in category=C/pages=N div
    pages_per_file."""
    return _SavedPages(folder, pages_per_file)


def save_pages(items: DataFrame, folder: str, category: str, number: str, page_size: int = 12, pages_per_file: int | None = None) -> None:
    """Lays items out as saved_pages reads them; number counts from 0 within each category, without gaps.

    A folder a page is too much for very many pages: pages_per_file keeps so many in one.
    """
    fields = [c for c in items.columns if c not in (category, number)]
    page = F.floor(F.col(number) / page_size).alias("page")
    lines = items.select(F.col(category).alias("category"), page, F.col(number).alias("number"), F.to_json(F.struct(*fields)).alias("value"))
    if pages_per_file is None:
        dealt, kept = lines.repartition("category", "page").sortWithinPartitions("category", "page", "number").drop("number"), "page"
    else:
        one = F.transform(F.sort_array(F.collect_list(F.struct("number", "value"))), lambda x: x["value"])
        kept, at = "pages", F.floor(F.col("page") / pages_per_file).alias("pages")
        # pages of a file are dealt to one task before they are made, and lie in it in their order
        dealt = lines.withColumn("pages", at).repartition("category", "pages").groupBy("category", "pages", "page").agg(F.concat(F.lit("["), F.array_join(one, ","), F.lit("]")).alias("value"))
        dealt = dealt.sortWithinPartitions("category", "pages", "page").drop("page")
    dealt.write.mode("overwrite").partitionBy("category", kept).text(folder)
