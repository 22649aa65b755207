"""A paged notice service as a Spark data source, read once or polled as a stream.

The service answers with pages, newest first (here: files below ``path``, each line one page of JSON records). A request is
a conjunction: what Spark pushes down and the options name becomes part of it, and what the service cannot express stays
with Spark. A page is a partition. A failing page or a record without an id is a row with an error, never a failed job.

Options: path, source; countries, codes and terms (comma-separated) of the request; pageSize (100), maxPages (5) and
maxRecords (none), the caps of one request; for a stream lookbackDays (30) and today (the current day).

A poll asks for what was published in the last days, as republished notices keep coming; the offset is the newest page's
time, so nothing is asked while nothing new is there. Bring polls in by an upsert, and a second one changes nothing.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

SCHEMA = "source string, source_id string, title string, published_at date, body string, error string, request string"


def _day(text) -> datetime.date | None:
    """The day that a text starts with; None if it starts with none."""
    try:
        return datetime.date.fromisoformat(str(text)[:10]) if text else None
    except ValueError:
        return None


def full_text_query(required: list[str], since: str, countries: list[str] = (), codes: list[str] = ()) -> str:
    """The conjunction that a notice service takes; quotes in terms are escaped."""
    quoted = " OR ".join('"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"' for t in required)
    parts = [
        f"published >= {since}" if since else "",
        f"text IN ({quoted})" if quoted else "",
        f"country IN ({', '.join(countries)})" if countries else "",
        f"cpv IN ({', '.join(codes)})" if codes else "",
    ]
    return " AND ".join(filter(None, parts))


class Page(InputPartition):
    def __init__(self, file: str, most: int | None):
        self.file, self.most = file, most


class Service:
    """The service's pages and what is asked of it; any store that Arrow opens holds them."""

    def __init__(self, options: dict):
        self.options, self.silent = options, False
        self.since: datetime.date | None = None
        self.countries = self._listed("countries")

    def _listed(self, name: str) -> list[str]:
        return [x.strip() for x in self.options.get(name, "").split(",") if x.strip()]

    def request(self) -> str:
        return full_text_query(self._listed("terms"), self.since.isoformat() if self.since else "", self.countries, self._listed("codes"))

    def store(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"].removeprefix("file:") if "://" not in self.options["path"] else self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def files(self) -> list[fs.FileInfo]:
        """The pages, newest (greatest name) first."""
        store, at = self.store()
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name, reverse=True)

    def pages(self) -> list[Page]:
        """The pages of one request, within its caps; the last one is cut at the rest of the records."""
        size, most = int(self.options.get("pageSize", 100)), int(self.options.get("maxRecords", 0)) or None
        pages = [] if self.silent else [f.path for f in self.files()][: int(self.options.get("maxPages", 5))]
        left = [None if most is None else most - size * i for i in range(len(pages))]
        return [Page(p, n if n is None else min(n, size)) for p, n in zip(pages, left, strict=True) if n is None or n > 0]

    def rows(self, page: Page) -> Iterator[tuple]:
        name, asked = self.options.get("source", "service"), self.request()
        try:
            with self.store()[0].open_input_stream(page.file) as f:
                answers = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
            records = [r for answer in answers for r in answer["records"]]
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield name, None, None, None, None, f"{type(e).__name__}: {page.file}", asked
            return
        for r in records[: page.most]:
            body = json.dumps(r, ensure_ascii=False)
            if not isinstance(r, dict) or r.get("id") is None:
                yield name, None, None, None, body, f"no id: {page.file}", asked
                continue
            day = _day(r.get("published_at"))
            if self.since is None or day is None or day >= self.since:
                title = r.get("title")
                yield name, str(r["id"]), title if title is None else str(title), day, body, None, asked


class NoticeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = Service(options)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("published_at",):
                self.service.since = f.value if self.service.since is None else max(self.service.since, f.value)
            if isinstance(f, EqualTo) and f.attribute == ("source",) and f.value != self.service.options.get("source", "service"):
                self.service.silent = True  # another service's notices: nothing to ask
            if isinstance(f, In) and f.attribute == ("source",) and self.service.options.get("source", "service") not in f.value:
                self.service.silent = True
            yield f  # Spark checks again: the service's dates are coarse

    def partitions(self) -> list[Page]:
        return self.service.pages() or [Page("", 0)]

    def read(self, page: Page):
        return self.service.rows(page) if page.file else iter(())


class NoticePoll(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.service = Service(options)
        today = _day(options.get("today")) or datetime.date.today()
        self.service.since = today - datetime.timedelta(days=int(options.get("lookbackDays", 30)))

    def initialOffset(self) -> dict:
        return {"newest": 0}

    def latestOffset(self) -> dict:
        return {"newest": max((f.mtime_ns for f in self.service.files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.service.pages() if end["newest"] > start["newest"] else []

    def read(self, page: Page):
        return self.service.rows(page)

    def commit(self, end: dict) -> None:
        pass


class NoticePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notice_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NoticeReader:
        return NoticeReader(self.options)

    def streamReader(self, schema) -> NoticePoll:
        return NoticePoll(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NoticePages)
