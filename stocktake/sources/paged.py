"""A paged listing API as a data source: key ranges are partitions, pages are what a task reads.

``ObjectPager`` is the API; ``FolderPager`` serves a folder tree through it. Call
``register`` and read ``format("objlist")`` with options ``path``, ``prefix``,
``start_after``, ``delimiter``, ``max_keys``, ``boundaries`` (one a line), ``retries``,
``backoff`` (seconds), ``continuation_token``, ``trace`` (a folder that all executors
share, for a JSON line a call). Ranges of ``Key`` that a query asks for are not listed beyond.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from stocktake.functions.keys import ERROR_NUMBERS
from stocktake.schema import LISTING

#: Errors numbered below this are worth another try.
FIRST_FATAL = 16


class ListingError(Exception):
    def __init__(self, code: str | None):
        super().__init__(code or "generic")
        self.code = code
        self.errno = 2 if code is None else next((n for codes, n in ERROR_NUMBERS if code in codes), 255)

    @property
    def retryable(self) -> bool:
        return self.errno < FIRST_FATAL


@dataclass
class Page:
    objects: list[tuple[str, int, int, str]]
    common_prefixes: list[str] = field(default_factory=list)
    token: str | None = None


class ObjectPager(Protocol):
    def page(self, prefix: str, start_after: str, delimiter: str, max_keys: int, token: str | None) -> Page: ...


class FolderPager:
    """Files below a folder, in byte order of their paths from it; a page reads no further than it has to."""

    def __init__(self, root: str):
        self.root = root

    def _walk(self, folder: str, prefix: str, after: bytes) -> Iterator[str]:
        """Keys below ``folder`` that have the prefix and may come after ``after``, in order."""
        with os.scandir(os.path.join(self.root, folder)) as found:
            names = sorted((folder + e.name + ("/" if e.is_dir() else "") for e in found), key=str.encode)
        for name in names:
            if not name.endswith("/"):
                if name.startswith(prefix) and name.encode() > after:
                    yield name
            # a folder is entered unless all that is below it lies before the cursor, or outside the prefix
            elif (name.startswith(prefix) or prefix.startswith(name)) and (name.encode() > after or after.startswith(name.encode())):
                yield from self._walk(name, prefix, after)

    def page(self, prefix: str, start_after: str, delimiter: str, max_keys: int, token: str | None) -> Page:
        after = token if token is not None else start_after
        page, last = Page([]), None
        for key in self._walk("", prefix, after.encode()):
            head, found, _ = key[len(prefix) :].partition(delimiter) if delimiter else ("", "", "")
            item = prefix + head + found if found else key
            if found and (item.encode() <= after.encode() or page.common_prefixes[-1:] == [item]):
                continue
            if len(page.objects) + len(page.common_prefixes) == max_keys:
                page.token = last
                break
            last = item
            if found:
                page.common_prefixes.append(item)
                continue
            path = os.path.join(self.root, key)
            stat = os.stat(path)
            with open(path, "rb") as f:
                digest = hashlib.file_digest(f, "md5").hexdigest()
            page.objects.append((key, stat.st_size, int(stat.st_mtime), f'"{digest}"'))
        return page


#: Takes the fields of one event of a trace.
Log = Callable[..., None]
# Operations of a trace's events, and what ends a segment.
LIST_CALL, SEGMENT_END = "ListObjectsV2", "ListObjectsV2SegmentSummary"
BY_BOUNDARY, BY_LAST_PAGE, BY_ERROR, BY_READER = "boundary", "pagination", "error", "reader"


class TraceFile:
    """The events of a segment as JSON lines; fields that are not set are left out.

    The file gets its name when the segment has ended, however it ended, so a task's next try replaces what the one before saw.
    """

    def __init__(self, folder: str, name: str, common: dict):
        os.makedirs(folder, exist_ok=True)
        self.path, self.common = f"{folder}/{name}.jsonl", common
        fd, self.temp = tempfile.mkstemp(prefix=".", dir=folder)
        self.file = os.fdopen(fd, "w", encoding="utf-8")

    def __call__(self, **event: object) -> None:
        event = {"timestamp": datetime.now(UTC).isoformat(), **self.common, **event}
        self.file.write(json.dumps({k: v for k, v in event.items() if v not in (None, "")}) + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()
        os.replace(self.temp, self.path)


def _untraced(**event: object) -> None:
    pass


def list_segment(pager: ObjectPager, prefix: str = "", low: str | None = None, high: str | None = None, start_after: str = "", delimiter: str = "", max_keys: int = 1000, retries: int = 10, backoff: float = 0.0, token: str | None = None, log: Log = _untraced, index: int = 0) -> Iterator[tuple[str, int, int, str]]:
    """Objects in ``(low, high]``; after an error worth it, from the last key seen. Progress renews the budget of tries."""
    cursor = max(start_after, low or "", key=str.encode)
    left, began, ended = retries, time.monotonic(), BY_READER
    pages = objects = prefixes = 0
    try:
        while True:
            call = {"operation": LIST_CALL, "prefix": prefix, "delimiter": delimiter, "start_after": cursor, "max_keys": max_keys, "continuation_token": token, "retry_attempt": retries - left}
            sent = time.monotonic()
            try:
                page = pager.page(prefix, cursor, delimiter, max_keys, token)
            except ListingError as e:
                left -= 1
                fatal = not e.retryable or left < 0
                log(**call, latency_ms=_millis(sent), s3_error_code=e.code, s3_error_message=str(e), retryable=e.retryable, fatal=fatal)
                if fatal:
                    ended = BY_ERROR
                    raise
                token = None  # go on from the cursor
                time.sleep(backoff)
                continue
            left, found, rolled, more = retries, len(page.objects), len(page.common_prefixes), page.token is not None
            ends = {"first_key": page.objects[0][0], "last_key": page.objects[-1][0]} if found else {}
            log(**call, latency_ms=_millis(sent), http_status=200, is_truncated=more, next_continuation_token=page.token, next_continuation_token_present=more, key_count=found + rolled, contents_count=found, common_prefixes_count=rolled, **ends)
            pages += 1
            prefixes += rolled
            for row in page.objects:
                if high is not None and row[0].encode() > high.encode():
                    ended = BY_BOUNDARY
                    return
                objects += 1
                yield row
            seen = [row[0] for row in page.objects[-1:]] + page.common_prefixes[-1:]
            cursor = max([cursor, *seen], key=str.encode)
            if page.token is None:
                ended = BY_LAST_PAGE
                return
            token = page.token
    finally:
        log(operation=SEGMENT_END, prefix=prefix, delimiter=delimiter, start_after=max(start_after, low or "", key=str.encode), segment_index=index, end_before=high, segment_pages=pages, segment_objects=objects, segment_common_prefixes=prefixes, latency_ms=_millis(began), ended_by=ended)


def _millis(since: float) -> int:
    return round(1000 * (time.monotonic() - since))


@dataclass
class Segment(InputPartition):
    index: int
    low: str | None
    high: str | None


class ObjectListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.name = uuid.uuid4().hex[:8]
        self.low: str | None = None
        self.high: str | None = None
        self.below = "" if options.get("prefix", "") == "/" else options.get("prefix", "")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds of ``Key`` narrow what is listed; Spark still checks every row."""
        for f in filters:
            if getattr(f, "attribute", None) != ("Key",):
                continue
            if isinstance(f, GreaterThan) and (self.low is None or f.value.encode() > self.low.encode()):
                self.low = f.value
            elif isinstance(f, LessThan | LessThanOrEqual) and (self.high is None or f.value.encode() < self.high.encode()):
                self.high = f.value
            elif isinstance(f, StringStartsWith) and not self.options.get("delimiter") and f.value.startswith(self.below):
                self.below = f.value
        return filters

    def partitions(self) -> list[Segment]:
        bounds = [b for b in self.options.get("boundaries", "").split("\n") if b]
        edges = [None, *sorted(set(bounds), key=str.encode), None]
        out = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            low = max([x for x in (a, self.low) if x is not None], key=str.encode, default=None)
            high = min([x for x in (b, self.high) if x is not None], key=str.encode, default=None)
            if low is None or high is None or low.encode() < high.encode():
                out.append(Segment(i, low, high))
        return out

    def read(self, partition: Segment | None) -> Iterator[tuple]:
        from stocktake.sources.paged import FolderPager, TraceFile, _untraced, list_segment

        if partition is None:  # no segment is left
            return
        o = self.options
        pager = FolderPager(o["path"])
        log = _untraced
        if o.get("trace"):
            log = TraceFile(o["trace"], f"{self.name}-{partition.index:05}", {"endpoint_url": "file://" + o["path"], "bucket": os.path.basename(o["path"].rstrip("/")), "addressing_style": "path"})
        try:
            for key, size, stamp, tag in list_segment(pager, self.below, partition.low, partition.high, o.get("start_after", ""), o.get("delimiter", ""), int(o.get("max_keys", 1000)), int(o.get("retries", 10)), float(o.get("backoff", 0)), o.get("continuation_token"), log, partition.index):
                yield key, size, stamp, tag.strip('"')
        finally:
            if log is not _untraced:
                log.close()


class ObjectListSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objlist"

    def schema(self):  # noqa: ANN201
        return LISTING

    def reader(self, schema) -> ObjectListReader:  # noqa: ANN001
        if self.options.get("continuation_token") and (self.options.get("start_after") or self.options.get("boundaries")):
            raise ValueError("a continuation token goes with neither start_after nor boundaries")
        return ObjectListReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``format("objlist")`` known, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectListSource)
