"""Remote JSON slots as a Python data source, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Gone(Exception):
    """The address has no document; not worth a retry."""


def open_url(url: str, timeout: float = 30.0) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            body = r.read()
            size = r.headers.get("Content-Length")
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise Gone(url) from e
        raise OSError(f"{url}: {e.code}") from e
    if size is not None and int(size) != len(body):
        raise OSError(f"{url}: the body is cut off")
    return body


def fetch(url: str, opener: Callable[[str], bytes] = open_url, tries: int = 3, wait: Callable[[int], float] = float, sleep=time.sleep) -> bytes | None:
    """The body, None if the address has none; after ``tries`` failures the last error.  ``wait`` is the pause after a failed try."""
    for attempt in range(1, tries + 1):
        try:
            return opener(url)
        except Gone:
            return None
        except OSError:
            if attempt == tries:
                raise
            sleep(wait(attempt))
    return None


def slot_path(ts) -> str:
    """Folder and file of a ten-minute slot."""
    return ts.strftime("%Y%m%d/%H%M")


class _Slots(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"])
        self.per_task = int(options.get("per_task", 16))

    def partitions(self):
        return [InputPartition(self.urls[i:i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [InputPartition([])]

    def read(self, partition) -> Iterator[tuple]:
        for url in partition.value:
            body = fetch(url)
            yield url, None if body is None else body.decode("utf-8")


class JsonSlots(DataSource):
    """``spark.read.format("json_slots").option("urls", json_list)``: (url, body), body null where there is no slot."""

    @classmethod
    def name(cls) -> str:
        return "json_slots"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema):
        return _Slots(dict(self.options))
