"""What has changed in a paged feed since the last time, as a stream: its offsets are moments of the feed itself.

spark.readStream.format("feed_changes") takes the options of json_feed and

- `field`: the items' ISO time of change. All times must be written alike, as they are compared as text.
- `since`: where a new stream begins (all items, if it is not set).
- `sorted`: true, if the feed is sorted by that field, falling: a read stops at the first older item, and the newest
  moment is that of the first item. Without it a feed is read whole to find either.
- `since_parameter`: a request parameter that takes the moment from which items are wanted, if the API has one.

A batch is the items of a range of moments, both ends included, since an item may change within the moment that was read
last. So items at a boundary come twice, and an item that changed again after a batch was planned moves to a later one:
nothing is lost, and who stores items by their id and moment doubles nothing. The checkpoint of the stream commits an
offset after its batch is stored; a batch that failed is read again from the same range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from kairograph.sources.feed import items


@dataclass
class Span(InputPartition):
    url: str
    start: str | None
    end: str


class ChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_changes"

    def schema(self) -> str:
        return "raw string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangesReader(dict(self.options))


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.field = options, options["field"]
        self.falling = options.get("sorted", "false").lower() == "true"
        self.urls = options["url"].split(" ")

    def _moment(self, item: dict) -> str:
        return item.get(self.field) or ""

    def _asked(self, start: str | None) -> dict:
        return {self.options["since_parameter"]: start} if start and "since_parameter" in self.options else {}

    def _newest(self, url: str) -> str:
        found = map(self._moment, items(self.options, url, **self._asked(self.options.get("since"))))
        return next(found, "") if self.falling else max(found, default="")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.options.get("since", "")}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": max([self.options.get("since", ""), *map(self._newest, self.urls)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(url, start["until"] or None, end["until"]) for url in self.urls]

    def read(self, partition: Span) -> Iterator[tuple]:
        start, end = partition.start or "", partition.end
        stop = (lambda item: self._moment(item) < start) if self.falling and start else None
        for item in items(self.options, partition.url, stop, **self._asked(partition.start)):
            if start <= self._moment(item) <= end:
                yield (json.dumps(item),)

    def commit(self, end: dict) -> None:
        """Nothing to release: the offset is in the stream's checkpoint."""
