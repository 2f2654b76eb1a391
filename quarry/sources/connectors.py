"""Connectors: a registry of sources of uniform records, as Python data sources of Spark.

A connector reads pages of records by a function that is given, so that tests and offline runs need no
network; the data source splits the pages among tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "record_id string, title string, content string, source_url string, source_type string, metadata map<string,string>"
Page = tuple[list[dict], str | None]
#: Pages of a share that a task of a stream fetches.
PAGES = 500


@dataclass(frozen=True)
class Connector:
    """A kind of source: fetch(options, cursor) gives records and the next cursor, None at the end."""

    name: str
    fetch: Callable[[dict[str, str], str | None], Page]
    needs: tuple[str, ...] = ()  # environment variables, any of which makes it available
    partitions: Callable[[dict[str, str]], list[dict[str, str]]] = field(default=lambda options: [options])


_KNOWN: dict[str, Connector] = {}


def register(connector: Connector) -> Connector:
    if connector.name in _KNOWN:
        raise ValueError(f"{connector.name} is registered already")
    _KNOWN[connector.name] = connector
    return connector


def available(environment: dict[str, str] | None = None) -> dict[str, bool]:
    """Names of connectors, and whether what one of them needs is set."""
    held = os.environ if environment is None else environment
    return {n: not c.needs or any(held.get(v) for v in c.needs) for n, c in sorted(_KNOWN.items())}


class _Part(InputPartition):
    def __init__(self, options: dict[str, str]):
        self.options = options


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, options: dict[str, str]):
        self.connector, self.options = connector, options

    def partitions(self) -> list[InputPartition]:
        return [_Part(o) for o in self.connector.partitions(self.options)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        most, cursor, n = int(partition.options.get("maxrecords", 1 << 62)), None, 0
        while True:
            records, cursor = self.connector.fetch(partition.options, cursor)
            for r in records:
                if n >= most:
                    return
                n += 1
                yield (str(r["record_id"]), r.get("title"), r.get("content"), r.get("source_url"), self.connector.name, {k: str(v) for k, v in (r.get("metadata") or {}).items()})
            if cursor is None:
                return


def _source(connector: Connector) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return connector.name

        def schema(self) -> str:
            return RECORD

        def reader(self, schema) -> DataSourceReader:
            return _Reader(connector, dict(self.options))

    return Source


def paged(name: str, page: Callable[[dict[str, str], int], list[dict]], held: Callable[[dict[str, str]], int]) -> type[DataSource]:
    """A streaming source of uniform records from numbered pages of several shares (option shares): page(options, n) gives
    the records of a share's page, held(options) how many pages it has by now; options has the share.

    A batch takes, of each share, the pages that came since the batch before, a task for each PAGES of them; pages are
    fetched by tasks alone. How far each share was read is the stream's offset, which the query's checkpoint keeps:
    a query that is stopped, or loses an executor, goes on behind the last batch it finished, and fetches a
    batch again only whole."""
    record = RECORD

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def _of(self, share: str) -> dict[str, str]:
            return {**self.options, "share": share}

        def initialOffset(self) -> dict:
            return {str(s): 0 for s in range(int(self.options["shares"]))}

        def latestOffset(self) -> dict:
            return {s: held(self._of(s)) for s in self.initialOffset()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [InputPartition((s, a, min(a + PAGES, n))) for s, n in end.items() for a in range(start.get(s, 0), n, PAGES)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            share, first, end = partition.value
            for number in range(first, end):
                for r in page(self._of(share), number):
                    yield (str(r["record_id"]), r.get("title"), r.get("content"), r.get("source_url"), name, {k: str(v) for k, v in (r.get("metadata") or {}).items()})

        def commit(self, end: dict) -> None:
            pass

    own = name

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return own

        def schema(self) -> str:
            return record

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(dict(self.options))

    return Source


def read(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """Records of a registered connector."""
    if name not in _KNOWN:
        raise KeyError(f"no connector {name}; there are {sorted(_KNOWN)}")
    spark.dataSource.register(_source(_KNOWN[name]))
    return spark.read.format(name).options(**options).load()


def union(*frames: DataFrame) -> DataFrame:
    """Records of several connectors; columns that one lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
